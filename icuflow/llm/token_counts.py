"""Exact token counts; huge documents by overlapping chunks that are spliced where they agree."""

from __future__ import annotations

import json
import os
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.llm.pretokens import pieces, split_special
from icuflow.llm.text import add_columns, buffers

CACHED = 1 << 20  # spellings whose count a worker remembers
#: Characters before the end of a chunk that can still change: the longest ending that the split
#: pattern looks for, and what it looks ahead.
LOOKAHEAD = 4


class Counter:
    """Counts tokens of one byte-level tokenizer file with the tokenizers library.

    A text is split into pieces as the library splits it; each distinct piece is encoded once by
    the library itself, and its number of tokens remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if spec.get("normalizer") or not plain:
            raise ValueError(f"{path} does not split texts by the byte-level pattern alone")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.margin = LOOKAHEAD + max(map(len, self.special), default=0)
        self._known: dict[str, int] = {}

    def _sizes(self, spellings: list[str]) -> np.ndarray:
        known = self._known
        new = [s for s in spellings if s not in known]
        if len(known) + len(new) > CACHED:
            known.clear()
            new = spellings
        for s, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known[s] = len(found)
        return np.array([known[s] for s in spellings], np.int64)

    def boundaries(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the places where its pieces begin, and the tokens before each, then the totals."""
        rows, parts = split_special(texts, self.special)
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for found in pieces(p for p in parts if isinstance(p, str)):
            sizes = self._sizes(found.spellings)[found.numbers]
            lengths = np.array([len(s) for s in found.spellings], np.int64)[found.numbers]
            for j, (a, b) in enumerate(zip(found.offsets[:-1].tolist(), found.offsets[1:].tolist(), strict=True)):
                held.setdefault(found.first + j, []).append((lengths[a:b], sizes[a:b]))
        out: list[list] = [[] for _ in texts]
        number = 0
        for row, part in zip(rows, parts, strict=True):
            if isinstance(part, str):
                out[row] += held.pop(number, [])
                number += 1
            else:
                word = next(s for s, i in self.special.items() if i == part)
                out[row].append((np.array([len(word)]), np.array([1])))
        zero = np.zeros(1, np.int64)
        return [tuple(np.cumsum(np.concatenate([zero, *(x[k] for x in own)])) for k in (0, 1)) for own in out]

    def count_long(self, text: str, chunk: int, overlap: int) -> int:
        """Tokens of one huge text, from overlapping chunks.

        The first chunk begins at a true boundary. The split pattern never looks back, so where a later
        chunk has a boundary at the same place as the true boundaries of the chunk before, all that
        follows is the same too; ends nearer than ``margin`` to the end of a chunk do not count, as
        text beyond could change them. The tokens before that place are taken from the earlier chunk. If
        the overlap has no such place, the later chunk begins twice as far back, at the true boundary
        where the earlier one began at the latest.
        """
        total, begin, end = 0, 0, min(chunk, len(text))
        starts, counts = self.boundaries([text[:end]])[0]
        while end < len(text):
            back, stop = overlap, min(end + chunk, len(text))
            while True:
                at = max(end - back, begin)
                near = starts + begin
                new_starts, new_counts = self.boundaries([text[at:stop]])[0]
                common = np.intersect1d(near[(near >= at) & (near <= end - self.margin)], new_starts + at)
                if len(common) or at == begin:
                    break
                back *= 2
            place = int(common[-1]) if len(common) else begin
            total += int(counts[np.searchsorted(near, place)])
            skip = int(np.searchsorted(new_starts + at, place))
            begin, end = place, stop
            starts, counts = new_starts[skip:] + at - place, new_counts[skip:] - new_counts[skip]
        return total + int(counts[-1])

    def count(self, texts: pa.Array, chunk: int, overlap: int) -> list[int]:
        """Tokens of each text; null is empty."""
        out, short, at = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            text = text.as_py() or ""
            if len(text) > chunk:
                out[i] = self.count_long(text, chunk, overlap)
            elif text:
                short.append(text)
                at.append(i)
        rows, parts = split_special(short, self.special)
        plain = [(at[r], p) for r, p in zip(rows, parts, strict=True) if isinstance(p, str)]
        for r, p in zip(rows, parts, strict=True):
            out[at[r]] += not isinstance(p, str)
        for found in pieces(p for _, p in plain):
            sizes = np.concatenate([[0], np.cumsum(self._sizes(found.spellings)[found.numbers])])[found.offsets]
            for j, n in enumerate(np.diff(sizes).tolist()):
                out[plain[found.first + j][0]] += n
        return out


@cache
def counter(path: str) -> Counter:
    """The counter of a tokenizer file, built once per worker."""
    return Counter(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, chunk: int = 1 << 16, overlap: int = 256) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    Null counts as empty: no bytes, no tokens. Repeated rows give repeated rows, an empty table none.
    Texts above ``chunk`` characters are encoded in chunks that overlap by ``overlap`` at first. Other
    columns are not read. ``path`` is a tokenizer file that all executors have. No shuffle.
    """

    def run(texts: pa.Array) -> list:
        return [np.diff(buffers(texts)[1]), counter(path).count(texts, chunk, overlap)]

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = add_columns(rows, "text", run, "n_bytes bigint, n_tokens bigint")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
