"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from icuflow.llm.pretokens import Pieces, pieces, split_special
from icuflow.llm.text import add_columns

CACHED = 1 << 18  # spellings that a worker remembers


def _byte_names() -> dict[str, int]:
    """The visible characters by which tokenizer files of this kind name the 256 bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Encoder of one byte-level BPE file.

    Tokens are numbered by rank inside: 0 to 255 are the bytes, then the results of the merges in
    their order. ``halves`` has the two tokens that a merge joins, ``shorter`` the longest token that
    is a proper prefix, ``merged`` the merge of a pair. ``_joins`` remembers which neighbours are
    compatible: encoding the two spellings together gives just the two tokens.
    """

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        names, vocab = _byte_names(), spec["model"]["vocab"]
        raw = lambda name: bytes(names[c] for c in name)
        ids = {raw(name): i for name, i in vocab.items()}
        self.spelling = [bytes([b]) for b in range(256)]
        rank = {s: i for i, s in enumerate(self.spelling)}
        self.halves = [(i, i) for i in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for merge in spec["model"]["merges"]:
            left, right = (rank[raw(x)] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            joined = self.spelling[left] + self.spelling[right]
            if joined in rank:
                raise ValueError("two merges give the same token; backtracking needs one way to build each")
            rank[joined] = self.merged[left, right] = len(self.spelling)
            self.spelling.append(joined)
            self.halves.append((left, right))
        self.id_of = np.array([ids[s] for s in self.spelling], np.uint32)
        self._packed = [np.uint32(i).astype("<u4").tobytes() for i in self.id_of]
        self.shorter = [next((rank[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in rank), -1) for s in self.spelling]
        self.length = [len(s) for s in self.spelling]
        self._matches = ahocorasick.Automaton()
        for s, i in rank.items():
            self._matches.add_word(s.decode("latin-1"), i)
        self._matches.make_automaton()
        self._joins: dict[int, bool] = {}
        self._known: dict[str, bytes] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}

    def joins(self, left: int, right: int) -> bool:
        """Whether merging the spelling of both keeps the border between the two tokens.

        Undoes the merges next to the border from the latest back. The border falls if at some
        stage the two tokens beside it make a merge that would come before the ones undone so far.
        """
        a, b, good = left, right, True
        bound = len(self.halves)
        while True:
            made = self.merged.get((a, b), bound)
            if made < bound:
                good = False
                break
            if a < 256 and b < 256:
                break
            if a > b:  # the later merge is undone first; of two equal ones the right, made after the left
                bound, a = a, self.halves[a][1]
            else:
                bound, b = b + 1, self.halves[b][0]
        self._joins[left << 20 | right] = good
        return good

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ranks of the tokens of one piece, in time linear in its length."""
        n = len(piece)
        longest = [0] * n
        length, shorter, joined = self.length, self.shorter, self._joins.get
        for end, token in self._matches.iter(piece.decode("latin-1")):
            longest[end + 1 - length[token]] = token
        if length[longest[0]] == n:
            return longest[:1]
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if not dead[end]:
                fits = not out or joined(out[-1] << 20 | token)
                if fits is None:
                    fits = self.joins(out[-1], token)
                if fits:
                    out.append(token)
                    if end == n:
                        return out
                    at, token = end, longest[end]
                    continue
            token = shorter[token]
            while token < 0:  # nothing fits here: this place is never reached again
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter[token]

    def encode_spellings(self, spellings: list[str]) -> list[bytes]:
        """Packed ids of each spelling; spellings met before are looked up."""
        known, packed, out = self._known, self._packed, []
        if len(known) > CACHED:
            known.clear()
        if len(self._joins) > 4 * CACHED:
            self._joins.clear()
        for s in spellings:
            ids = known.get(s)
            if ids is None:
                ids = known[s] = b"".join([packed[i] for i in self.encode_piece(s.encode("utf-8", "surrogatepass"))])
            out.append(ids)
        return out

    def encode(self, texts) -> list[bytes]:
        """Token ids of each text, packed as little-endian unsigned 32-bit integers; null is empty.

        The strings of added tokens are cut out first, as the file's library does by default.
        """
        rows, parts = split_special(texts, self.special)
        out: list[list[bytes]] = [[] for _ in range(len(texts))]
        plain = pieces(p for p in parts if isinstance(p, str))
        ready: dict[int, list[bytes]] = {}
        number = 0
        for row, part in zip(rows, parts, strict=True):
            if not isinstance(part, str):
                out[row].append(np.uint32(part).tobytes())
                continue
            while number not in ready or not ready[number][1]:
                self._encode_some(next(plain), ready)
            out[row] += ready.pop(number)[0]
            number += 1
        return [b"".join(x) for x in out]

    def _encode_some(self, found: Pieces, ready: dict) -> None:
        """Adds the ids of the found pieces to ``ready``: text number to (parts, whether it is whole)."""
        spelled = self.encode_spellings(found.spellings)
        sizes = np.array([len(x) for x in spelled], np.int64) // 4
        begin = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(spelled), "<u4")
        ids = gather(flat, begin[found.numbers], sizes[found.numbers])
        total = np.concatenate([[0], np.cumsum(sizes[found.numbers])])[found.offsets].tolist()
        for j, (a, b) in enumerate(zip(total[:-1], total[1:], strict=True)):
            parts, _ = ready.get(found.first + j, ([], False))
            parts.append(ids[a:b].tobytes())
            ready[found.first + j] = parts, found.last


class Decoder:
    """The bytes of all tokens in a row, and where each begins."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        names = _byte_names()
        text = {i: bytes(names[c] for c in name) for name, i in spec["model"]["vocab"].items()}
        text |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        size = max(text) + 1
        self.offsets = np.concatenate([[0], np.cumsum([len(text.get(i, b"")) for i in range(size)])])
        self.bytes = np.frombuffer(b"".join(text.get(i, b"") for i in range(size)), np.uint8)

    def decode(self, packed) -> list[str]:
        """The text of each row of packed ids; bytes that are no UTF-8 become replacement characters; null is empty."""
        out = []
        for ids in packed:
            ids = np.frombuffer((ids.as_py() if isinstance(ids, pa.Scalar) else ids) or b"", "<u4").astype(np.int64)
            text = gather(self.bytes, self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids])
            out.append(text.tobytes().decode("utf-8", "replace"))
        return out


def gather(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs values[begin : begin + size], one after the other."""
    total = np.cumsum(sizes)
    if not len(total) or not total[-1]:
        return values[:0]
    return values[np.repeat(begin - total + sizes, sizes) + np.arange(total[-1])]


@cache
def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, built once per worker."""
    return Encoder(path)


@cache
def decoder(path: str) -> Decoder:
    """The decoder of a tokenizer file, built once per worker."""
    return Decoder(path)


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with n_tokens and token_ids (little-endian unsigned 32-bit integers).

    Null and empty texts have no tokens. Repeated rows are encoded alike. Names that the frame has
    already get an underscore behind them. ``path`` is a tokenizer file that all executors have.
    """

    def run(texts: pa.Array) -> list:
        packed = encoder(path).encode(texts)
        return [[len(x) // 4 for x in packed], packed]

    return add_columns(docs, text_col, run, "n_tokens bigint, token_ids binary")


def decode(docs: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """All columns of ``docs`` with decoded, the text of the packed ids; null gives an empty text."""
    return add_columns(docs, ids_col, lambda ids: [decoder(path).decode(ids)], "decoded string")


def unpack(packed: np.ndarray | bytes) -> np.ndarray:
    """Token ids as an array of integers."""
    return np.frombuffer(packed, "<u4")
