"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.llm.quality import held_out
from icuflow.llm.text import SPACED, add_columns, words

SPAN = 24  # bytes that the network reads in one sequence
MEMORY = 1 << 20  # sequences that a task remembers


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


@dataclass
class Network:
    """Two gated recurrent units over bytes, one in each direction, and a softmax at every position.

    table: what each byte adds to the gates (reset, update, candidate), by direction; state: what the
    state adds; out, bias: from both states to the languages.
    """

    languages: list[str]
    table: list[np.ndarray]
    state: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        table = [draw(256, 3 * hidden, scale=0.5) for _ in range(2)]
        state = [draw(hidden, 3 * hidden, scale=hidden**-0.5) for _ in range(2)]
        return cls(languages, table, state, draw(2 * hidden, len(languages), scale=hidden**-0.5), np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.state, self.out, self.bias]

    def run(self, data: np.ndarray, way: int, keep: list | None = None) -> np.ndarray:
        """States after each byte of sequences of one length, as (position, sequence, unit)."""
        state = self.state[way]
        h = state.shape[0]
        out = np.empty((data.shape[1], len(data), h), np.float32)
        now = np.zeros((len(data), h), np.float32)
        for t in range(data.shape[1]):
            x, s = self.table[way][data[:, t]], now @ state
            gates = _sigmoid(x[:, : 2 * h] + s[:, : 2 * h])
            r, z = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * s[:, 2 * h :])
            if keep is not None:
                keep.append((now, r, z, new, s[:, 2 * h :]))
            now = new + z * (now - new)
            out[t] = now
        return out

    def positions(self, data: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Language probabilities at each position, as (position, sequence, language), and the states."""
        ahead = self.run(data, 0, keep and keep[0])
        back = self.run(data[:, ::-1], 1, keep and keep[1])[::-1]
        both = np.concatenate([ahead, back], axis=2)
        p = np.exp(both @ self.out + self.bias)
        return p / p.sum(axis=2, keepdims=True), both

    def gradients(self, data: np.ndarray, truth: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross entropy over all positions, by backpropagation through time."""
        kept: tuple[list, list] = ([], [])
        p, both = self.positions(data, kept)
        error = p.copy()
        error[:, np.arange(len(data)), truth] -= 1
        error /= p.shape[0] * p.shape[1]
        flat = error.reshape(-1, error.shape[2])
        d_out, d_bias = both.reshape(-1, both.shape[2]).T @ flat, flat.sum(axis=0)
        d_both = error @ self.out.T
        h = self.state[0].shape[0]
        tables, states = [], []
        for way in (0, 1):
            seen = data if way == 0 else data[:, ::-1]
            outer = d_both[:, :, :h] if way == 0 else d_both[::-1, :, h:]
            d_table, d_state = np.zeros_like(self.table[way]), np.zeros_like(self.state[way])
            carry = np.zeros((len(data), h), np.float32)
            for t in range(data.shape[1] - 1, -1, -1):
                before, r, z, new, s = kept[way][t]
                d = carry + outer[t]
                d_new = d * (1 - z) * (1 - new * new)
                d_z = d * (before - new) * z * (1 - z)
                d_r = d_new * s * r * (1 - r)
                d_x = np.concatenate([d_r, d_z, d_new], axis=1)
                d_s = np.concatenate([d_r, d_z, d_new * r], axis=1)
                np.add.at(d_table, seen[:, t], d_x)
                d_state += before.T @ d_s
                carry = d * z + d_s @ self.state[way].T
            tables.append(d_table)
            states.append(d_state)
        return [*tables, *states, d_out, d_bias]


def fit(samples: list[tuple[bytes, int]], languages: list[str], hidden: int, steps: int, batch: int, seed: int) -> Network:
    """A network trained on byte sequences with their language, by Adam; each batch has sequences of one length."""
    net, rng = Network.new(languages, hidden, seed), np.random.default_rng(seed)
    groups: dict[int, list[int]] = {}
    for i, (data, _) in enumerate(samples):
        groups.setdefault(len(data), []).append(i)
    sizes = list(groups)
    ready = {n: (np.frombuffer(b"".join(samples[i][0] for i in g), np.uint8).reshape(-1, n), np.array([samples[i][1] for i in g])) for n, g in groups.items()}
    weight = np.array([n * len(groups[n]) for n in sizes], float)
    first, second = ([np.zeros_like(p) for p in net.parameters()] for _ in range(2))
    for step in range(1, steps + 1):
        data, truth = ready[sizes[rng.choice(len(sizes), p=weight / weight.sum())]]
        pick = rng.integers(0, len(data), min(batch, 4 * len(data)))
        rate = 0.02 * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for p, g, m, v in zip(net.parameters(), net.gradients(data[pick], truth[pick]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= np.float32(rate) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def spans(texts: pa.Array):
    """(first text, data, begin, size, text) of the sequences of all words, cut every SPAN bytes, of all texts."""
    for part in words(texts, SPACED, lower=False):
        size = part.ends - part.starts
        pieces = -(-size // SPAN)
        word = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        text = np.searchsorted(part.offsets, word, "right") - 1
        seed = part.hashes[word] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        yield part.first, part.data, part.starts[word] + nth * SPAN, np.minimum(size[word] - nth * SPAN, SPAN), text, seed


class Memory:
    """The summed probabilities of sequences that a task has read already; forgets all above MEMORY of them."""

    def __init__(self, n: int):
        self.keys, self.sums = np.empty(0, np.uint64), np.empty((0, n), np.float32)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sums of ordered keys, and which of them are not known."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        sums = self.sums[at] if len(self.keys) else np.empty((len(keys), self.sums.shape[1]), np.float32)
        return sums, np.flatnonzero(new)

    def add(self, keys: np.ndarray, sums: np.ndarray) -> None:
        if len(self.keys) < MEMORY:
            keys, sums = np.concatenate([self.keys, keys]), np.concatenate([self.sums, sums])
        order = np.argsort(keys, kind="stable")
        self.keys, self.sums = keys[order], sums[order]


def pooled(texts: pa.Array, net: Network, memory: Memory | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each text the mean of the language probabilities of all its positions, and the number of positions.

    Every word is a sequence of its own, so equal words have equal labels: the network reads a distinct
    word once, and its sums count for each place where the word stands.
    """
    n = len(net.languages)
    memory = memory or Memory(n)
    total, count = np.zeros((len(texts), n)), np.zeros(len(texts))
    for first, data, begin, size, text, seed in spans(texts):
        if not len(begin):
            continue
        keys, at, number = np.unique(seed, return_index=True, return_inverse=True)
        sums, new = memory.look_up(keys)
        order = new[np.argsort(size[at[new]], kind="stable")]
        ends = np.searchsorted(size[at[order]], np.arange(SPAN + 2))
        for length in range(1, SPAN + 1):
            group = order[ends[length] : ends[length + 1]]
            for a in range(0, len(group), 4096):
                some = group[a : a + 4096]
                p, _ = net.positions(data[begin[at[some]][:, None] + np.arange(length)])
                sums[some] = p.sum(axis=0)
        memory.add(keys[new], sums[new])
        rows = int(text.max()) + 1
        for j in range(n):
            total[first : first + rows, j] += np.bincount(text, sums[number, j], rows)
        count[first : first + rows] += np.bincount(text, size, rows)
    return total / np.maximum(count, 1)[:, None], count


def _sample(docs: DataFrame, per_language: int, per_document: int) -> list[tuple[str, list[bytes]]]:
    """Byte sequences of about ``per_language`` learnable documents of each language, ``per_document`` of each."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"))).select("id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for language, n in counts.items():
        share = F.when(F.col("lang") == language, F.lit(min(1.0, per_language / n))).otherwise(share)
    chosen = known.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < share * 1_000_000)

    def cut(batches):
        for batch in batches:
            out: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
            for first, data, begin, size, text, seed in spans(batch.column("text")):
                order = np.lexsort((seed, text))
                rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
                for i in np.sort(order[rank < per_document]).tolist():
                    out[first + int(text[i])].append(data[begin[i] : begin[i] + size[i]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(out, pa.list_(pa.binary()))], names=["lang", "parts"])

    return [tuple(r) for r in chosen.mapInArrow(cut, "lang string, parts array<binary>").collect()]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, per_document: int = 60, hidden: int = 8, steps: int = 1500, batch: int = 256, seed: int = 3) -> Network | None:
    """The network, fitted on a bounded sample; None where no document has a language to learn.

    Learns only from text and language of documents that are not held out: about ``per_language`` documents of
    each language, chosen by a hash of the id, and at most ``per_document`` words of each, chosen by their hash.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = sorted(_sample(rows, per_language, per_document))
    languages = sorted({lang for lang, parts in found if parts})
    number = {lang: i for i, lang in enumerate(languages)}
    samples = [(bytes(part), number[lang]) for lang, parts in found for part in parts]
    return fit(samples, languages, hidden, steps, batch, seed) if samples else None


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Every position of the whole text is labelled; lang_pred has the highest mean probability over all
    positions, score is that mean. Null texts and texts without a letter are ``und`` with score 0, as is every
    text when there is no network. Repeated rows are labelled alike. An empty table gives no rows. Other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    memory: list[Memory] = []

    def run(texts: pa.Array) -> list:
        lettered = np.array([_has_letter(t.as_py()) for t in texts], bool)
        if shared.value is None or not len(texts):
            return [["und"] * len(texts), [0.0] * len(texts)]
        if not memory:
            memory.append(Memory(len(shared.value.languages)))
        mean, _ = pooled(texts, shared.value, memory[0])
        best = mean.argmax(axis=1)
        names = [shared.value.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        return [names, np.where(lettered, np.minimum(mean[np.arange(len(mean)), best], 1.0), 0.0)]

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = add_columns(rows, "text", run, "lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
