"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.llm.quality import held_out
from icuflow.llm.text import ALNUM, add_columns, mix, range_hashes, text_values, words

BITS = 15  # rows of each embedding table
PREFIXES = (4, 5, 6, 7)  # bytes of a longer word that have rows of their own
TABLES = 2 + len(PREFIXES)
NONE = TABLES << BITS  # the row of a prefix that a word does not have; always 0
WIDTHS = (1, 2, 3)
FILTERS = 4  # of each width
SIZE = 12  # of an embedding
GUESS_BITS = 13
BLOCK = 1 << 17  # words
SPAN, STEPS = 16, 32  # thresholds are chosen among log odds from -SPAN to SPAN, so many to one
BINS = 2 * SPAN * STEPS


def word_rows(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, embedding rows of each word, word hashes, offsets of the texts).

    A word has two rows by two hash functions, so that two words seldom share both, and one for each prefix,
    so that a word not seen before is known by its beginning.
    """
    mask = np.uint64((1 << BITS) - 1)
    for part in words(texts, ALNUM):
        n = len(part.hashes)
        rows = np.full((n, TABLES), NONE, np.int32)
        rows[:, 0] = part.hashes & mask
        rows[:, 1] = ((part.hashes >> np.uint64(20)) & mask) + (mask + np.uint64(1))
        for a in range(0, n, BLOCK):
            starts, ends = part.starts[a : a + BLOCK], part.ends[a : a + BLOCK]
            values = text_values(part.data[starts[0] : ends[-1]])
            for k, size in enumerate(PREFIXES, 2):
                has = np.flatnonzero(ends - starts > size)
                begin = starts[has] - starts[0]
                rows[a + has, k] = (range_hashes(values, begin, begin + size) & mask).astype(np.int32) + (k << BITS)
        yield part.first, rows, part.hashes, part.offsets


@dataclass
class Net:
    """embedding: all tables, one above the other; a word is the sum of its rows. filters: by width, as
    (place, embedding, filter). weight: from the maximum of each filter to the log odds."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    offset: np.ndarray
    weight: np.ndarray
    bias: float
    frozen: np.ndarray | None = None

    def table(self) -> np.ndarray:
        """What each row adds to each filter at each of its places."""
        return np.concatenate([np.einsum("re,pef->rpf", self.embedding, f).reshape(len(self.embedding), -1) for f in self.filters], axis=1).astype(np.float32)

    def responses(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Responses of every filter at every word of many texts; -1e9 where a filter would pass a text's end.

        A text shorter than a filter is read by that filter's first places.
        """
        n = len(rows)
        each = self.look_up(rows)
        text = np.searchsorted(starts, np.arange(n), "right") - 1
        stops = np.append(starts[1:], n)[text]
        left, length = stops - np.arange(n), stops - starts[text]
        out = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        column = 0
        for k, width in enumerate(WIDTHS):
            total = out[:, k * FILTERS : (k + 1) * FILTERS]
            for place in range(width):
                total[: n - place] += each[place:, column : column + FILTERS] * (left[: n - place] > place)[:, None]
                column += FILTERS
            total[(left < width) & ~((length < width) & (left == length))] = -1e9
        return out

    def look_up(self, rows: np.ndarray) -> np.ndarray:
        """For each word the sum over its rows of what they add to each filter at each place."""
        if self.frozen is None:
            vectors = self.embedding[rows].sum(axis=1)
            return np.concatenate([np.einsum("ne,pef->npf", vectors, f).reshape(len(rows), -1) for f in self.filters], axis=1)
        total = self.frozen[rows[:, 0]]
        for k in range(1, TABLES):
            total += self.frozen[rows[:, k]]
        return total

    def freeze(self) -> Net:
        """Only looks up and adds from now on."""
        self.frozen, self.embedding = self.table(), np.empty((0, SIZE))
        return self

    def logits(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.zeros(0)
        top = np.maximum.reduceat(self.responses(rows, starts), starts, axis=0)
        return np.maximum(top + self.offset, 0) @ self.weight + self.bias


@dataclass
class Model:
    """The net, log odds of each language by word bucket, and the threshold of each language."""

    net: Net | None
    guess: np.ndarray = field(default_factory=lambda: np.zeros((1 << GUESS_BITS, 1), np.float32))
    thresholds: np.ndarray = field(default_factory=lambda: np.array([0.5]))
    default: float = 0.0

    def languages(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The guessed languages of texts that begin at the given words."""
        return np.add.reduceat(self.guess[(mix(hashes) >> np.uint64(64 - GUESS_BITS)).astype(np.int64)], starts, axis=0).argmax(axis=1)

    def scores(self, rows: np.ndarray, hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of texts given by their words; the language's threshold is moved to 0.5."""
        n = len(offsets) - 1
        out = np.full(n, self.default)
        full = np.flatnonzero(np.diff(offsets))
        if self.net is None or not len(full):
            return out
        starts = offsets[full]
        raw = 1 / (1 + np.exp(-self.net.logits(rows, starts)))
        t = self.thresholds[self.languages(hashes, starts)]
        out[full] = np.where(raw < t, 0.5 * raw / t, 0.5 + 0.5 * (raw - t) / (1 - t))
        return np.clip(out, 0.0, 1.0)


def _join(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def _log_odds(texts: list[np.ndarray], truth: np.ndarray, pseudo: float = 10.0, trust: float = 20.0) -> np.ndarray:
    """For each embedding row how much more often toxic texts have it, in log odds, shrunk where few texts have it."""
    seen = np.zeros((2, NONE + 1))
    for t, y in zip(texts, truth, strict=True):
        seen[int(y), np.unique(t)] += 1
    prior, n = truth.mean(), seen.sum(axis=0)
    odds = np.log((seen[1] + pseudo * prior) / (seen[0] + pseudo * (1 - prior))) - np.log(prior / (1 - prior))
    odds[NONE] = 0
    return odds * n / (n + trust)


def fit_net(texts: list[np.ndarray], truth: np.ndarray, epochs: int, batch: int, seed: int) -> Net:
    """Trained by Adagrad on the cross entropy; only the places that win a maximum pass gradients on.

    ``texts`` has the rows of the words of each text. The first entry of an embedding begins as half the row's log odds, which the first filter of width 1
    passes on, so that training begins at a linear classifier.
    """
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.02, (NONE + 1, SIZE))
    embedding[:, 0] = 0.5 * _log_odds(texts, truth)
    embedding[NONE] = 0
    filters = [rng.normal(0, 0.1, (w, SIZE, FILTERS)) for w in WIDTHS]
    filters[0][0, :, 0] = 0
    filters[0][0, 0, 0] = 1
    weight = rng.normal(0, 0.1, len(WIDTHS) * FILTERS)
    weight[0] = 2.0
    net = Net(embedding, filters, np.zeros(len(weight)), weight, -4.0)
    size = [np.full(x.shape, 0.1) for x in (embedding, *filters, net.offset, weight)] + [np.array(0.1)]
    share = np.where(truth == 1, 0.5 / max(truth.mean(), 1e-9), 0.5 / max(1 - truth.mean(), 1e-9))
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            rows, offsets = _join([texts[i] for i in some])
            starts, stops = offsets[:-1], offsets[1:]
            response = net.responses(rows, starts)
            win = np.stack([s + response[s:e].argmax(axis=0) for s, e in zip(starts, stops, strict=True)])
            top = np.take_along_axis(response, win, axis=0) + net.offset
            live = np.maximum(top, 0)
            error = (1 / (1 + np.exp(-(live @ net.weight + net.bias))) - truth[some]) * share[some] / len(some)
            d_top = error[:, None] * net.weight * (top > 0)
            d_embedding: dict[int, np.ndarray] = {}
            d_filters = [np.zeros_like(f) for f in net.filters]
            for k, width in enumerate(WIDTHS):
                for place in range(width):
                    at = win[:, k * FILTERS : (k + 1) * FILTERS] + place
                    d = d_top[:, k * FILTERS : (k + 1) * FILTERS] * (at < stops[:, None])
                    word = rows[np.minimum(at, len(rows) - 1)]
                    vector = net.embedding[word].sum(axis=2)
                    d_filters[k][place] += np.einsum("bf,bfe->ef", d, vector)
                    back = d[:, :, None] * net.filters[k][place].T[None]
                    for i, f in zip(*np.nonzero(d), strict=True):
                        for r in word[i, f][word[i, f] != NONE].tolist():
                            d_embedding[r] = d_embedding.get(r, 0) + back[i, f]
            found = np.array(list(d_embedding), np.int64)
            if len(found):
                g = np.stack(list(d_embedding.values()))
                size[0][found] += g * g
                net.embedding[found] -= 0.05 * g / np.sqrt(size[0][found])
            for i, (p, g) in enumerate(zip([*net.filters, net.offset, net.weight], [*d_filters, d_top.sum(axis=0), live.T @ error], strict=True), 1):
                size[i] += g * g
                p -= 0.02 * g / np.sqrt(size[i])
            g = error.sum()
            size[-1] += g * g
            net.bias -= float(0.02 * g / np.sqrt(size[-1]))
    return net


def calibrate(counts: np.ndarray, least: int = 20) -> np.ndarray:
    """For each language the threshold with the best F1 over all its labelled texts.

    ``counts`` has, by language, bin of the log odds, class and number (texts, weight), how many texts there are and
    how many they stand for. Languages with fewer than ``least`` toxic texts use all texts' threshold.
    """

    def best(weight: np.ndarray) -> float:
        positive = weight[:, 1].sum()
        if not positive or positive == weight.sum():
            return 0.5
        bins = np.flatnonzero(weight.sum(axis=1))[::-1]
        hit, marked = np.cumsum(weight[bins, 1]), np.cumsum(weight[bins].sum(axis=1))
        at = int((2 * hit / (marked + positive)).argmax())
        edges = _chance(bins[at : at + 2])
        return float(edges.mean() if len(edges) == 2 else edges[0] / 2)

    overall = best(counts[..., 1].sum(axis=0))
    return np.array([best(c[..., 1]) if c[:, 1, 0].sum() >= least else overall for c in counts])


def _chance(bins: np.ndarray) -> np.ndarray:
    """The score in the middle of bins of the log odds."""
    return 1 / (1 + np.exp(SPAN - (bins + 0.5) / STEPS))


def labelled_counts(docs: DataFrame, known: DataFrame, fitted: DataFrame, model: Model, max_chars: int) -> np.ndarray:
    """Counts for ``calibrate`` of all labelled rows with words, of any length.

    Rows that the weights were fitted on score too well, so those of a language, class and length (up to ``max_chars``
    or beyond) are stood for by the rows that were not, in equal parts; they count themselves where there are no others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> list:
        language, bins = np.full(len(texts), -1, np.int32), np.zeros(len(texts), np.int32)
        for first, rows, hashes, offsets in word_rows(texts):
            full = np.flatnonzero(np.diff(offsets))
            if len(full):
                starts = offsets[full]
                language[first + full] = shared.value.languages(hashes, starts)
                logits = shared.value.net.logits(rows, starts)
                bins[first + full] = np.clip(np.floor((logits + SPAN) * STEPS), 0, BINS - 1)
        return [language, bins]

    rows = docs.filter(F.col("text").isNotNull()).select("id", "text", (F.length("text") > max_chars).alias("long"))
    rows = add_columns(rows, "text", run, "language int, bin int").drop("text").filter("language >= 0")
    marks = known.join(F.broadcast(fitted.withColumn("used", F.lit(True))), ["id", "y"], "left").fillna(False, ["used"])
    found = rows.join(marks, "id").groupBy("language", "bin", "y", "long", "used").count().collect()
    out = np.zeros((model.guess.shape[1], BINS, 2, 2))
    if not found:
        return out
    language, bins, y, long, used, n = (np.array([r[k] for r in found]) for k in ("language", "bin", "y", "long", "used", "count"))
    group = (language * 2 + y) * 2 + long
    every, rest = np.bincount(group, n), np.bincount(group, n * ~used)
    counted = ~used | (rest[group] == 0)
    stands = np.where(rest[group] == 0, 1.0, every[group] / np.maximum(rest[group], 1))
    at = language[counted], bins[counted], y[counted]
    np.add.at(out[..., 0], at, n[counted])
    np.add.at(out[..., 1], at, (n * stands)[counted])
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", per_class: int = 2000, max_chars: int = 20_000, epochs: int = 6, batch: int = 64, seed: int = 11) -> Model:
    """The classifier. Its weights are fitted on a bounded sample: of each class the first three quarters of the
    labelled texts by a hash of their id, at most ``per_class``, those up to ``max_chars`` characters long, none held out.

    All labelled texts that are not held out, of any length, set the thresholds, each class with its share in the
    corpus. Their languages, like those of texts to score, are guessed from words. Without both classes every text
    scores the share of toxic ones (0 without labels).
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)").filter(~held_out(F.col("id"))).distinct()
    sizes = dict(known.groupBy("y").count().collect())
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(min(per_class, -(-sizes.get(y, 0) * 3 // 4)))
        chosen = part if chosen is None else chosen.unionByName(part)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(~held_out(F.col("id")))
    rows = docs.filter(F.col("text").isNotNull() & (F.length("text") <= max_chars)).join(F.broadcast(chosen), "id").select("id", "y", "lang", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(h[x:y].tobytes(), r[x:y].tobytes()) for _, r, h, o in word_rows(b.column(3)) for x, y in zip(o[:-1], o[1:], strict=True)]
            made = [pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], names=["id", "y", "lang", "words", "rows"])

    found = rows.mapInArrow(read, f"id {dict(rows.dtypes)['id']}, y int, lang string, words binary, rows binary").collect()
    found = sorted(({(r["id"], r["y"], r["words"]): r for r in found if r["words"]}).values(), key=lambda r: (crc32(f"{r['id']}".encode()), r["id"], r["y"]))
    if not found:
        return Model(None)
    texts = [np.frombuffer(r["words"], np.uint64) for r in found]
    rows = [np.frombuffer(r["rows"], np.int32).reshape(-1, TABLES) for r in found]
    truth = np.array([r["y"] for r in found])
    if truth.min() == truth.max():
        return Model(None, default=float(truth[0]))
    names = sorted({r["lang"] or "" for r in found})
    place = {name: i for i, name in enumerate(names)}
    votes = np.ones((1 << GUESS_BITS, len(names)))
    for t, r in zip(texts, found, strict=True):
        np.add.at(votes[:, place[r["lang"] or ""]], (mix(np.unique(t)) >> np.uint64(64 - GUESS_BITS)).astype(np.int64), 1)
    guess = np.log(votes / votes.sum(axis=0)).astype(np.float32)
    net = fit_net(rows, truth, epochs, batch, seed).freeze()
    model = Model(net, guess, np.full(len(names), 0.5))
    counts = labelled_counts(docs, known, chosen, model, max_chars)
    model.thresholds = calibrate(counts)
    scored = np.flatnonzero(counts[..., 0].sum(axis=(0, 2)))
    model.default = float(_chance(scored[:1])[0] * 0.5)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    The score comes from the whole text alone. Its words are runs of ASCII letters, digits and characters
    beyond ASCII, A-Z lowered. Null texts and texts without words get the model's lowest score. Repeated rows
    score alike. An empty table gives no rows. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> list:
        out = np.zeros(len(texts))
        for first, rows, hashes, offsets in word_rows(texts):
            found = shared.value.scores(rows, hashes, offsets)
            out[first : first + len(found)] = found
        return [out]

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = add_columns(rows, "text", run, "score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
