import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from icuflow.llm import periodic, queries
from llm.conftest import ODD


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(w, least=12):
    """All maximal runs, by comparing words at every lag."""
    out, seen = [], set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and (i, j) not in seen:
                out.append((i, j + q - i, q))
            i = j + 1
    best = {}
    for s, n, q in out:
        best[s, n] = min(q, best.get((s, n), q))
    return sorted((s, n, q) for (s, n), q in best.items())


def kept(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def sample(rnd, n):
    """Words full of repeats: units of units, damaged in places."""
    letters = [f"w{i}" for i in range(rnd.choice([1, 2, 3, 30, 500]))]
    out = []
    while len(out) < n:
        unit = rnd.choices(letters, k=rnd.choice([1, 2, 3, 7, 20, 45, 90]))
        if rnd.random() < 0.5:
            cut = rnd.randint(1, len(unit))
            unit = unit * rnd.randint(1, 9) + unit[:cut]
        out += unit * rnd.randint(1, 6)
        if rnd.random() < 0.5:
            out[rnd.randrange(len(out))] = rnd.choice(letters)
    return out[:n]


@pytest.mark.parametrize("seed", range(6))
def test_like_brute_force(docs, seed):
    rnd = random.Random(seed)
    rows = [(100 + i, rnd.choice([" ", "\n", " \t"]).join(sample(rnd, rnd.choice([5, 12, 40, 130, 300, 900])))) for i in range(60)] + ODD
    got = periodic.periodic_runs(docs(rows)).collect()
    want = sorted((i if i is not None else -1, len(w := split(t)), brute(w), kept(w, brute(w))) for i, t in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words_"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got) == want


def test_unit_that_is_itself_periodic():
    """Two runs of one short period side by side make many runs of long periods."""
    for p in (1, 2, 3, 5, 9):
        unit = [f"u{i}" for i in range(p)]
        for m in (40, 77, 160):
            w = (unit * 400)[:m] + unit * (m // p) + ["end"] + (unit * 400)[1 : m + 3] + unit[:1] * 3 + unit * 60
            values = np.array([hash(x) & 0x7FFFFFFFFFFFFFFF for x in w], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            assert sorted(zip(*(x.tolist() for x in periodic.find_runs(values, len(w))), strict=True)) == brute(w), (p, m)


@pytest.mark.parametrize("kind", ["one word", "period 20", "cut periods", "no repeat"])
def test_time_grows_with_the_text(kind):
    def values(n):
        rnd = np.random.default_rng(3)
        word = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
        if kind == "one word":
            return np.full(n, 77, np.uint64)
        if kind == "period 20":
            return word[np.arange(n) % 20]
        if kind == "cut periods":
            return np.where(np.arange(n) % 700 < 650, word[np.arange(n) % 20], word)
        return word

    def seconds(n):
        begin = time.perf_counter()
        periodic.find_runs(values(n), n)
        return time.perf_counter() - begin

    seconds(1000)
    assert seconds(400_000) < 12 * seconds(100_000) + 0.5


def test_query(llm, tmp_path):
    rnd = random.Random(8)
    rows = [(i, None if i == 7 else " \n ".join(rnd.choices([f"x{k}" for k in range(400)], k=rnd.choice([0, 1, 9, 40, 300])))) for i in range(150)]
    llm.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text in rows:
        w = split(text)
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs = brute(w)
        s, n, q = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        want.append((i, len(runs), s, n, q, n and 1000 * n // q, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(kept(w, runs))))
    got = queries.QUERIES["op12_periodic"](llm, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(r) for r in got.select(names).collect()) == want and any(w[1] for w in want)
    assert [t for c, t in got.dtypes if c in names[:6]] == ["bigint"] * 6


def test_empty_table(docs):
    assert periodic.periodic_runs(docs([])).collect() == []
    assert periodic.periodic_runs(docs([(1, None)])).select(F.size("runs")).collect() == [(0,)]
