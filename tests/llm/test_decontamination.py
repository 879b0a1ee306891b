import random
import re

import pytest
from pyspark.sql import functions as F

from icuflow.llm.decontamination import contamination, mark, n_hit
from llm.conftest import ODD

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(rows, items, window):
    out = []
    for d, t in rows:
        w, hit, found = split(t), set(), set()
        for name, item in items:
            i = split(item)
            size = min(window, len(i))
            for p in {tuple(i[s : s + size]) for s in range(len(i) - size + 1)} if size and name is not None else ():
                for s in range(len(w) - size + 1):
                    if tuple(w[s : s + size]) == p:
                        hit |= set(range(s, s + size))
                        found.add(str(name))
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def got(df):
    df = df.select("doc_id", "n_words", n_hit(F.col("spans")).alias("h"), F.array_sort(F.array_distinct("items")).alias("i"))
    return sorted(((r[0], r[1], r[2], list(r[3])) for r in df.collect()), key=str)


def cases():
    rnd = random.Random(7)
    words = ["a", "b", "c", "dé", "E1"]
    items = [(i, rnd.choice([" ", "-", ". "]).join(rnd.choices(words, k=rnd.randint(1, 9)))) for i in range(12)]
    items += [(3, "a b c"), (None, "a a"), (20, None), (21, "..."), (22, "a b c")]
    rows = [(i, rnd.choice([" ", ", "]).join(rnd.choices(words, k=rnd.randint(0, 60)))) for i in range(60)]
    return [*rows, *ODD, (99, "z " * 700 + "a-B c " + "z " * 700)], items


@pytest.mark.parametrize(("window", "block"), [(4, 4 << 20), (10, 4 << 20), (3, 400)])
def test_like_brute_force(llm, docs, window, block):
    rows, items = cases()
    bench = llm.createDataFrame(items, "item_id long, text string")
    assert got(contamination(docs(rows), bench, window=window, block_bytes=block)) == brute(rows, items, window)


def test_mark_keeps_columns_and_avoids_their_names(llm, docs):
    df = docs([(1, "one two three"), (2, "four")])
    marked, names = mark(df, llm.createDataFrame([("q", "two three")], "item_id string, text string"))
    assert marked.columns == df.columns + list(names)
    assert {r["doc_id"]: r[names[1]] for r in marked.collect()} == {1: [[1, 3]], 2: []}


def test_empty_tables(llm, docs):
    none = llm.createDataFrame([], "item_id long, text string")
    assert contamination(docs([]), none).collect() == []
    assert got(contamination(docs([(1, "a b")]), none)) == [(1, 2, 0, [])]
