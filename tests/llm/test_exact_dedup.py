import re

import numpy as np
import pytest

from icuflow.llm.exact_dedup import Directory, exact_groups, normalise, unique
from llm.conftest import ODD

ROWS = [*ODD, (10, "a  b\tc"), (11, "a b\nc"), (12, " a b c"), (13, "a b c "), (None, "lonely"), (14, "x y"), (15, "x y")]


def same(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(same(t), []).append(d)
    keep = {t: min((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    return sorted(((d, keep[same(t)], len(groups[same(t)]), d == keep[same(t)]) for d, t in rows), key=str)


weak = lambda digest: (digest[0] % 3) << 61  # noqa: E731  a lambda travels to the workers by value


@pytest.mark.parametrize("index", [{}, {"bucket_bytes": 80}, {"bucket_bytes": 80, "key": weak}, {"bucket_bytes": 1, "max_depth": 2}])
def test_like_brute_force(docs, index):
    found = exact_groups(docs(ROWS), **index).drop("text_sha256").collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(ROWS)


def test_unique_keeps_rows_whole(docs):
    df = docs(ROWS)
    left = unique(df)
    assert left.columns == df.columns
    texts = [same(r["text"]) for r in left.collect()]
    assert sorted(texts) == sorted({same(t) for _, t in ROWS})


def test_empty_table(docs):
    assert exact_groups(docs([])).collect() == []


def test_directory_doubles_where_buckets_are_full():
    cells = np.arange(16)
    sizes = np.array([9, 9, 1, 1] + [1] * 12)
    directory = Directory(cells, sizes, 10, 4)
    assert directory.depth == 4
    members = {}
    for c in range(16):
        members.setdefault(directory.bucket(c << 60), []).append(c)
    assert all(sum(sizes[m]) <= 10 for m in members.values())
    assert sorted(sum(members.values(), [])) == list(range(16))


def test_full_bucket_of_one_key_chains():
    directory = Directory(np.array([5]), np.array([1000]), 10, 4)
    assert directory.depth == 4
    assert directory.bucket(5 << 60) != directory.bucket(4 << 60)


def test_normalise():
    assert normalise(b"\x0b\x0c a\r\n\tb\xc2\xa0") == b" a b\xc2\xa0"
