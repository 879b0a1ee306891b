import hashlib
import random
import re
from collections import Counter

import pytest

from icuflow.llm import imatch
from llm.conftest import ODD


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def words(text):
    return set(re.findall(r"[^\W_]+", text.lower()))


def mark(text, count, n, bits=5, least=2):
    """(scale, hashes at the scale and the next) of one text, term by term."""
    terms = words(text)
    if not terms:
        return -1, [], [], "text:" + md5(text)
    scale = min(14, (len(terms) * 4 // 3).bit_length() - 1)
    lexicon = {}
    for t in terms:
        key = int(md5(t)[:15], 16)
        numbers = [(key % 2**30 * a + key // 2**30 * b) % 2**30 // 2**15 for a, b in imatch.factors()]
        for level in (0, 1):
            for r in range(16):
                if numbers[r] < 1 << (15 - scale - level):
                    lexicon.setdefault((level, r), []).append(t)
    sampled = {t for x in lexicon.values() for t in x}
    band = {t for t in sampled if count[t] >= least and count[t] << bits <= n}
    keys = lambda x: ",".join(str(k) for k in sorted(int(md5(t)[:15], 16) for t in x if t in (band or sampled)))
    hashes = [[md5(keys(lexicon.get((level, r), [])))[:6] if keys(lexicon.get((level, r), [])) else "-" for r in range(16)] for level in (0, 1)]
    return scale, *hashes, ":".join([str(scale), ".".join(hashes[0]), ".".join(hashes[1])])


def like(a, b):
    if a[3] == b[3]:
        return 1.0
    pairs = {0: [*zip(a[1], b[1]), *zip(a[2], b[2])], 1: [*zip(a[1], b[2])], -1: [*zip(a[2], b[1])]}.get(a[0] - b[0], [])
    pairs = [p for p in pairs if p != ("-", "-")]
    return round(sum(p == q for p, q in pairs) / len(pairs), 6) if pairs else 0.0


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), md5(r[1])))
    count = Counter(w for _, t in rows for w in words(t))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edit = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        a, b, c = (mark(x, count, len(rows)) for x in (t, edit, after))
        out.append((i, len(t), hashlib.sha256(edit.encode()).hexdigest(), a[3], b[3], like(a, b), like(a, c)))
    return sorted(out, key=str)


def prose(seed, ids):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdeéñ", k=rnd.randint(2, 7))) for _ in range(3000)]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.choice([1, 3, 20, 100, 600]))).capitalize() for _ in range(len(ids))]
    return [(i, texts[rnd.randrange(len(ids))] if rnd.random() < 0.1 else t) for i, t in zip(ids, texts)]


@pytest.mark.parametrize("held, ids", [(2000, range(90)), (3, range(-20, 70)), (1, [10**18 * (k % 7) + k for k in range(70)]), (2, [5] * 40 + [9] * 3 + [1 << 62, -(1 << 62)])])
def test_like_brute_force(docs, monkeypatch, held, ids):
    monkeypatch.setattr(imatch, "_HELD", held)
    monkeypatch.setattr(imatch, "_SEGMENTS", 4)
    rows = prose(held, list(ids)) + ODD + [(None, "another one without id"), (None, "!!!"), (77, "a" * 200_000)]
    found = imatch.fingerprints(docs(rows))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)


def test_edits_stay_near_and_neighbours_do_not(docs):
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(4000)]
    rows = [(i, "the of and " + " ".join(rnd.choices(vocabulary, k=300))) for i in range(300)]
    found = imatch.fingerprints(docs(rows)).collect()
    assert sum(r["near_edited"] > r["near_next"] for r in found) >= 295
    assert sum(r["near_next"] for r in found) < 0.02 * len(found)


def test_empty_table_and_single_rows(docs):
    assert imatch.fingerprints(docs([])).collect() == []
    for rows in ([(3, None)], [(None, "one text without id")]):
        assert [tuple(r) for r in imatch.fingerprints(docs(rows)).collect()] == brute(rows)
