import random
import re
import zlib
from collections import Counter

import pytest

from icuflow.llm import spelling
from llm.conftest import ODD


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows, least=7, support=2, times=10, every=31):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least and n >= support}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= times * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def prose(seed, n_docs, letters="abÿé", stem="pre"):
    rnd = random.Random(seed)
    base = [stem * rnd.randint(0, 2) + "".join(rnd.choices(letters, k=rnd.randint(5, 9))) for _ in range(60)]
    rows = []
    for i in range(n_docs):
        words = []
        for w in rnd.choices(base, weights=[1 / (k + 1) for k in range(60)], k=80):
            at = rnd.randrange(len(w))
            edit = rnd.random()
            w = w[:at] + rnd.choice(letters) + w[at + (edit < 0.1) :] if edit < 0.2 else w
            words.append(w.capitalize() if rnd.random() < 0.3 else w)
        rows.append((i, rnd.choice([" ", ", ", "1"]).join(words)))
    return rows


@pytest.mark.parametrize("block", [7, 50, 20_000])
def test_like_brute_force(docs, block):
    rows = prose(block, 40) + ODD
    assert found(spelling.variants(docs(rows), times=3, every=5, block=block)) == brute(rows, times=3, every=5)


def test_production_rule(docs):
    rows = prose(9, 120, "abcdefgh") + [(5000 + i, "x" * 5000 + " " + "x" * 5001 + " Entertainment entertainmnt") for i in range(4)]
    want = brute(rows)
    assert any(w[1] for w in want) and any(len(w[0]) == 5001 for w in want)
    assert found(spelling.variants(docs(rows))) == want


def test_chain_of_forms(docs):
    rows = [(1, "abcdefgh " * 400), (2, "abcdefg " * 40), (3, "abcdef " * 9 + "bcdefgh " * 4)]
    assert found(spelling.variants(docs(rows), least=6, every=1 << 40)) == brute(rows, 6, every=1 << 40)


def test_common_prefix_is_not_all_pairs(monkeypatch):
    """A third of all words may share their first half: ranges that are too far away are skipped."""
    step = spelling._step

    def work(n):
        rnd = random.Random(4)
        words = sorted({b"entertain" + bytes(rnd.choices(range(97, 123), k=8)) for _ in range(n)})
        steps = []
        monkeypatch.setattr(spelling, "_step", lambda row, letter, around: steps.append(row.shape[1]) or step(row, letter, around))
        spelling.one_edit(words, words, [9] * len(words))
        return sum(steps) / len(words)

    assert work(24_000) < 3 * work(3_000)


def test_empty(docs):
    assert found(spelling.variants(docs([]))) == []
    assert found(spelling.variants(docs([(1, None), (2, "short words only")]))) == []
