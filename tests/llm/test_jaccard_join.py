import random
import re

import pytest

from icuflow.llm.components import components
from icuflow.llm.jaccard_join import Rule, merge_lists, similar
from llm.conftest import ODD


def brute(rows, rule):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        k = min(rule.words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and rule.den * both >= rule.num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed, groups, copies, words=60, changes=4):
    """Groups of near copies around the threshold, with a passage that all share, and texts of their own."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rnd.sample(vocabulary, 25)
    rows = []
    for _ in range(groups):
        base = passage + rnd.choices(vocabulary, k=words)
        for _ in range(copies):
            text = list(base)
            for _ in range(rnd.randint(0, changes)):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            rows.append(" ".join(text))
    rows += [" ".join(passage + rnd.choices(vocabulary, k=rnd.randint(0, 30))) for _ in range(20)]
    return list(enumerate(rows, 100))


@pytest.mark.parametrize("rule", [Rule(3, 90, 100), Rule(5, 80, 100, short=3, least_slack=0), Rule(2, 70, 100, short=2, least_slack=2)])
def test_like_brute_force(docs, rule):
    rows = corpus(rule.words, 4, 14)
    assert got(similar(docs(rows), rule)) == brute(rows, rule)


def test_odd_rows(docs):
    rows = [*ODD, (8, "word " * 2999), (9, None)]
    assert got(similar(docs(rows), Rule(3, 90, 100))) == brute(rows, Rule(3, 90, 100))


def test_empty_table(docs):
    assert similar(docs([])).collect() == []


def test_heap_counts_lists():
    assert list(merge_lists([[1, 4, 9], [4, 9], [9]], 2)) == [(4, 2), (9, 3)]


def test_components_of_a_path_and_a_star(llm):
    edges = [(i, i + 1) for i in range(10, 40)] + [(50 + i, 50) for i in range(1, 20)] + [(3, 3)]
    found = dict(map(tuple, components(llm.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {i: 10 for i in range(10, 41)} | {50 + i: 50 for i in range(20)}


def test_large_group_at_the_limit_leaves_few_rows(docs, monkeypatch):
    """Members that mostly just miss each other, and texts that share only a passage: rows stay in proportion, results whole."""
    from icuflow.llm import jaccard_join as J

    rows = corpus(11, 1, 260, words=70, changes=3) + [(9000 + i, t) for i, (_, t) in enumerate(corpus(12, 150, 1))]
    made = {}
    cut = J.cut
    monkeypatch.setattr(J, "cut", lambda df, name="cut": made.setdefault(name, []).append(df := cut(df, name)) or df)
    rule = Rule(3, 90, 100, short=8, least_slack=2)
    assert got(similar(docs(rows), rule)) == brute(rows, rule)
    assert all(df.count() < 3 * len(rows) for df in made["links"])


def test_forest_keeps_connections():
    from icuflow.llm.jaccard_join import Forest

    forest = Forest()
    assert [forest.join(*p) for p in [(5, 3), (3, 9), (9, 5), (1, 2), (2, 9), (1, 5)]] == [True, True, False, True, True, False]
    assert {forest.root(n) for n in (1, 2, 3, 5, 9)} == {1}
