import numpy as np

from icuflow.llm.license_scan import TEMPLATES, align, build_index, license_spans, scan, winnow
from icuflow.llm.text import ALNUM, words
from llm.conftest import ODD


def test_templates_are_found_whole_and_damaged(docs):
    rows = [(100 + i, f"Préface {i}. {text} Nachwort.") for i, text in enumerate(TEMPLATES.values())]
    notice = TEMPLATES["mit-notice"].split()
    rows.append((200, "x " + " ".join(notice[:20] + ["extra", "words"] + notice[20:50] + notice[52:])))
    rows += [*ODD, (300, "a text that is licensed to nobody"), (301, TEMPLATES["mit-line"] + " and " + TEMPLATES["mit-line"])]
    found = {r["doc_id"]: r["found"] for r in license_spans(docs(rows)).collect()}
    for i, (name, text) in enumerate(TEMPLATES.items()):
        hits = {h["license"]: h for h in found[100 + i]}
        assert hits[name]["coverage"] == 1.0
        data = dict(rows)[100 + i].encode()
        assert data[hits[name]["start"] : hits[name]["end"]].decode() in text
    assert {h["license"] for h in found[200]} == {"mit-notice"} and 0.9 < found[200][0]["coverage"] < 1
    assert found[300] == [] and all(found[i] == [] for i, _ in ODD if i)
    assert [h["license"] for h in found[301]] == ["mit-line", "mit-line"]


def test_empty_tables(docs):
    assert license_spans(docs([])).collect() == []
    assert license_spans(docs([(1, "MIT")]), templates={}).collect()[0]["found"] == []


def test_winnow_covers_every_window():
    grams = np.random.default_rng(1).integers(0, 50, 300).astype(np.uint64)
    at = winnow(grams, 5)
    assert all(((at >= i) & (at < i + 5)).any() for i in range(296))


def test_alignment_counts_matches_across_gaps():
    text = np.array([9, 9, 1, 2, 3, 8, 4, 5, 7, 9], np.uint64)
    assert align(text, np.array([1, 2, 3, 4, 5, 6, 7], np.uint64), 2, 3) == (6, 2, 9)


def test_scan_needs_coverage():
    index = build_index({"t": "one two three four five six seven eight"})
    part = next(words(__import__("pyarrow").array(["one two three four"]), ALNUM))
    assert scan(part.hashes, index, 4, 0.8) == []
    assert scan(part.hashes, index, 4, 0.5) == [("t", 0.5, 0, 4)]


def test_every_copy_with_a_fifth_of_edits_is_found(docs):
    """Each template with random words replaced, left out or put between, up to a fifth of its words: recall 1."""
    rnd, rows, wanted = np.random.default_rng(5), [], {}
    for name, text in TEMPLATES.items():
        part = next(words(__import__("pyarrow").array([text]), ALNUM))
        spelled = [part.data[a:b].tobytes().decode() for a, b in zip(part.starts, part.ends)]
        for _ in range(40):
            copy = [[w] for w in spelled]
            for i in rnd.choice(len(copy), len(copy) // 5, replace=False):
                copy[i] = [["qq"], [], [copy[i][0], "zz"]][rnd.integers(3)]
            wanted[len(rows)] = name
            rows.append((len(rows), "lorem ipsum dolor " * int(rnd.integers(0, 9)) + " ".join(w for ws in copy for w in ws) + " sit amet" * 5))
    found = {r["doc_id"]: {h["license"] for h in r["found"]} for r in license_spans(docs(rows)).collect()}
    assert [(name, rows[i][1]) for i, name in wanted.items() if name not in found[i]] == []


def test_long_text_full_of_seeds():
    """Pairs of words of a template, over and over, are not aligned one by one."""
    index = build_index(TEMPLATES)
    part = next(words(__import__("pyarrow").array(["under the sky and " * 100_000 + TEMPLATES["mit-line"]]), ALNUM))
    assert [x[0] for x in scan(part.hashes, index, 8, 0.8)] == ["mit-line"]
