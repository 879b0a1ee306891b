import hashlib
import math
import random
import re

from icuflow.llm import pii, queries
from llm.conftest import ODD

# The kinds and their patterns in the order of the contract.
BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for k, (name, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": name == "ip" and all(int(x) < 256 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}
            if good[name]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_like_brute_force(docs):
    rnd = random.Random(2)
    parts = ["a", "b.c", "@", "@x", ".de", "1", "255", "256", "007", ".", " ", "-", "+", "+1", "(30)", "4111 1111 1111 1111", "😀é", "5500005555555559", "x@y.z", "_"]
    rows = [(1000 + i, "".join(rnd.choices(parts, k=rnd.randint(1, 30)))) for i in range(400)]
    rows += [*ODD, (900, "a@b.c_x@d.ef@g.h"), (901, "1.2.3.4.5.6.7.8"), (902, "9" * 20_000), (903, "x" * 50_000 + "@ @a.b"), (904, "1@2.3 " * 2000)]
    found = {r["doc_id"]: [tuple(x) for x in r["base"]] for r in pii.private_spans(docs(rows)).collect()}
    wrong = [i for i, t in rows if i is not None and found[i] != brute(t)]
    assert wrong == []


def test_revealing_terms(docs):
    rows = [(i, f"noise{'abcdefgh'[i % 8]} the agent Smitherson wrote to x@y.org about the weather") for i in range(4)]
    rows += [(10 + i, "the weather is about the same as the agent wrote") for i in range(30)]
    found = {r["doc_id"]: (r["base"], [rows[0][1] and dict(rows)[r["doc_id"]][t["start"] : t["end"]] for t in r["terms"]]) for r in pii.private_spans(docs(rows)).collect()}
    for i in range(4):
        assert len(found[i][0]) == 1 and "Smitherson" in found[i][1] and not {"the", "weather", "agent"} & set(found[i][1])
    assert all(found[10 + i] == ([], []) for i in range(30))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(rows)).collect()}
    assert all("Smitherson" not in t and "x@y.org" not in t for t in clean.values())
    assert "[EMAIL]" in clean[0] and clean[10] == dict(rows)[10]


def brute_terms(rows, smooth=0.5, generalise=0.9, remove=0.97):
    """Per row the (start, end, action) of revealing words, by counting documents."""
    held, having, seen = [], {}, {}
    for _, text in rows:
        text = text or ""
        rest = re.sub(BASE[0][1], lambda m: " " * len(m.group()), text)
        places = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", rest)]
        held.append(({(k, text[a:b].lower()) for a, k, b in brute(text)}, places))
        for w in {m.group().lower() for m in re.finditer(r"[^\W\d_]{3,}", text)}:
            having[w] = having.get(w, 0) + 1
        for e in held[-1][0]:
            seen[e] = seen.get(e, 0) + 1
    out = []
    for entities, places in held:
        level = {}
        for w in {p[0] for p in places}:
            for e in entities:
                both = sum(e in es and any(p[0] == w for p in ps) for es, ps in held)
                ic = math.log2(len(rows) / seen[e])
                given = ic + math.log2(both / (having[w] + smooth))
                level[w] = max(level.get(w, 0), 2 if given >= remove * ic else 1 if given >= generalise * ic else 0)
        out.append([(a, b, "remove" if level[w] == 2 else "generalise") for w, a, b in places if level.get(w)])
    return out


def test_terms_like_brute_force(docs):
    rnd = random.Random(3)
    names = ["Anna", "Bertram", "Çelik", "Dora", "émile"]
    rows = []
    for i in range(150):
        filler = " ".join(rnd.choices(["the", "weather", "was", "fine", "today", "and", f"word{'xyzuvw'[i % 6] * 3}"], k=rnd.randint(1, 40)))
        who = rnd.randrange(40)
        known = f" {names[who]} has {names[who].lower()[:1]}x@mail.org" if who < 5 else f" single{chr(97 + i % 26) * 3} +49 (30) 12345{i:03d}" if who < 8 else ""
        rows.append((i, filler + known + (" " + filler + " " + names[who] if who < 5 else "")))
    rows += [(150, rows[3][1]), (151, None), (152, ""), (3, rows[3][1])]
    rows += [(200 + i, f"Rare{'abc'[i] * 4} mail q@w.er and " + "lorem ipsum " * 300 + f"rare{'abc'[i] * 4}") for i in range(3)]
    wanted = dict(zip([i for i, _ in rows], brute_terms(rows), strict=True))
    found = {r["doc_id"]: [tuple(t) for t in r["terms"]] for r in pii.private_spans(docs(rows)).collect()}
    assert found == wanted and sum(map(bool, wanted.values())) > 10


def test_single_mentions_and_far_occurrences(docs):
    rows = [(1, "Zebulon writes from z@q.org. " + "plain filler words " * 200 + "Then ZEBULON left.")]
    rows += [(i, "plain filler words then left writes from") for i in range(2, 1200)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(rows)).collect()}
    assert "zebulon" not in clean[1].lower() and clean[1].count("filler") == 200 and clean[5] == rows[4][1]


def test_empty_table(docs):
    assert pii.private_spans(docs([])).collect() == []


def test_query_counts_each_kind(docs, tmp_path):
    rnd = random.Random(4)
    parts = ["a@b.co ", "1.2.3.4 ", "4111 1111 1111 1111, ", "+49 (30) 1234567 x ", "words é ", "256.1.1.1 "]
    rows = [(i, "".join(rnd.choices(parts, k=rnd.randint(0, 12)))) for i in range(60)] + [(100, None)]
    docs(rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.QUERIES["op2_pii"](docs(rows).sparkSession, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        spans = brute(text)
        listed = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans)
        assert [found[i][f"n_{name}"] for name, _ in BASE] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert found[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
