import random
import zlib

import numpy as np
import pyarrow as pa

from icuflow.llm import language_id, quality, toxicity
from llm.conftest import ODD

WORDS = {"en": ["the", "and", "thing", "other", "ship"], "de": ["der", "und", "schön", "ach", "keit"], "fr": ["le", "été", "eaux", "que", "mont"]}


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def speech(n=150, bad=(), seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        text = rnd.choices(WORDS[lang], k=rnd.randint(20, 60))
        if bad and i % 3 == 0:
            text[rnd.randrange(len(text))] = rnd.choice(bad)
        rows.append((i, " ".join(text), lang))
    return rows


def frame(llm, rows):
    return llm.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS score", "1 AS id", "'y' AS key", "0 AS target")


def test_gradients_of_the_recurrent_network():
    net = language_id.Network.new(["a", "b"], 3, 1)
    net.table, net.state = ([x.astype(float) for x in p] for p in (net.table, net.state))
    net.out, net.bias = net.out.astype(float), net.bias.astype(float)
    data, truth = np.random.default_rng(0).integers(97, 101, (4, 5)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss():
        return -np.log(net.positions(data)[0][:, np.arange(4), truth]).mean()

    for p, g in zip(net.parameters(), net.gradients(data, truth), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        p[at] += 1e-3
        up = loss()
        p[at] -= 2e-3
        down = loss()
        p[at] += 1e-3
        assert abs((up - down) / 2e-3 - g[at]) < 1e-3


def test_language_held_out(llm):
    df = frame(llm, [*speech(), *((i, t, None) for i, t in ODD), (500, "12 !? 34", "en")])
    net = language_id.train(df, steps=200)
    found = language_id.identify(df, net).collect()
    truth = {i: lang for i, _, lang in speech()}
    assert all(r["lang_pred"] == truth[r["doc_id"]] for r in found if r["doc_id"] is not None and held(r["doc_id"]) and r["doc_id"] > 10)
    assert all(r["held_out"] == held(r["doc_id"]) for r in found if r["doc_id"] is not None)
    assert [(r["lang_pred"], r["score"]) for r in found if r["doc_id"] == 500] == [("und", 0.0)]
    assert all(0 <= r["score"] <= 1 for r in found) and len(found) == len(speech()) + len(ODD) + 1


def test_pooling_is_the_mean_over_positions():
    net = language_id.Network.new(["a", "b"], 4, 2)
    text = "abc de " + "f" * 30
    parts = [b"abc", b"de", b"f" * 24, b"f" * 6]
    want = np.concatenate([net.positions(np.frombuffer(p, np.uint8)[None])[0][:, 0] for p in parts]).mean(axis=0)
    mean, count = language_id.pooled(pa.array([text, None, text]), net)
    assert count.tolist() == [35, 0, 35]
    assert np.allclose(mean[0], want, atol=1e-6) and np.allclose(mean[2], want, atol=1e-6)


def test_language_without_rows_to_learn(llm):
    df = frame(llm, [(1, "word", None)])
    assert language_id.train(df) is None
    assert language_id.identify(df, None).first()["lang_pred"] == "und"
    assert language_id.identify(frame(llm, []), None).collect() == []


def test_toxicity_held_out(llm):
    rows = speech(400, bad=("idiot", "dummkopf", "sot"))
    df = frame(llm, [*rows, *((1000 + k, t, None) for k, (_, t) in enumerate(ODD))])
    labels = llm.createDataFrame([(i, int(i % 3 == 0)) for i, _, _ in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity.score(df, toxicity.train(df, labels)).collect()}
    kept = [i for i, _, _ in rows if held(i)]
    right = sum(found[i]["predicted"] == int(i % 3 == 0) for i in kept)
    assert right >= 0.9 * len(kept)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found.values())
    assert found[1000]["score"] == found[1001]["score"] and found[1000]["predicted"] == 0


def test_toxicity_thresholds_know_how_common_the_classes_are(llm):
    """A word of half the toxic texts stands in more clean ones: marking it lowers F1 unless the classes are balanced."""
    rows, toxic = [], set()
    for i, text, _ in speech(900):
        if i % 10 == 0:
            toxic.add(i)
        extra = {0: "idiot", 10: "grey"}.get(i % 20, "grey" if i % 20 in (1, 2, 3) else "plain")
        # Most clean texts are beyond max_chars: they set the thresholds too.
        rows.append((i, text.replace(" ", f" {extra} ", 1) + (" ship" * 80 if i % 20 in (1, 2, 4, 5, 6) else ""), "en"))
    labels = llm.createDataFrame([(i, int(i in toxic)) for i, _, _ in rows], "doc_id long, toxic int")
    df = frame(llm, rows)
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, toxicity.train(df, labels, per_class=60, max_chars=400)).collect()}
    kept = [i for i, _, _ in rows if held(i)]
    assert np.mean([found[i] for i in kept if i % 20 == 0]) > 0.9
    assert np.mean([found[i] for i in kept if i % 20 in (1, 2, 3, 10)]) < 0.1


def test_toxicity_without_labels(llm):
    df, none = frame(llm, speech(5)), llm.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(df, toxicity.train(df, none)).collect()} == {0.0}
    assert toxicity.score(frame(llm, []), toxicity.train(frame(llm, []), none)).collect() == []


def test_quality_rejects_junk_and_keeps_clean(llm):
    rnd = random.Random(4)
    junk = [(1000 + i, rnd.choice(["{}!!", "{}$$$", "| {}"]).format(" ").join(w.upper() for w in rnd.choices(WORDS["en"], k=40)), "en") for i in range(60)]
    clean = [(i, t.capitalize() + ".", lang) for i, t, lang in speech(300)]
    df = frame(llm, [*clean, *junk, (5000, None, "en"), (5001, " ", None), (None, "the and", None), (3, clean[3][1], "en")])
    labels = llm.createDataFrame([(i, 1) for i, _, _ in clean[:200]] + [(i, 0) for i, _, _ in junk[:40]] + [(None, 1), (9, None)], "doc_id long, quality int")
    found = quality.resample(df, labels).collect()
    chosen = {r["doc_id"] for r in found if r["selected"]}
    assert not chosen & {i for i, _, _ in junk}
    assert len(chosen & {i for i, _, _ in clean}) >= 299
    assert [r["log_weight"] for r in found if r["doc_id"] in (5000, 5001)] == [None, None] and not chosen & {5000, 5001}
    assert len(found) == 364


def test_quality_edges(llm):
    none = llm.createDataFrame([], "doc_id long, quality int")
    assert quality.resample(frame(llm, []), none).collect() == []
    assert all(r["selected"] for r in quality.resample(frame(llm, speech(20)), none).collect())


def test_top_k_is_exact(llm):
    rnd = random.Random(1)
    values = [rnd.choice([rnd.gauss(0, 1), 0.25, -1e9, 1e-12 * rnd.random()]) for _ in range(500)]
    df = llm.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 130, 499, 500):
        assert quality.top_k(df, "v", k, bins=8) == sorted(values, reverse=True)[k - 1]
