import random

import corpus_pipeline
from icuflow.llm import bpe
from icuflow.llm.queries import QUERIES, SQL, tokenizer_path

WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "pa", "ri", "so") for b in ("ban", "der", "kol", "mer", "nix", "ter")]


def tables(llm, folder):
    """Clean texts, junk, copies, near copies and leaks, and the ids that must be left."""
    rnd = random.Random(9)
    clean = {i: " ".join(rnd.choices(WORDS, k=80)).capitalize() + "." for i in range(60)}
    docs = dict(clean)
    items = [(i, " ".join(rnd.choices(WORDS, k=14))) for i in range(3)]
    for i in range(5):
        docs[100 + i] = clean[i].replace(" ", "\n")  # equal after normalisation
        near = clean[10 + i].split()
        near[40] = "changed"
        docs[110 + i] = " ".join(near)
        docs[120 + i] = clean[20 + i] + " " + items[i % 3][1].upper().replace(" ", ", ")
        docs[130 + i] = " ".join(w.upper() + "!!" for w in rnd.choices(WORDS, k=80))
        docs[140 + i] = " | ".join(rnd.choices(WORDS, k=80))
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(200, None, None, None, None), (201, " ", "en", "s", 1), (5, clean[5], "en", "s", 1)]
    frame = llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS selected", "1 AS n_words", "'y' AS _kept")
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(i, 0, 0) for i in range(130, 145)]
    llm.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    llm.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, sorted(clean)


def test_run_leaves_the_clean_documents(llm, tmp_path):
    docs, left = tables(llm, str(tmp_path))
    found = corpus_pipeline.run(llm, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in found) == left
    decoder = bpe.Decoder(tokenizer_path())
    assert all(r["exact"] and decoder.decode([r["token_ids"]]) == [docs[r["doc_id"]]] for r in found)
    assert all(r["n_tokens"] * 4 == len(r["token_ids"]) for r in found)


def test_stages_keep_the_columns_and_survive_empty_tables(llm, tmp_path):
    tables(llm, str(tmp_path))
    docs = llm.read.parquet(f"{tmp_path}/documents.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(llm, empty, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](llm, empty, str(tmp_path)).count() == 0


def test_rows_without_id_or_with_a_shared_id_are_judged_by_their_text(llm, tmp_path):
    tables(llm, str(tmp_path))
    rnd = random.Random(5)
    good = [" ".join(rnd.choices(WORDS, k=80)).capitalize() + "." for _ in range(6)]
    junk = " | ".join(rnd.choices(WORDS, k=80))
    leak = good[5] + " " + llm.read.parquet(f"{tmp_path}/benchmark.parquet").first()["text"]

    def near(text):
        return " ".join(w if i != 40 else "changed" for i, w in enumerate(text.split()))

    rows = [
        (None, good[0]), (None, near(good[0])), (None, junk), (None, None),  # of the first two one stays
        (None, near(good[1])), (1000, good[1]),  # the one with an id stays
        (7000, good[2]), (7000, good[3]), (7000, junk), (7000, leak),
        (-3, near(good[4])), (500, good[4]),  # the smallest id stays
    ]
    docs = llm.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _row string")
    docs = docs.union(llm.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("doc_id", "text", "'x'")).repartition(3)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = llm.createDataFrame(stage(llm, docs, str(tmp_path)).collect(), docs.schema)
        kept[name] = {(r["doc_id"], r["text"]) for r in docs.collect()} & set(rows)
    assert kept["quality classifier"] == kept["exact dedup"] == {r for r in rows if r[1] not in (None, junk)}
    gone = {(None, near(good[1])), (500, good[4])}
    left = kept["exact dedup"] - gone - kept["n-gram jaccard join"]
    assert len(left) == 1 and left < {(None, good[0]), (None, near(good[0]))}
    assert not gone & kept["n-gram jaccard join"]
    assert kept["benchmark decontamination"] == kept["n-gram jaccard join"] - {(7000, leak)}


def test_every_query_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES) and corpus_pipeline.ORACLE_SQL is None
