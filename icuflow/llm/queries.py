"""The registered queries of the subpackage: each operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icuflow.llm import bpe, decontamination, exact_dedup, imatch, jaccard_join, language_id, license_scan, periodic, pii, quality, spelling, token_counts, toxicity
from icuflow.llm.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, root: str) -> DataFrame:
        prepare(spark)
        return fn(spark, root)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


@query
def op1_jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    return jaccard_join.similar(table(spark, root, "documents"), jaccard_join.Rule(3, 90, 100))


SQL["op1_jaccard_join"] = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + least(3, len(w)) - 1), ' ') AS g
  FROM doc, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS u(s) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id <> b.doc_id
       JOIN size x ON x.doc_id = a.doc_id JOIN size y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM doc
  UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT doc.doc_id, coalesce(size.n, 0) AS n_shingles, r.low AS component_id
FROM doc JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = doc.doc_id LEFT JOIN size ON size.doc_id = doc.doc_id
"""


@query
def op2_pii(spark: SparkSession, root: str) -> DataFrame:
    found = pii.private_spans(table(spark, root, "documents"))
    names = F.array(*[F.lit(k) for k in (*pii.KINDS, "term")])
    show = lambda m: F.concat_ws(":", F.element_at(names, m["kind"] + 1), m["start"], m["end"])
    # A second argument of the lambda would be the place in the array, so the kind comes from around it.
    of = lambda i: F.size(F.filter("base", lambda m: m["kind"] == i)).cast("long")
    counts = [of(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(len(pii.KINDS)).alias("kind"), t["end"].alias("end")))
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.concat_ws(",", F.transform("base", show)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform(F.array_sort(F.concat("base", terms)), show)).alias("spans"),
    )


@query
def op3_language_id(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return language_id.identify(docs, language_id.train(docs))


@query
def op4_token_counts(spark: SparkSession, root: str) -> DataFrame:
    return token_counts.token_counts(table(spark, root, "documents"), tokenizer_path())


@query
def op5_license_scan(spark: SparkSession, root: str) -> DataFrame:
    found = license_scan.license_spans(table(spark, root, "documents"))
    show = lambda x: F.concat_ws(":", x["license"], x["coverage"], x["start"], x["end"])
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_found"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["coverage"])), F.lit(0.0)).alias("coverage"),
        F.concat_ws(",", F.transform("found", show)).alias("spans"),
    )


@query
def op6_toxicity(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, root, "labels")))


@query
def op7_decontamination(spark: SparkSession, root: str) -> DataFrame:
    found = decontamination.contamination(table(spark, root, "documents"), table(spark, root, "benchmark"))
    hits = decontamination.n_hit(F.col("spans"))
    items = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


SQL["op7_decontamination"] = r"""
WITH doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
item_window AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(list_slice(w, s, s + least(10, len(w)) - 1), ' ') AS words
  FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(s) WHERE len(w) > 0),
size AS (SELECT DISTINCT size FROM item_window),
doc_window AS (
  SELECT doc_id, s, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS words
  FROM doc, size, unnest(range(1, len(w) - size + 2)) AS u(s) WHERE len(w) >= size),
hit AS (SELECT doc_id, s, size, item_id FROM doc_window JOIN item_window USING (size, words)),
word AS (SELECT doc_id, count(DISTINCT s + k) AS n FROM (SELECT DISTINCT doc_id, s, size FROM hit), unnest(range(0, size)) AS u(k) GROUP BY doc_id),
owner AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(word.n, 0) AS n_hit, coalesce(owner.n, 0) AS n_items,
       sha256(coalesce(owner.items, '')) AS items_sha256, coalesce(word.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN word ON word.doc_id = doc.doc_id LEFT JOIN owner ON owner.doc_id = doc.doc_id
"""


@query
def op8_bpe(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    path = tokenizer_path()
    coded = bpe.encode(docs, path).drop("text")
    return bpe.decode(coded, path).select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_exact_dedup(spark: SparkSession, root: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, root, "documents"))
    return found.withColumn("text_sha256", F.lower(F.hex("text_sha256")))


SQL["op9_exact_dedup"] = r"""
WITH plain AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM plain WINDOW same AS (PARTITION BY t)
"""


@query
def op10_quality(spark: SparkSession, root: str) -> DataFrame:
    return quality.resample(table(spark, root, "documents"), table(spark, root, "labels"))


@query
def op11_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    return imatch.fingerprints(table(spark, root, "documents"))


SQL["op11_fingerprints"] = rf"""
WITH ordered AS (
  SELECT row_number() OVER o AS place, doc_id, text, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, md5(text))),
part AS (
  SELECT place, 0 AS side, text FROM ordered
  UNION ALL SELECT place, 1, text[:length(text) - length(text) // 3] || next[:length(text) // 3] FROM ordered),
listed AS (SELECT place, side, text, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS terms FROM part),
scaled AS (
  SELECT place, side, text, terms, CASE WHEN len(terms) = 0 THEN -1 ELSE least(14, length(bin(len(terms) * 4 // 3)) - 1) END AS scale FROM listed),
term AS (
  SELECT place, side, scale, ('0x' || md5(t)[:15])::BIGINT AS key FROM (SELECT place, side, scale, unnest(terms) AS t FROM scaled)),
placed AS (
  SELECT *, [{', '.join(imatch.place_sql(a, b, '{} >> {}') for a, b in imatch.factors())}] AS places FROM (SELECT *, key % 1073741824 AS low, key >> 30 AS high FROM term)),
frequency AS (SELECT key, count(*) AS df FROM term WHERE side = 0 GROUP BY key),
sampled AS (
  SELECT place, side, level, r, term.key, coalesce(df >= 2 AND df * 32 <= (SELECT count(*) FROM ordered), false) AS band
  FROM placed term LEFT JOIN frequency ON frequency.key = term.key, (VALUES (0), (1)) AS l(level), range(16) AS u(r)
  WHERE places[r + 1] < 1 << (15 - scale - level)),
chosen AS (SELECT *, bool_or(band) OVER (PARTITION BY place, side) AS any_band FROM sampled),
signature AS (
  SELECT place, side, level, r, md5(string_agg(CAST(key AS VARCHAR), ',' ORDER BY key))[:6] AS sig
  FROM chosen WHERE band OR NOT any_band GROUP BY ALL),
print AS (
  SELECT s.place, s.side, any_value(s.scale) AS scale, any_value(s.text) AS text,
         list(coalesce(sig, '-') ORDER BY u.r) FILTER (l.level = 0) AS fine, list(coalesce(sig, '-') ORDER BY u.r) FILTER (l.level = 1) AS coarse
  FROM scaled s CROSS JOIN (VALUES (0), (1)) AS l(level) CROSS JOIN range(16) AS u(r)
       LEFT JOIN signature g ON g.place = s.place AND g.side = s.side AND g.level = l.level AND g.r = u.r GROUP BY s.place, s.side),
shown AS (
  SELECT *, CASE WHEN scale < 0 THEN 'text:' || md5(text) ELSE concat_ws(':', scale, array_to_string(fine, '.'), array_to_string(coarse, '.')) END AS shown FROM print),
pair AS (
  SELECT a.place, b.side, a.shown = b.shown AS same,
         CASE WHEN a.scale = b.scale THEN list_zip(a.fine || a.coarse, b.fine || b.coarse) WHEN a.scale = b.scale + 1 THEN list_zip(a.fine, b.coarse)
              WHEN a.scale + 1 = b.scale THEN list_zip(a.coarse, b.fine) ELSE [] END AS zipped
  FROM shown a JOIN shown b ON a.side = 0 AND (b.place = a.place AND b.side = 1
       OR b.side = 0 AND b.place = a.place % (SELECT count(*) FROM ordered) + 1)),
likeness AS (
  SELECT place, side, CASE WHEN same THEN 1.0::DOUBLE WHEN len(used) = 0 THEN 0.0::DOUBLE
         ELSE round(len(list_filter(used, lambda x: x[1] = x[2]))::DOUBLE / len(used), 6) END AS likeness
  FROM (SELECT place, side, same, list_filter(zipped, lambda x: x[1] <> '-' OR x[2] <> '-') AS used FROM pair))
SELECT o.doc_id, length(o.text) AS n_chars, sha256(b.text) AS edited_sha256, a.shown AS fingerprint, b.shown AS edited_fingerprint,
       x.likeness AS near_edited, y.likeness AS near_next
FROM ordered o JOIN shown a ON a.place = o.place AND a.side = 0 JOIN shown b ON b.place = o.place AND b.side = 1
     JOIN likeness x ON x.place = o.place AND x.side = 1 JOIN likeness y ON y.place = o.place AND y.side = 0
"""


def replanted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents repeat a part of their words to the end; a null id is never among them."""

    def repeat(i: int | None, text: bytes) -> bytes:
        h = zlib.crc32(str(i).encode())
        if i is None or h % 10:
            return text
        words = text.split()
        if not words:
            return text
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join(words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [repeat(i.as_py(), bytes(t.as_buffer()) if t.is_valid else b"") for i, t in zip(*batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string")


@query
def op12_periodic(spark: SparkSession, root: str) -> DataFrame:
    found = periodic.periodic_runs(replanted(table(spark, root, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumn("longest", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"], F.lit("\n")))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_spelling(spark: SparkSession, root: str) -> DataFrame:
    return spelling.variants(table(spark, root, "documents"))


#: crc32 byte by byte; its table follows from the polynomial. The letters beyond ASCII have two bytes, 195 and their number less 64.
SQL["op13_spelling"] = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(list_reduce([CAST(b AS UBIGINT)] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM range(256) u(b)),
seen AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
        FROM documents)
  GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(list_reduce([4294967295::UBIGINT] || flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
           lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::UBIGINT] ELSE [195::UBIGINT, (ord(c) - 64)::UBIGINT] END)),
           lambda c, b: xor(c >> 8, t[1 + xor(c % 256, b)::BIGINT])), 4294967295) AS h
  FROM seen, crc),
word AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN run[:(h % length(run))::BIGINT] || run[(h % length(run))::BIGINT + 2:] ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
part AS (SELECT DISTINCT word, i, word[:i] || word[i + 2:] AS rest FROM word, unnest(range(0, length(word))) u(i)),
near AS (
  SELECT a.word, b.word AS other FROM part a JOIN part b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT part.word, word.word FROM part JOIN word ON word.word = rest
  UNION SELECT word.word, part.word FROM part JOIN word ON word.word = rest),
best AS (
  SELECT near.word, count(*) AS n_near, min_by(other, (-o.n, other)) AS other, max(o.n) AS other_n
  FROM near JOIN word o ON o.word = near.other GROUP BY near.word),
form AS (SELECT word.word, other AS form, other_n AS form_n FROM word JOIN best ON best.word = word.word WHERE other_n >= 10 * n),
chain AS (SELECT word, form AS root FROM form UNION ALL SELECT chain.word, form.form FROM chain JOIN form ON form.word = chain.root)
SELECT word.word, form.form, coalesce(last.root, word.word) AS root, word.n, coalesce(best.n_near, 0) AS n_near, form.form_n
FROM word LEFT JOIN best ON best.word = word.word LEFT JOIN form ON form.word = word.word
     LEFT JOIN (SELECT chain.word, chain.root FROM chain LEFT JOIN form ON form.word = chain.root WHERE form.word IS NULL) last ON last.word = word.word
"""
