"""I-Match fingerprints from terms within a band of inverse document frequency; DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from icuflow.functions.cut import cut

SUBSETS = 16
_BITS = 15  # a term has a number of so many bits for each randomised lexicon
_TERM = r"[\p{L}\p{N}]+"
_NONE = "-"
_SEGMENTS = 128
_HELD = 2000  # rows that one window orders, about
_BROADCAST = 1_000_000


def terms(text: Column) -> Column:
    """The distinct terms of a text: lower-case runs of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)))


def term_key(term: Column) -> Column:
    """60 bits of a term's hash."""
    return F.conv(F.substring(F.md5(term.cast("binary")), 1, 15), 16, 10).cast("long")


def scale(n_terms: Column) -> Column:
    """The s at which a lexicon that keeps one term in 2**s meets 0.75 to 1.5 terms of a text; -1 for a text without terms."""
    fit = F.length(F.bin(F.floor(n_terms * 4 / 3))) - 1
    return F.when(n_terms == 0, -1).otherwise(F.least(fit, F.lit(_BITS - 1)))


def factors() -> list[tuple[int, int]]:
    """For each randomised lexicon the odd factors, below 2**30, of the two halves of a term's 60 bits."""
    draw = [int.from_bytes(hashlib.md5(f"lexicon {r}".encode()).digest()[:8], "big") for r in range(SUBSETS)]
    return [(d % (1 << 30) | 1, (d >> 30) % (1 << 30) | 1) for d in draw]


def place_sql(a: object, b: object, shift: str = "shiftright({}, {})") -> str:
    """SQL: the number that places a term in a randomised lexicon, from the halves ``low`` and ``high`` of its 60 bits; the term is in the lexicon
    at scale s if the number is below 2**(15 - s)."""
    return shift.format(f"((low * {a} + high * {b}) & {(1 << 30) - 1})", 30 - _BITS)


def _ordered(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text, next (the following text in descending doc_id, null for the last of a bucket) and place.

    place is 2**32 times the bucket's number plus the row's number in it. Buckets are ranges of ids of about ``_HELD`` rows:
    equal parts of the ranges between quantiles, so at uneven ids too none holds more than a share of 1 / 128. An id that fills
    such a range alone, and rows without id, are divided by the text's hash.
    """
    n, points, low, high = docs.agg(
        F.count(F.lit(1)), F.percentile_approx("doc_id", [i / _SEGMENTS for i in range(1, _SEGMENTS)], 10_000), F.min("doc_id"), F.max("doc_id")
    ).first()
    points = sorted(set(points or []) | {p for p in (high,) if p is not None})
    parts = max(1, -(-n // (_SEGMENTS * _HELD)))
    lows = [low, *[p + 1 for p in points]][: len(points)]
    segment = F.size(F.filter(F.array(*[F.lit(p) for p in points]).cast("array<bigint>"), lambda p: p < F.col("doc_id")))
    ranges = [F.struct(F.lit(float(a)).alias("low"), F.lit((b - a + 1.0) / parts).alias("width"), F.lit(a == b).alias("one")) for a, b in zip(lows, points, strict=True)]
    found = F.element_at(F.array(*ranges), segment + 1) if points else F.lit(None).cast("struct<low:double,width:double,one:boolean>")
    rows = docs.withColumn("tie", F.md5(F.col("text").cast("binary"))).withColumn("range", F.when(F.col("doc_id").isNotNull(), found))
    by_hash = F.floor(F.conv(F.substring("tie", 1, 7), 16, 10).cast("long") * parts / (1 << 28))
    by_id = F.least(F.floor((F.col("doc_id").cast("double") - F.col("range.low")) / F.col("range.width")), F.lit(parts - 1))
    inside = F.when(F.col("range.one") | F.col("doc_id").isNull(), by_hash).otherwise(parts - 1 - by_id)
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(len(points))).otherwise(len(points) - 1 - segment) * parts + inside)
    order = W.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "tie")
    rows = rows.select("doc_id", "text", F.lead("text").over(order).alias("next"), "bucket", F.row_number().over(order).alias("row"))
    return rows.select("doc_id", "text", "next", (F.shiftleft(F.col("bucket").cast("long"), 32) + F.col("row")).alias("place")), parts


def _next_bucket(buckets: DataFrame, parts: int) -> DataFrame:
    """bucket, following: the next bucket that has rows, after the last the first. Windows run over one segment, then over segments."""
    rows = buckets.withColumn("segment", F.floor(F.col("bucket") / parts))
    inside = rows.withColumn("following", F.lead("bucket").over(W.partitionBy("segment").orderBy("bucket")))
    heads = rows.groupBy("segment").agg(F.min("bucket").alias("head"))
    heads = heads.select("segment", F.lead("head").over(W.orderBy("segment")).alias("later"), F.min("head").over(W.partitionBy(F.lit(0))).alias("least"))
    return inside.join(heads, "segment").select("bucket", F.coalesce("following", "later", "least").alias("following"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by the beginning of the following one."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - third), F.substring(following, F.lit(1), third))


def _sampled(texts: DataFrame, *kept: str) -> DataFrame:
    """Of the rows place, side, text: place, side, key, mask, and on one row of each text its facts, null on the others.

    mask has a bit for each randomised lexicon that has the term, at the text's scale and, 16 bits on, at the next. The hash of
    a term alone decides. Terms of no such lexicon are left out.
    """
    facts = [F.col(c) for c in kept]
    rows = texts.select("place", "side", *facts, terms(F.col("text")).alias("terms"), F.md5(F.col("text").cast("binary")).alias("plain"))
    rows = rows.withColumn("n_terms", F.size("terms"))
    rows = rows.withColumn("scale", scale(F.col("n_terms")))
    limit = [F.expr(f"shiftright({1 << _BITS}, greatest(scale, 0) + {level})").alias(f"limit_{level}") for level in (0, 1)]
    rows = rows.select("place", "side", *kept, "plain", "scale", *limit, F.posexplode_outer("terms").alias("at", "term"))
    # A generator of one row keeps the filter above the hash, which is made once for each term.
    rows = rows.select("*", F.explode(F.array(term_key(F.col("term")))).alias("key")).drop("term")
    rows = rows.select("*", F.inline(F.array(F.struct((F.col("key") % (1 << 30)).alias("low"), F.shiftright("key", 30).alias("high")))))
    rows = rows.filter(f"least({', '.join(place_sql(a, b) for a, b in factors())}) < limit_0 OR coalesce(at, 0) = 0")
    each = place_sql(*[f"array({', '.join(f'{x[i]}L' for x in factors())})[r]" for i in (0, 1)])
    mask = f"aggregate(sequence(0, {SUBSETS - 1}), 0L, (m, r) -> m + IF({each} < limit_0, shiftleft(1L, r), 0L) + IF({each} < limit_1, shiftleft(1L, r + {SUBSETS}), 0L))"
    rows = rows.withColumn("mask", F.when(F.col("key").isNull(), 0).otherwise(F.expr(mask)))
    one = lambda c: F.when(F.coalesce("at", F.lit(0)) == 0, F.col(c)).alias(c)
    return rows.select("place", "side", F.when(F.col("mask") > 0, F.col("key")).alias("key"), "mask", one("scale"), one("plain"), *[one(c) for c in kept])


def document_frequency(docs: DataFrame) -> DataFrame:
    """Stored rows key, df: in how many documents each term occurs."""
    words = docs.select(F.explode(terms(F.col("text"))).alias("term")).select(term_key(F.col("term")).alias("key"))
    return cut(words.groupBy("key").agg(F.count(F.lit(1)).alias("df")), "terms")


def _chosen(side: int) -> Column:
    """The sampled terms of a text that are in the band, else all of them, in order."""
    inside = F.filter(f"terms_{side}", lambda t: t["band"])
    return F.array_sort(F.when(F.size(inside) > 0, inside).otherwise(F.col(f"terms_{side}")))


def _print(side: int) -> Column:
    """scale, the hashes of a text's sorted terms in each randomised lexicon at both scales, and the fingerprint as a string."""
    mine = f"filter(chosen_{side}, t -> shiftright(t.mask, r) % 2 = 1)"
    listed = f"substring(md5(array_join(transform({mine}, t -> string(t.key)), ',')), 1, 6)"
    fine, coarse = (
        F.expr(f"transform(sequence({base}, {base + SUBSETS - 1}), r -> IF(size({mine}) = 0, '{_NONE}', {listed}))") for base in (0, SUBSETS)
    )
    return F.struct(F.col(f"scale_{side}").alias("scale"), fine.alias("fine"), coarse.alias("coarse"), F.col(f"plain_{side}").alias("plain"))


def _shown(x: Column) -> Column:
    listed = F.concat_ws(":", x["scale"], F.array_join(x["fine"], "."), F.array_join(x["coarse"], "."))
    return F.when(x["scale"] < 0, F.concat(F.lit("text:"), x["plain"])).otherwise(listed)


def likeness(a: Column, b: Column) -> Column:
    """Of the lexicons that either text has terms of, at the scales both have, the share in which their hashes agree; 1 for equal fingerprints."""
    pair = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    pairs = (
        F.when(a["scale"] == b["scale"], F.zip_with(F.concat(a["fine"], a["coarse"]), F.concat(b["fine"], b["coarse"]), pair))
        .when(a["scale"] == b["scale"] + 1, F.zip_with(a["fine"], b["coarse"], pair))
        .when(a["scale"] + 1 == b["scale"], F.zip_with(a["coarse"], b["fine"], pair))
    )
    some = F.filter(pairs, lambda x: (x["p"] != _NONE) | (x["q"] != _NONE))
    same = F.size(F.filter(some, lambda x: x["p"] == x["q"]))
    return F.when(_shown(a) == _shown(b), 1.0).when(F.size(some) > 0, F.round(same / F.size(some), 6)).otherwise(0.0)


def fingerprints(docs: DataFrame, bits: int = 5, least: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A term is in the band if it occurs in ``least`` documents or more and its inverse document frequency is at least ``bits`` bits
    (in at most one document of 2**bits); frequencies count all documents. ``SUBSETS`` randomised lexicons
    keep one term in 2**s, at the scale s that suits the number of a text's terms and at s + 1. A fingerprint is
    ``s:hashes at s:hashes at s + 1``, of the sorted terms of the text in each lexicon, ``-`` where it has none. Where no sampled term is
    in the band, all of them count; a text without terms shows a hash of itself. So equal texts have equal fingerprints.

    The edited text ends with the beginning of the next document in descending doc_id (edited, next); after
    the last comes the first. Null texts are empty. Rows without id come last; rows of one id are ordered by their text's
    md5; each stands for itself, and rows alike in both are interchangeable. An empty table gives no rows. Other columns are not read. A text
    of any length is read whole.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered, parts = _ordered(docs)
    head = F.when(F.col("place") % (1 << 32) == 1, F.col("text"))
    last = F.when(F.col("next").isNull(), F.col("text"))
    changed = edited(F.col("text"), F.col("next"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("text")), F.struct(F.lit(1).alias("side"), F.col("changed").alias("text")))
    rows = ordered.select("place", "doc_id", F.char_length("text").cast("long").alias("n_chars"), head.alias("head"), last.alias("last"), "text", changed.alias("changed"))
    rows = rows.select("place", "doc_id", "n_chars", "head", "last", F.sha2("changed", 256).alias("sha"), F.explode(sides).alias("part"))
    rows = rows.filter("part.text IS NOT NULL").select(
        "place", "part.side", "part.text", "doc_id", "n_chars", *[F.when(F.col("part.side") == 0, F.col(c)).alias(c) for c in ("head", "last")], "sha"
    )
    stored = cut(_sampled(rows, "doc_id", "n_chars", "head", "last", "sha"), "sampled")

    bucket = F.shiftright("place", 32)
    heads = stored.filter("head IS NOT NULL").select(bucket.alias("bucket"), "head")
    following = cut(_next_bucket(heads.select("bucket"), parts), "buckets")
    tails = stored.filter("last IS NOT NULL").select("place", "doc_id", "n_chars", "last", bucket.alias("bucket"))
    tails = tails.join(following, "bucket").join(heads.withColumnRenamed("bucket", "following"), "following")
    tails = tails.select("place", F.lit(1).alias("side"), edited(F.col("last"), F.col("head")).alias("text"), "doc_id", "n_chars")
    tails = _sampled(tails.withColumn("sha", F.sha2("text", 256)), "doc_id", "n_chars", "sha")
    # Each bucket also gets the first row of the following one, so that every row finds the next.
    rows = stored.drop("head", "last").unionByName(tails).withColumn("guest", F.lit(False))
    firsts = stored.filter(f"side = 0 AND place % {1 << 32} = 1").drop("head", "last").withColumn("following", bucket)
    firsts = firsts.join(following, "following").withColumn("place", F.shiftleft("bucket", 32) + ((1 << 32) - 1)).withColumn("guest", F.lit(True))
    rows = rows.unionByName(firsts.select(*rows.columns))

    n = docs.count()
    counts = document_frequency(docs)
    common = counts.filter(F.col("df") * (1 << bits) > n).select("key", F.lit(True).alias("common"))
    if common.count() <= _BROADCAST:  # at most 2**bits times the terms of a mean document
        common = F.broadcast(common)
    rows = rows.join(common, "key", "left")
    band = counts.filter((F.col("df") >= least) & (F.col("df") * (1 << bits) <= n)).select("key", F.lit(True).alias("band"))
    asked = rows.filter("mask > 0 AND common IS NULL").join(band, "key", "left")
    rows = asked.unionByName(rows.filter("mask = 0 OR common").withColumn("band", F.lit(None).cast("boolean")))

    term = F.struct("key", "mask", F.coalesce("band", F.lit(False)).alias("band"))
    rows = rows.withColumn("bucket", bucket).repartition("bucket")
    facts = [F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{c}_{side}") for side in (0, 1) for c in ("scale", "plain")]
    made = rows.groupBy("bucket", "place").agg(
        F.max("guest").alias("guest"),
        *[F.max(c).alias(c) for c in ("doc_id", "n_chars", "sha")],
        *facts,
        *[F.collect_list(F.when((F.col("mask") > 0) & (F.col("side") == side), term)).alias(f"terms_{side}") for side in (0, 1)],
    )
    made = made.select("*", *[_chosen(side).alias(f"chosen_{side}") for side in (0, 1)])
    made = made.select("bucket", "place", "doc_id", "n_chars", "sha", "guest", *[_print(side).alias(f"print_{side}") for side in (0, 1)])
    following = F.lead("print_0").over(W.partitionBy("bucket").orderBy("place"))
    made = made.select("doc_id", "n_chars", "sha", "guest", "print_0", "print_1", following.alias("print_2")).filter("NOT guest")
    return made.select(
        "doc_id",
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        _shown(F.col("print_0")).alias("fingerprint"),
        _shown(F.col("print_1")).alias("edited_fingerprint"),
        likeness(F.col("print_0"), F.col("print_1")).alias("near_edited"),
        likeness(F.col("print_0"), F.col("print_2")).alias("near_next"),
    )
