"""Personal data by patterns, and terms that reveal it by information theory; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from icuflow.functions.cut import cut

# The kinds in the order in which they are listed, and their patterns. Possessive repeats and
# the look-behinds change no match: they keep the search linear and off the stack in long runs.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain for a kind to be worth a search.
HINTS = {"email": "[.]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9 -]{10,}[0-9]", "phone": r"\+[0-9][ ().0-9-]{8}"}
_SIGNS = {"email": "@", "ip": ".", "phone": "+"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_BLOCK = 64


def running(lengths: str) -> str:
    """SQL: for each entry of an array column, the sum of those before it; in blocks, so long arrays stay cheap."""
    bases = (
        f"aggregate(transform(sequence(0, size({lengths}) div {_BLOCK}), b -> aggregate(slice({lengths}, int(b * {_BLOCK} + 1), {_BLOCK}), 0L, (s, x) -> s + x)),"
        " array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    )
    return f"transform({lengths}, (x, i) -> {bases}[i div {_BLOCK}] + aggregate(slice({lengths}, int(i div {_BLOCK} * {_BLOCK} + 1), int(i % {_BLOCK})), 0L, (s, y) -> s + y))"


def _matches(text: Column, kind: str) -> tuple[Column, Column]:
    """All matches of a kind, and the pieces between them; empty where there is none."""
    there = text.rlike(HINTS[kind])
    if kind in _SIGNS:
        there = (F.instr(text, _SIGNS[kind]) > 0) & there
    hits = F.when(there, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(F.array().cast("array<string>"))
    gaps = F.when(there, F.split(text, PATTERNS[kind], -1)).otherwise(F.array().cast("array<string>"))
    return hits, gaps


def valid(kind: Column, hit: Column) -> Column:
    """Whether a match keeps the rule of its kind."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)

    def luhn(s: Column, i: Column) -> Column:
        digit = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 1, digit).when(digit > 4, digit * 2 - 9).otherwise(digit * 2)

    card = F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), luhn) % 10 == 0).otherwise(False)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", hit.rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$"))
        .when(kind == "card", card)
        .otherwise(n.between(9, 15))
    )


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, mentions (kind number, start, end, value), and of texts that have any, the text with emails blanked."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = []
    for kind in KINDS:
        hits, gaps = _matches(F.col("text"), kind)
        made += [hits.alias(f"{kind}_hits"), gaps.alias(f"{kind}_gaps")]
    df = df.select("doc_id", "text", *made)
    lengths = [
        F.expr(f"transform({k}_hits, (h, i) -> bigint(char_length({k}_gaps[i]) + char_length(h)))").alias(f"{k}_steps") for k in KINDS
    ]
    df = df.select("*", *lengths)
    df = df.select("doc_id", "text", *[F.col(f"{k}_hits") for k in KINDS], *[F.col(f"{k}_gaps") for k in KINDS], *[F.expr(f"IF(size({k}_steps) = 0, {k}_steps, {running(f'{k}_steps')})").alias(f"{k}_before") for k in KINDS])
    found = [
        F.expr(
            f"transform({k}_hits, (h, i) -> named_struct('start', {k}_before[i] + char_length({k}_gaps[i]), 'kind', {n},"
            f" 'end', {k}_before[i] + char_length({k}_gaps[i]) + char_length(h), 'value', h))"
        )
        for n, k in enumerate(KINDS)
    ]
    names = F.array(*[F.lit(k) for k in KINDS])
    blanked = F.expr("array_join(transform(email_gaps, (g, i) -> concat(g, repeat(' ', coalesce(char_length(get(email_hits, i)), 0)))), '')")
    df = df.select("doc_id", "text", F.when(F.size("email_hits") > 0, blanked).otherwise(F.col("text")).alias("rest"), F.concat(*found).alias("found"))
    df = df.select("doc_id", "text", "rest", F.array_sort(F.filter("found", lambda m: valid(F.element_at(names, m["kind"] + 1), m["value"]))).alias("found"))
    listed = F.transform("found", lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), F.lower(m["value"]).alias("value")))
    return df.select("doc_id", F.xxhash64("text").alias("text_hash"), F.when(F.size("found") > 0, F.col("rest")).alias("rest"), listed.alias("mentions"))


_TERM = r"\p{L}{3,}"


def _occurrences(held: DataFrame) -> DataFrame:
    """Stored rows doc, term, start, size of every word of the texts; repeated rows of a document count once."""
    cut_up = held.select("doc", F.regexp_extract_all("rest", F.lit(_TERM), F.lit(0)).alias("words"), F.split("rest", _TERM, -1).alias("gaps"))
    listed = F.expr("transform(words, (w, i) -> named_struct('term', xxhash64(lower(w)), 'size', char_length(w), 'gap', char_length(gaps[i])))")
    # The rows are dealt by document once, which serves the removal of repeats and the running sum.
    rows = cut_up.select("doc", F.posexplode(listed).alias("i", "w")).select("doc", "i", "w.*").repartition("doc").distinct()
    before = W.partitionBy("doc").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    start = F.sum(F.col("gap") + F.col("size")).over(before) - F.col("size")
    return cut(rows.select("doc", "term", start.alias("start"), "size"), "occurrences")


def _set_of(column: str) -> list[Column]:
    """Two sums of hashes that tell sets of documents apart; each stays in a long for four thousand million documents."""
    return [F.sum(F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 31))) for seed in (1, 2)]


def revealing_terms(docs: DataFrame, held: DataFrame, words: DataFrame, text_col: str, smooth: float, generalise: float, remove: float) -> DataFrame:
    """Stored rows doc, term, action: the terms that reveal an entity that the document mentions.

    p(entity | term) is the number of documents that hold both, over those that hold the term, the latter with ``smooth``
    added, so that few documents prove less than many. The entity's information content is IC = -log2 of its share of
    all documents, and IC + log2 p(entity | term) is how much of it the term gives away. From ``generalise`` times
    IC on the term is generalised, from ``remove`` times IC on it is removed.

    A term in more documents than an entity's limit cannot reveal it, which leaves rare terms beside rare entities.
    Entities of the same documents are judged as one, and so are terms, so a document of many single
    entities and many single words gives one pair.
    """
    total = float(max(docs.count(), 1))
    weights = held.groupBy("doc").agg(F.count(F.lit(1)).alias("m"))
    each = held.select("doc", F.explode("mentions").alias("x")).select("doc", F.xxhash64("x.kind", "x.value").alias("entity")).distinct().join(weights, "doc")
    e1, e2 = _set_of("doc")
    content = F.log2(F.lit(total) / F.col("n_entity"))
    entities = each.groupBy("entity").agg(F.sum("m").alias("n_entity"), e1.alias("e1"), e2.alias("e2"))
    entities = entities.withColumn("ic", content).withColumn("most", F.col("n_entity") * F.pow(F.lit(2.0), F.lit(1 - generalise) * F.col("ic")) - smooth)
    entity_sets = cut(each.join(entities, "entity").select("doc", "m", "n_entity", "e1", "e2", "ic", "most").distinct(), "entity-sets")
    most = entity_sets.agg(F.coalesce(F.max("most"), F.lit(0.0))).first()[0]

    found = F.transform(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(_TERM), F.lit(0)), lambda w: F.xxhash64(F.lower(w)))
    counts = docs.select(F.explode(F.array_distinct(found)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).filter(F.col("n_term") <= most)
    own = words.select("doc", "term").distinct()
    t1, t2 = _set_of("doc")
    terms = own.groupBy("term").agg(t1.alias("t1"), t2.alias("t2")).join(counts, "term")
    own = cut(own.join(terms, "term"), "rare-terms")
    term_set, entity_set = ["n_term", "t1", "t2"], ["n_entity", "e1", "e2"]
    pairs = cut(own.select("doc", *term_set).distinct().join(entity_sets, "doc").filter("n_term <= most"), "pairs")
    given = F.col("ic") + F.log2(F.col("both") / (F.col("n_term") + F.lit(smooth)))
    scored = pairs.groupBy(*term_set, *entity_set, "ic").agg(F.sum("m").alias("both"))
    level = F.when(given >= remove * F.col("ic"), 2).when(given >= generalise * F.col("ic"), 1)
    scored = scored.withColumn("level", level).filter("level IS NOT NULL").select(*term_set, *entity_set, "level")
    marked = pairs.join(scored, [*term_set, *entity_set]).groupBy("doc", *term_set).agg(F.max("level").alias("level"))
    action = F.when(F.col("level") == 2, "remove").otherwise("generalise")
    return cut(own.join(marked, ["doc", *term_set]).select("doc", "term", action.alias("action")), "revealing")


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", smooth: float = 0.5, generalise: float = 0.9, remove: float = 0.97) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, base and terms, both arrays of spans in order.

    base: struct start, kind (number in KINDS), end of every valid match, in code points, end exclusive.
    terms: struct start, end, action of every occurrence of the terms that reveal an entity which the document mentions,
    however far from it; see ``revealing_terms``. A term is a run of three letters or more, in lower case; those inside
    an email are none. Null counts as empty; texts without matches have empty arrays. Repeated rows are
    judged alike, and each counts as evidence. Rows without id are treated like others, and told apart by
    their text. Nothing is taken from other columns. An empty table gives no rows.
    """
    base = mentions(docs, id_col, text_col).withColumn("doc", F.xxhash64("doc_id", "text_hash"))
    base = cut(base, "mentions")
    held = base.filter(F.size("mentions") > 0)
    words = _occurrences(held)
    terms = revealing_terms(docs, held, words, text_col, smooth, generalise, remove)
    spans = F.struct("start", (F.col("start") + F.col("size")).alias("end"), "action")
    found = words.join(terms, ["doc", "term"]).groupBy("doc").agg(F.array_sort(F.collect_list(spans)).alias("terms"))
    plain = F.transform("mentions", lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,action:string>>")
    return base.join(found, "doc", "left").select("doc_id", "text_hash", plain.alias("base"), F.coalesce("terms", empty).alias("terms"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id and the sanitised text: entities become [EMAIL], [IP], [CARD] or [PHONE], generalised terms [TERM], removed ones go.

    Of overlapping spans the first wins. Repeated rows of one doc_id and text appear once.
    """
    spans = private_spans(docs, id_col, text_col, **options).dropDuplicates(["doc_id", "text_hash"])
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    base = F.transform("base", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.element_at(marks, m["kind"] + 1).alias("by")))
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["action"] == "remove", "").otherwise("[TERM]").alias("by")))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.array_sort(F.concat(base, terms)).alias("spans"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    clean = """aggregate(spans, named_struct('at', 0L, 'out', ''),
        (s, x) -> IF(x.start < s.at, s, named_struct('at', x.end, 'out', concat(s.out, substring(text, int(s.at + 1), int(x.start - s.at)), x.by))),
        s -> concat(s.out, substring(text, int(s.at + 1))))"""
    return rows.join(spans, same).select("doc_id", F.expr(clean).alias("text"))
