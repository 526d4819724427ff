"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Four fixed patterns give the base spans. They and strictly shaped secrets are the seeds. Every identifier-like token (one with
a digit or an @, of any length) has a lexical pattern, the two words before it, however long or far away; patterns and the
identifiers they precede make a graph, a token standing for its first run of identifier characters with a digit or an @.
Identifiers without either are out of reach. A pattern's
confidence is the mean belief in its distinct identifiers, an identifier's belief 1 if it is a seed and else what its patterns
together lend it; some rounds of both follow. Patterns with enough distinct identifiers and confidence then mark the
identifiers after them that no base span covers, as spans of kind "id".

Positions come from what stands between the matches: a split by the same pattern, its lengths summed in a window for each
document, so the work is linear in the matches. Only matches are shuffled, never texts. Graph counts are summed before the
shuffle, and each pattern and identifier meet in one row.

Null and empty texts have no spans. Very long texts are read whole. Spans that start together come in the order of KINDS.
Repeated rows are found together and come out as often as they went in; rows that share
only a doc_id are kept apart by a hash of the text. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Kinds in their order; fixed values. The patterns are those of the contract, written so that no run of characters is
#: tried twice: a possessive run, begun only where the run begins or the last match ended.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SPACE = r"\x20\x09-\x0D"
CANDIDATE = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
#: Of a token, the first run of these characters with a digit or an @, from its first to its last letter or digit.
RUN = "A-Za-z0-9._:/+=@-"
CORE = f"(?<![{RUN}])[._:/+=@-]*+(?=[{RUN}]*[0-9@])([A-Za-z0-9](?:[{RUN}]*[A-Za-z0-9])?)"
#: Secrets of a strict shape, which join the seeds.
SECRET = "^(?=.*[0-9])[0-9A-Fa-f]{32,}$"
SEED, LEARNED = "candidate", "id"


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda sum_, i: sum_
        + F.when(i % 2 == 1, F.substr(digits, n - i + 1, F.lit(1)).cast("int")).otherwise(
            F.expr("0") + F.substr(digits, n - i + 1, F.lit(1)).cast("int") * 2 - F.when(F.substr(digits, n - i + 1, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.when(n.between(12, 19), total % 10 == 0).otherwise(False)


def valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    parts = F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 4) & (F.coalesce(F.try_to_number(F.right(F.concat(F.lit("0000"), p), F.lit(4)), F.lit("9999")), F.lit(0)) <= 255))
    return (
        F.when(kind == "ip", parts)
        .when(kind == "card", luhn(F.when(F.length(digits).between(12, 19), digits).otherwise(F.lit("1"))))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .otherwise(True)
    )


def _last_words(text: Column) -> Column:
    """The last two words of a text in lower case, white space on either side kept as one space."""
    words = F.split(F.lower(text), f"[{SPACE}]+")
    n = F.size(words)
    return F.array_join(F.slice(words, F.greatest(n - 3, F.lit(1)), 4), " ")


def _matches(text: Column, kind: str, pattern: str, may: Column) -> Column:
    """array<struct<kind, i, gap, before, match>>: gap is the length of what stands between the match before and this one, before
    (of tokens) its last two words."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    rows = F.zip_with(found, between, lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
    size = F.size(found)
    numbered = F.transform(F.slice(rows, 1, F.greatest(size, F.lit(1))), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), (_last_words(x["gap"]) if kind == SEED else F.lit("")).alias("before"), x["match"].alias("match")))
    return F.when(may & text.rlike(pattern), F.filter(numbered, lambda x: x["match"].isNotNull()))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), copies, kind, start, end, core, pattern, seed: a row for each base span and identifier-like
    token, and one with kind null for each distinct row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digit, token = text.rlike("[0-9]"), text.rlike("[0-9@]")
    kinds = "array<struct<kind:string,i:int,gap:int,before:string,match:string>>"
    may = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": digit & F.contains(text, F.lit("+"))}
    arrays = [F.coalesce(_matches(text, k, p, may[k]), F.array().cast(kinds)) for k, p in PATTERNS.items()]
    arrays.append(F.coalesce(_matches(text, SEED, CANDIDATE, token), F.array().cast(kinds)))
    none = F.array(F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("kind", "string"), ("i", "int"), ("gap", "int"), ("before", "string"), ("match", "string"))]))
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), F.explode(F.concat(none, *arrays)).alias("m")).select("doc_id", "h", "m.*")
    rows = rows.repartition("doc_id", "h")
    once = rows.groupBy("doc_id", "h", "kind", "i").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("gap", "before", "match")])
    order = Window.partitionBy("doc_id", "h", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("match")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    left = F.concat(*[F.coalesce(F.lag(c, k).over(order), F.lit("")) for k in (2, 1) for c in ("before", "match")], F.col("before"))
    core = F.regexp_extract("match", CORE, 1)
    once = once.withColumn("end", end).withColumn("left", left).withColumn("core", core)
    once = once.withColumn("start", F.col("end") - F.length("match"))
    is_token = F.col("kind") == SEED
    inner = F.col("start") + F.instr("match", F.col("core")) - 1
    words = F.filter(F.split(F.lower("left"), f"[{SPACE}]+"), lambda x: x != "")
    pattern = F.when(is_token & (F.size(words) > 0), F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2), " "))
    once = once.select(
        "doc_id", "h", "copies", "kind",
        F.when(is_token, inner).otherwise(F.col("start")).cast("long").alias("start"),
        F.when(is_token, inner + F.length("core")).otherwise(F.col("end")).cast("long").alias("end"),
        F.when(is_token, F.col("core")).alias("core"), pattern.alias("pattern"), valid(F.col("kind"), F.col("match")).alias("valid"),
    )
    once = once.where(F.col("kind").isNull() | F.when(is_token, F.col("core").rlike("[0-9@]")).otherwise(F.col("valid"))).drop("valid")
    # what base spans cover: the furthest end before, the nearest start after
    base = ~is_token
    doc = Window.partitionBy("doc_id", "h")
    reach = F.max(F.when(base, F.col("end"))).over(doc.orderBy(F.asc_nulls_first("start"), F.asc("end"), "kind").rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(base, F.col("start"))).over(doc.orderBy(F.desc_nulls_last("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0))
    covered = F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("end"), F.lit(False))
    return once.withColumn("covered", F.when(is_token, covered)).withColumn("seed", F.when(is_token, F.col("covered") | F.col("core").rlike(SECRET)))


def confident_patterns(rows: DataFrame, rounds: int = 3, least: float = 0.6, distinct: int = 4) -> DataFrame:
    """pattern and confidence: those at or over least with so many distinct identifiers."""
    tokens = rows.where((F.col("kind") == SEED) & F.col("pattern").isNotNull())
    edges = tokens.groupBy("pattern", F.lower("core").alias("instance")).agg(F.max("seed").alias("seed"))
    believed = edges.withColumn("belief", F.col("seed").cast("double"))
    for k in range(rounds):
        patterns = believed.groupBy("pattern").agg((F.sum("belief") / (F.count(F.lit(1)) + 1)).alias("confidence"), F.count(F.lit(1)).alias("n"))
        patterns = patterns.where((F.col("n") >= distinct) & (F.col("confidence") > 0.1))
        if k + 1 < rounds:
            lent = edges.join(patterns, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("lent"))
            believed = edges.join(lent, "instance", "left").withColumn("belief", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("lent", F.lit(0.0))))
    return patterns.where(F.col("confidence") >= least).select("pattern", "confidence")


def spans(docs: DataFrame, most_broadcast: int = 100_000, **bootstrap) -> DataFrame:
    """doc_id, h, copies and spans array<struct<start,rank,end,kind>> in order, for each distinct (doc_id, text)."""
    rows = common.staged(found(docs), "pii")
    patterns = common.staged(confident_patterns(rows, **bootstrap), "patterns")
    if patterns.count() <= most_broadcast:
        patterns = F.broadcast(patterns)
    tokens = rows.where((F.col("kind") == SEED) & ~F.col("covered"))
    more = tokens.join(patterns.select("pattern"), "pattern", "left_semi").select("doc_id", "h", "copies", F.lit(LEARNED).alias("kind"), "start", "end")
    base = rows.where(F.col("kind").isNull() | (F.col("kind") != SEED)).select("doc_id", "h", "copies", "kind", "start", "end")
    rank = F.array_position(F.lit([*KINDS, LEARNED]), F.col("kind"))
    listed = F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", rank.alias("rank"), "end", "kind"))))
    return base.unionByName(more).groupBy("doc_id", "h").agg(F.max(F.when(F.col("kind").isNull(), F.col("copies"))).alias("copies"), listed.alias("spans"))


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind))


def digests(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, spans as text and n_learned, for each row of docs."""
    out = spans(docs, **limits)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    base = F.filter("spans", lambda s: s["kind"] != LEARNED)
    counts = [_of_kind(k).cast("long").alias(f"n_{k}") for k in KINDS]
    learned = _of_kind(LEARNED).cast("long").alias("n_learned")
    return out.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), learned)


def redacted(docs: DataFrame, **limits) -> DataFrame:
    """docs with each span in text replaced by its kind in angle brackets; spans that overlap become one, named by the first."""
    out = spans(docs, **limits).select("doc_id", "h", "spans").where(F.size("spans") > 0)
    one = out.select("doc_id", "h", F.explode("spans").alias("s")).select("doc_id", "h", "s.*")
    order = Window.partitionBy("doc_id", "h").orderBy("start", "rank", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    one = one.withColumn("island", F.sum(F.when(F.col("start") < reach, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = one.groupBy("doc_id", "h", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "rank")).alias("kind"))
    cut = F.sort_array(F.collect_list(F.struct("start", "end", "kind")))
    cuts = merged.groupBy("doc_id", "h").agg(cut.alias("__cairn_cuts")).select(F.col("doc_id").alias("__cairn_doc"), F.col("h").alias("__cairn_h"), "__cairn_cuts")
    text = F.coalesce(F.col("text"), F.lit(""))
    joined = docs.withColumn("__cairn_key", F.xxhash64(text)).join(cuts, F.col("doc_id").eqNullSafe(F.col("__cairn_doc")) & (F.col("__cairn_key") == F.col("__cairn_h")), "left")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("__cairn_cuts", lambda c: c["end"]))
    parts = F.zip_with(starts, F.col("__cairn_cuts"), lambda at, c: F.concat(F.substr(F.col("text"), (at + 1).cast("int"), F.coalesce((c["start"] - at).cast("int"), F.length("text"))), F.coalesce(F.concat(F.lit("<"), F.upper(c["kind"]), F.lit(">")), F.lit(""))))
    joined = joined.withColumn("text", F.when(F.col("__cairn_cuts").isNotNull(), F.array_join(parts, "")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("__cairn_cuts").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return joined.select(*[joined[c] for c in docs.columns])


def op6_pii(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
