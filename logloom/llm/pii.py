"""Personal data: fixed kinds by pattern, further identifiers by bootstrapped contexts.

The fixed kinds (e-mail, IP, card, phone) are seeds, and so is a token behind the name of a secret (`password=`).
An entity's lexical patterns are what stands around it (words before and after, lower-cased, digits as 0, alone
and together), the name it is given a value for, how it begins, and whether letters and digits are mixed
in it. Tokens that look like identifiers form, with their patterns, a graph; in each round a pattern's
score is the mean score of its different instances (with a prior against rare patterns), an instance's the best of
its patterns', and a seed's stays one. Patterns of high score and enough instances then say which further tokens
are identifiers: they come out as spans of kind `id`, where they overlap no fixed one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.llm.registry import query, table
from logloom.session import hint_small, stored

# The kinds in the order of the spans. Each pattern finds what its plain form finds, in
# linear time: a match never starts behind a character that it could have started with itself.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone", "id"]
# Names whose values are secrets.
SECRETS = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key"]
# Candidates for identifiers: runs of letters, digits, - and _ of a least length that hold digits; long ones need but one.
MIN_LENGTH, MIN_DIGITS, LONG = 6, 3, 12
NAMED = r"""([A-Za-z][A-Za-z_-]{1,30})["']?\s*[=:]\s*["']?$"""
MIXED = r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"
MIN_CHANGES = 4  # between letters and digits, that make a long token a mixed one
CANDIDATE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{%d,}+" % MIN_LENGTH

ROUNDS, PRIOR = 3, 2.0
MIN_SCORE, MIN_INSTANCES = 0.5, 5


def _luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits holds."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))
    ))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    count = F.length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"))
        .when(kind == "card", F.when(count.between(12, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", count.between(9, 15))
        .otherwise((count >= MIN_DIGITS) | (F.length(match) >= LONG))
    )


def _matches(kind: str, pattern: str, when: Column) -> Column:
    """Matches in order, each with the text between the one before and itself; last, the text after them without a match."""
    none = F.array().cast("array<struct<kind:string,gap:string,match:string>>")
    pairs = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("match"))
    named = F.transform(pairs, lambda p: F.struct(F.lit(kind).alias("kind"), p["gap"].alias("gap"), p["match"].alias("match")))
    return F.when(when, F.when(F.size(named) > 1, named).otherwise(none)).otherwise(none)


def _words(text: Column) -> Column:
    return F.split(F.trim(F.lower(F.regexp_replace(F.translate(text, "\t\n\r", "   "), "[0-9]", "0"))), " +")


def _contexts() -> Column:
    """The lexical patterns of a match, from its text and the characters before and after it."""
    before, after = _words(F.col("before")), _words(F.col("after"))
    left, right = F.get(before, F.size(before) - 1), F.get(after, F.lit(0))
    name = F.lower(F.regexp_extract("before", NAMED, 1))
    start = F.regexp_extract("match", "^[A-Z]{4}|^[a-z]{2,5}[_-]", 0)
    mixed = (F.length("match") >= LONG) & (F.regexp_count("match", F.lit(MIXED)) >= MIN_CHANGES)
    told = lambda sign, *parts: F.when(F.least(F.lit(True), *(p != "" for p in parts)), F.concat(F.lit(sign), F.concat_ws(" ", *parts)))
    return F.array_compact(F.array(
        told("word:", left), told("words:", F.get(before, F.size(before) - 2), left), told("around:", left, right), told("next:", right),
        told("name:", name), F.when(start != "", F.concat(F.lit("start:"), start, F.length("match"))), F.when(mixed, F.lit("mixed")),
    ))


def entities(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(row, id, kind, start, end, match, contexts, named): a row per match, at least one (of no kind) per input row.

    Places are code points, from sums of the lengths before them within the row.
    """
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    digit = plain.withColumn("digit", F.col("text").rlike("[0-9]"))
    found = digit.withColumn("found", F.concat(
        _matches("email", EMAIL, F.contains("text", F.lit("@"))), _matches("ip", IP, F.col("digit")), _matches("card", CARD, F.col("digit")),
        _matches("phone", PHONE, F.col("digit") & F.contains("text", F.lit("+"))), _matches("id", CANDIDATE, F.col("digit")),
    ))
    rows = found.select("row", "id", F.posexplode_outer("found").alias("at", "m")).select("row", "id", "at", "m.kind", "m.gap", "m.match")
    before = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sized = rows.select(
        "row", "id", "kind", "at", "match", F.length("gap").alias("gap"), F.coalesce(F.length("match"), F.lit(0)).alias("size"),
        F.right("gap", F.lit(48)).alias("before"), F.left("gap", F.lit(48)).alias("head"),
    )
    sized = sized.withColumn("after", F.coalesce(F.lead("head").over(Window.partitionBy("row", "kind").orderBy("at")), F.lit("")))
    placed = sized.withColumn("start", F.coalesce(F.sum(F.col("gap") + F.col("size")).over(before), F.lit(0)) + F.col("gap"))
    valid = F.coalesce(_valid(F.col("kind"), F.col("match")), F.lit(False)) & F.col("match").isNotNull()
    return placed.select(
        "row", "id", F.when(valid, F.col("kind")).alias("kind"), F.col("start").cast("long").alias("start"),
        (F.col("start") + F.col("size")).cast("long").alias("end"), "match", F.when(valid, _contexts()).alias("contexts"),
        F.lower(F.regexp_extract("before", NAMED, 1)).isin(SECRETS).alias("named"),
    )


def patterns(found: DataFrame, rounds: int = ROUNDS, min_score: float = MIN_SCORE, min_instances: int = MIN_INSTANCES) -> DataFrame:
    """(context, score) of the patterns to trust, from all entities and candidates."""
    seed = F.when((F.col("kind") != "id") | F.col("named"), 1.0).otherwise(0.0)
    instances = found.filter("kind is not null").select("match", seed.alias("seed"), F.explode("contexts").alias("context"))
    graph = stored(instances.groupBy("match", "context").agg(F.max("seed").alias("seed")), "patterns")
    held = graph.withColumn("score", F.col("seed"))
    for _ in range(rounds):
        by_context = held.groupBy("context").agg((F.sum("score") / (F.count(F.lit(1)) + PRIOR)).alias("trust"), F.count(F.lit(1)).alias("instances"))
        by_context = stored(by_context, "contexts")
        best = graph.join(hint_small(by_context), "context").groupBy("match").agg(F.greatest(F.max("seed"), F.max("trust")).alias("score"))
        held = stored(graph.join(best, "match"), "instances")
    return by_context.filter((F.col("trust") >= min_score) & (F.col("instances") >= min_instances)).select("context", F.col("trust").alias("score"))


def spans(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per input row: id, base and extra: arrays of (start, order, kind, end).

    Null and empty texts have none; repeated rows stay repeated; other columns are ignored; an empty
    table gives no rows. A null id stays null.
    """
    found = stored(entities(docs, id, text), "entities")
    trusted = stored(patterns(found, **options), "trusted")
    known = hint_small(trusted.select("context", F.lit(True).alias("trusted")))
    span = F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("order"), "kind", "end")
    fixed = found.groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(F.when(F.col("kind") != "id", span))).alias("base"))
    told = found.filter("kind = 'id'").withColumn("context", F.explode("contexts")).join(known, "context").select("row", "kind", "start", "end").distinct()
    new = told.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("extra"))
    both = fixed.join(new, "row", "left").withColumn("extra", F.coalesce("extra", F.filter("base", lambda _: F.lit(False))))
    clear = F.filter("extra", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return both.select(F.col("id").alias(id), "base", clear.alias("extra"))


def _joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op1_pii")
def op1_pii(spark, folder):
    found = spans(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, KINDS[:4]), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat("base", "extra"))).alias("spans"),
    )
