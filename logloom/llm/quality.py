"""Quality rules: counts per document, and divergence from language references.

A document's histograms over character classes and over common function words are compared with
those of every language (Jensen-Shannon distance, base 2, 0 to 1); the nearest language decides.
The references are pooled over the whole corpus by its language column, for the languages named
here, and over all rows; so they are at most five rows, whatever the corpus. Documents too short
for a stable histogram pass that rule unheard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logloom.llm.registry import query, table
from logloom.llm.words import WHITE
from logloom.session import stored

# Frequent function words of the languages that have a reference.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "for"],
    "es": ["de", "la", "que", "el", "en", "los", "del", "un"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un"],
}
LISTED = sorted({w for words in COMMON_WORDS.values() for w in words})
CODES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"[: len(LISTED)]

MIN_WORDS = 50  # fewer: rejected
MAX_REPEATED = 50  # percent of words in repeated windows
CLASS_WORDS, CLASS_DISTANCE = 50, 0.3  # words needed, and distance allowed, for character classes
COMMON_MIN, COMMON_DISTANCE = 200, 0.22  # the same for common words


def _removed(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def features(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts and histograms of every row: id, lang, n_chars, the base counts, classes, common."""
    plain = docs.select(F.col(id).alias("id"), F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # What is left without lower-case letters is short, so the other classes are counted there.
    split = plain.withColumns({
        "words": F.filter(F.split("text", WHITE), lambda w: w != ""),
        "lines": F.filter(F.split("text", "\n"), lambda line: line.rlike("[^ \\t-\\r]")),
        "no_lower": F.regexp_replace("text", "\\p{Ll}+", ""),
    })
    solid = split.withColumns({
        "hashes": F.when(
            F.size("words") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
        "solid": F.regexp_replace("no_lower", WHITE, ""),
        "common": F.filter(F.transform(F.filter("words", lambda w: F.length(w) <= max(map(len, LISTED))), F.lower), lambda w: w.isin(LISTED)),
    })
    # Windows that agree stand side by side when sorted by hash; only texts with such windows are sorted.
    sorted_ = solid.withColumns({
        "windows": F.when(
            F.size(F.array_distinct("hashes")) < F.size("hashes"),
            F.sort_array(F.transform("hashes", lambda h, at: F.struct(h.alias("hash"), at.alias("at")))),
        ).otherwise(F.array().cast("array<struct<hash:bigint,at:int>>")),
        "common": F.array_join(
            F.transform("common", lambda w: F.substring(F.lit(CODES), F.array_position(F.array(*map(F.lit, LISTED)), w).cast("int"), F.lit(1))), ""
        ),
    })
    same = lambda w, k: F.coalesce(F.get("windows", k)["hash"] == w["hash"], F.lit(False))
    again = F.filter("windows", lambda w, k: same(w, k - 1) | same(w, k + 1))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda w: F.array(w["at"], w["at"] + 1, w["at"] + 2))))
    counted = sorted_.select(
        "id", "lang", "common",
        F.length("text").cast("long").alias("n_chars"),
        F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
        (F.length("no_lower") - F.length("solid")).cast("long").alias("n_white"),
        (F.length("text") - F.length("no_lower")).cast("long").alias("n_lower"),
        _removed(F.col("solid"), "[#*$%&|<>]+").cast("long").alias("n_symbols"),
        _removed(F.col("solid"), "\\p{Lu}+").cast("long").alias("n_upper"),
        _removed(F.col("solid"), "[0-9]+").cast("long").alias("n_digits"),
    )
    rest = F.col("n_chars") - F.col("n_white") - F.col("n_symbols") - F.col("n_upper") - F.col("n_lower") - F.col("n_digits")
    held = [F.length("common") - F.length(F.replace("common", F.lit(c))) for c in CODES]
    return counted.select(
        "id", "lang", "n_chars", "n_words", (F.col("n_chars") - F.col("n_white")).alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words",
        F.array("n_upper", "n_lower", "n_digits", "n_white", "n_symbols", rest).alias("classes"),
        F.array(*(h.cast("long") for h in held), F.col("n_words") - F.length("common")).alias("common"),
    )


def references(found: DataFrame) -> list[dict]:
    """Pooled histograms of every listed language that has words, and of all rows."""
    sums = [F.sum(F.col(name)[k]).alias(f"{name}{k}") for name, size in (("classes", 6), ("common", len(LISTED) + 1)) for k in range(size)]
    pooled = found.groupBy(F.when(F.col("lang").isin(sorted(COMMON_WORDS)), F.col("lang")).alias("lang")).agg(*sums)
    by_lang = [row.asDict() for row in pooled.orderBy(F.col("lang").asc_nulls_last()).collect()]
    shape = lambda row: {n: [row[f"{n}{k}"] or 0 for k in range(size)] for n, size in (("classes", 6), ("common", len(LISTED) + 1))}
    parts = [shape(row) for row in by_lang]
    whole = {n: [sum(p[n][k] for p in parts) for k in range(size)] for n, size in (("classes", 6), ("common", len(LISTED) + 1))}
    named = [shape(row) for row in by_lang if row["lang"] is not None]
    return [r for r in [*named, whole] if sum(r["common"]) > 0]


def _part(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))


def distance(counts: str, total: str, reference: list[int]) -> Column:
    """Jensen-Shannon distance (base 2) of a histogram column to a reference; null if it is empty."""
    weight = float(sum(reference))
    shares = F.array(*(F.lit(r / weight) for r in reference))
    terms = F.zip_with(
        F.transform(counts, lambda x: x / F.col(total)), shares, lambda p, q: _part(p, (p + q) / 2) + _part(q, (p + q) / 2)
    )
    return F.when(F.col(total) > 0, F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0))))


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per input row: id, the counts, class_distance, common_distance, base_failed, kept.

    Null and empty texts have no word, so they fail the base rule; distances are null where a
    histogram is empty or no reference exists, and a null distance rejects nothing. A null or unknown
    language is fine. Repeated rows stay repeated, other columns are ignored, no rows give none.
    """
    found = stored(features(docs, id, text, lang), "quality")
    known = references(found)
    nearest = lambda name, total: F.array_min(F.array(*(distance(name, total, r[name]) for r in known))) if known else F.lit(None).cast("double")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    off = (F.col("n_words") >= CLASS_WORDS) & (F.col("class_distance") > CLASS_DISTANCE)
    off = F.coalesce(off, F.lit(False)) | F.coalesce((F.col("n_words") >= COMMON_MIN) & (F.col("common_distance") > COMMON_DISTANCE), F.lit(False))
    return (
        found.withColumns({"class_distance": nearest("classes", "n_chars"), "common_distance": nearest("common", "n_words")})
        .select(
            F.col("id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "class_distance", "common_distance", base.alias("base_failed"), (~base & ~off).alias("kept"),
        )
    )


def _sql() -> str:
    bins = len(LISTED) + 1
    listed = ", ".join(f"'{w}'" for w in LISTED)
    counts = ", ".join(f"len([x FOR x IN lw IF x = '{w}'])" for w in LISTED)
    pooled = lambda name, size: "[" + ", ".join(f"sum({name}[{k + 1}])" for k in range(size)) + "]"
    term = "(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0.0 END)"
    jsd = lambda name, size, total: "sqrt(greatest((" + " + ".join(
        term.format(p=p, q=q) + " + " + term.format(p=q, q=p)
        for k in range(1, size + 1)
        for p, q in [(f"(f.{name}[{k}]::DOUBLE / f.{total})", f"(r.{name}[{k}]::DOUBLE / list_sum(r.{name}))")]
    ) + ") / 2, 0.0))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
    [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines,
    [lower(x) FOR x IN regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') IF lower(x) IN ({listed})] AS lw
  FROM d),
t AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS c
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
v AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM t WHERE c > 1) GROUP BY r),
c AS (
  SELECT w.r, doc_id, lang, len(words)::BIGINT AS n_words, length(text) AS n_chars,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words,
    length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')) AS up, length(text) - length(regexp_replace(text, '\\p{{Ll}}', '', 'g')) AS low,
    length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS dig, [{counts}] AS held
  FROM w LEFT JOIN v ON v.r = w.r),
f AS (
  SELECT *, [up, low, dig, n_chars - word_chars, n_symbols, word_chars - n_symbols - up - low - dig] AS classes,
    list_append(held, n_words - list_sum(held)) AS common FROM c),
refs AS (
  SELECT {pooled('classes', 6)} AS classes, {pooled('common', bins)} AS common FROM f WHERE lang IN ({", ".join(f"'{x}'" for x in sorted(COMMON_WORDS))})
  GROUP BY lang HAVING sum(n_words) > 0
  UNION ALL SELECT {pooled('classes', 6)}, {pooled('common', bins)} FROM f HAVING sum(n_words) > 0),
g AS (
  SELECT f.r, min(CASE WHEN f.n_chars > 0 THEN {jsd('classes', 6, 'n_chars')} END) AS cd, min(CASE WHEN f.n_words > 0 THEN {jsd('common', bins, 'n_words')} END) AS wd
  FROM f CROSS JOIN refs r GROUP BY f.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words)
  AND NOT coalesce(n_words >= {CLASS_WORDS} AND cd > {CLASS_DISTANCE}, false) AND NOT coalesce(n_words >= {COMMON_MIN} AND wd > {COMMON_DISTANCE}, false) AS kept
FROM f LEFT JOIN g ON g.r = f.r
"""


@query("op7_quality", _sql())
def op7_quality(spark, folder):
    return judge(table(spark, folder, "documents")).drop("class_distance", "common_distance")
