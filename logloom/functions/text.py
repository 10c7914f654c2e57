"""Text expressions: masking, parameters, numbers, entropy, keywords."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from logloom.session import unused

# Masks in their order. The quantifier of the mail mask is possessive, which
# changes no match but keeps long runs of letters linear; the parameter mask stops at white space.
MASKS = [
    ("<IP>", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("<UUID>", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    ("<TIMESTAMP>", r"\b(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?)\b"),
    ("<APACHE_TS>", r"\[\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}\s[+-]\d{4}\]"),
    ("<DURATION>", r"\b\d+\.\d+\s*(ms|s|sec|seconds|milliseconds)\b"),
    ("<SIZE>", r"\b(\d+)\s*(MB|GB|KB|bytes|byte)\b"),
    ("<EMAIL>", r"\b[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("<PARAM>", r"([?&])[^=&\s]+=[^&\s]*"),
    ("<URL>", r"""https?://[^\s"']+"""),
    ("<HTTP_REQUEST>", r"(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+[^\s]+\s+HTTP/[\d.]+"),
    ("<USER_AGENT>", r"""Mozilla/[^"]+|Opera/[^"]+|curl/[^\s]+"""),
    ("<NUM>", r"\b\d{5,}\b"),
]
# What a text must hold to match a mask, one of each group; a search for it costs far less than the pattern.
NEEDED = {
    "<IP>": ["."], "<UUID>": ["-"], "<TIMESTAMP>": [":", "-"], "<APACHE_TS>": ["[", "/"], "<DURATION>": ["."], "<SIZE>": ["MB|GB|KB|byte"],
    "<EMAIL>": ["@"], "<PARAM>": ["=", "?|&"], "<URL>": ["://"], "<HTTP_REQUEST>": ["HTTP/"], "<USER_AGENT>": ["Mozilla/|Opera/|curl/"], "<NUM>": [],
}
DIGITS = {"<IP>", "<TIMESTAMP>", "<APACHE_TS>", "<DURATION>", "<SIZE>", "<NUM>"}  # masks that match no text without digits
WILDCARD = "<*>"
# Characters that separate tokens besides white space, and what counts as a number.
EXTRA_DELIMITERS = "_/:=,;|"
NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"


def _replacement(mask: str) -> str:
    return "$1" + mask if mask == "<PARAM>" else mask


def mask_text(text: Column) -> Column:
    for name, pattern in MASKS:
        text = F.regexp_replace(text, pattern, _replacement(name))
    return text


def with_masks(df: DataFrame, text: str, masked: str, values: str | None = None) -> DataFrame:
    """Adds the masked text and, under `values`, what the masks hide, mask by mask.

    One projection per mask: each mask sees the text the earlier ones left, and that text is
    computed once although it is both searched and replaced. Masks bring no digits, so one look for digits
    before them tells which masks cannot match.
    """
    digits = unused(df, "_digits")
    df = df.withColumns({masked: F.col(text), digits: F.col(text).rlike("[0-9]")})
    if values is not None:
        df = df.withColumn(values, F.when(F.col(masked).isNotNull(), F.array().cast("array<string>")))
    for name, pattern in MASKS:

        def hit(found: Column) -> Column:
            test = found.rlike(pattern)
            for group in reversed(NEEDED[name]):
                test = reduce(or_, (found.contains(part) for part in group.split("|"))) & test
            return F.col(digits) & test if name in DIGITS else test

        # A one-element transform names the text once, so the masks do not multiply where a filter is pushed below them.
        left = F.transform(F.array(masked), lambda m: F.when(hit(m), F.regexp_replace(m, F.lit(pattern), F.lit(_replacement(name)))).otherwise(m))
        added = {masked: F.get(left, F.lit(0))}
        if values is not None:
            hidden = F.regexp_extract_all(masked, F.lit(pattern), F.lit(0))
            added[values] = F.when(hit(F.col(masked)), F.concat(values, hidden)).otherwise(F.col(values))
        df = df.withColumns(added)
    return df.drop(digits)


def tokens(text: Column) -> Column:
    """White space and the extra delimiters both separate tokens; no empty tokens."""
    return F.regexp_extract_all(text, F.lit(rf"[^\s{EXTRA_DELIMITERS}]+"), F.lit(0))


def dynamic_params(message: Column, template: Column, extra: Column | None = None, most: int | None = None) -> Column:
    """Message tokens at wildcard places, then tokens past the template's end, then `extra`."""
    m, t = tokens(message), tokens(template)
    paired = F.filter(
        F.arrays_zip(m.alias("m"), t.alias("t")),
        lambda p: (p["t"] == WILDCARD) & p["m"].isNotNull() & (p["m"] != WILDCARD),
    )
    at_wildcards = F.transform(paired, lambda p: p["m"])
    past_end = F.when(
        F.size(m) > F.size(t), F.slice(m, F.size(t) + 1, F.greatest(F.size(m) - F.size(t), F.lit(0)))
    ).otherwise(F.array().cast("array<string>"))
    parts = [at_wildcards, past_end] + ([extra] if extra is not None else [])
    return F.concat(*parts) if most is None else F.slice(F.concat(*parts), 1, most)


def numeric_params(params: Column, most: int | None = None) -> Column:
    """First number in each parameter, as doubles; parameters without one fall out."""
    params = F.coalesce(params, F.array().cast("array<string>"))
    numbers = F.transform(
        params if most is None else F.slice(params, 1, most),
        lambda p: F.regexp_extract(p, NUMBER, 0).try_cast("double"),
    )
    return F.filter(numbers, lambda x: x.isNotNull())


def params_from_json(text: Column) -> Column:
    """List of strings from its JSON text; broken JSON counts as no parameters."""
    return F.from_json(text, "array<string>")


def entropy(text: Column) -> Column:
    """Character entropy over log2(length), in [0, 1]; 0 for fewer than two characters.

    H = log2(n) - sum(c log2 c) / n. Each distinct character is taken out of the text in turn;
    its count c is what the text loses, so the text shrinks quickly. One-element transforms
    hold the shortened text and its length, so neither is computed twice.
    """
    n = F.length(text).cast("double")

    def take_out(state: Column, ch: Column) -> Column:
        shorter = F.transform(
            F.array(F.replace(state["rest"], ch, F.lit(""))), lambda r: F.struct(r.alias("rest"), F.length(r).alias("left"))
        )
        lost = lambda r: (state["left"] - r["left"]).cast("double")
        return F.get(
            F.transform(
                shorter,
                lambda r: F.struct(
                    r["rest"].alias("rest"), r["left"].alias("left"),
                    (state["sum"] + F.when(lost(r) > 0, lost(r) * F.log2(lost(r))).otherwise(0.0)).alias("sum"),
                ),
            ),
            F.lit(0),
        )

    start = F.struct(text.alias("rest"), F.length(text).alias("left"), F.lit(0.0).alias("sum"))
    weighted = F.aggregate(F.array_distinct(F.split(text, "")), start, take_out, lambda s: s["sum"])
    share = (F.log2(n) - weighted / n) / F.log2(n)
    return F.when(
        F.length(text) > 1, F.round(F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)), 6)
    ).otherwise(F.lit(0.0))


def keywords(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))


def cap(text: Column, size: int | None) -> Column:
    """Optional display cut; None (the default everywhere) keeps the whole text."""
    return text if size is None else F.substring(text, 1, size)
