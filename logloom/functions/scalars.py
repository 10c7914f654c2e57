"""Level, status, time and tolerant-number expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# Level ordinals, status classes and severity names.
LEVEL_ORDINALS = {
    "TRACE": 0.0, "DEBUG": 1.0, "INFO": 2.0, "WARN": 2.5, "WARNING": 2.5,
    "ERROR": 4.0, "FATAL": 5.0, "CRITICAL": 5.0, "UNKNOWN": 2.0,
}
SEVERITY_LEVELS = {"low": "INFO", "medium": "WARN", "high": "ERROR", "critical": "FATAL"}
ERROR_LEVELS = ["ERROR", "FATAL", "CRITICAL"]


def lookup(mapping: dict, key: Column) -> Column:
    """Value of a fixed mapping, NULL for an unknown key."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(table, key)


def level_ordinal(level: Column) -> Column:
    return F.coalesce(lookup(LEVEL_ORDINALS, F.upper(F.coalesce(level, F.lit("UNKNOWN")))), F.lit(2.0))


def status_level(status: Column) -> Column:
    return F.when(status < 400, "INFO").when(status < 500, "WARN").when(status >= 500, "ERROR").otherwise("INFO")


def severity_level(severity: Column) -> Column:
    return F.coalesce(lookup(SEVERITY_LEVELS, F.lower(trim_all(severity))), F.lit("INFO"))


def http_flags(status: Column) -> dict[str, Column]:
    return {
        f"http_{k}xx": F.coalesce(status.between(100 * k, 100 * k + 99), F.lit(False))
        for k in range(1, 6)
    }


def http_vector(flags: list[Column]) -> Column:
    return F.array(*[F.coalesce(f, F.lit(False)).cast("float") for f in flags])


def trim_all(text: Column) -> Column:
    """Strip every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def or_default(value: Column, default: str) -> Column:
    """Default for NULL and for the empty string alike."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def tolerant_double(value: Column) -> Column:
    return F.coalesce(trim_all(value).try_cast("double"), F.lit(0.0))


def parse_timestamp(text: Column, year: int = 1900) -> Column:
    """ISO-like (blank or T, comma or dot fraction, optional zone), syslog and access-log times.

    The shape decides the format, so no row pays for failed attempts. Syslog lines carry no
    year; `year` fills it in.
    """
    s = trim_all(text)
    iso = F.translate(s, ",", ".").try_cast("timestamp")
    syslog = F.try_to_timestamp(
        F.concat(F.lit(f"{year} "), F.regexp_replace(s, r"\s+", " ")), F.lit("yyyy MMM d HH:mm:ss")
    )
    access = F.try_to_timestamp(s, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    return (
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}([.,]\d{1,6})?(Z|[+-]\d{2}:?\d{2})?$"), iso)
        .when(s.rlike(r"^[A-Za-z]{3}\s+\d{1,2} \d{1,2}:\d{2}:\d{2}$"), syslog)
        .when(s.rlike(r"^\d{1,2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}$"), access)
    )


def to_unix(value: Column, kind: str) -> Column:
    """Seconds since 1970 from a number, a timestamp or a string; NULL when unreadable."""
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(value.cast("timestamp")) / F.lit(1e6)
    if kind == "string":
        return F.unix_micros(parse_timestamp(value)) / F.lit(1e6)
    return value.cast("double")


def row_id(source: Column, line_number: Column) -> Column:
    """16 hex characters, the same on every run, so ingesting twice adds nothing."""
    return F.substring(F.sha1(F.concat_ws(":", source, line_number.cast("string"))), 1, 16)


def fixed(x: Column, digits: int) -> Column:
    """`x` rounded to `digits` places from its exact binary value, as C and Python print it.

    Java's formatter rounds the shortest decimal instead, which differs on halves. The product
    x * 10^digits is split into its rounded value and its exact remainder, which breaks the tie.
    """
    scale = F.lit(float(10**digits))
    x = x.cast("double")
    product = x * scale
    wide = x * F.lit(134217729.0)  # splits the 53 bits of x in two halves
    high = wide - (wide - x)
    rest = (high * scale - product) + (x - high) * scale
    whole = F.floor(product).cast("double")
    part = product - whole
    tie = (rest > 0) | ((rest == 0) & (F.pmod(whole, F.lit(2.0)) == 1))
    up = (part > 0.5) | ((part == 0.5) & tie)
    return (whole + F.when(up, 1.0).otherwise(0.0)) / scale
