import datetime as dt
import math

import pytest
from hypothesis import given, settings, strategies as st, HealthCheck
from pyspark.sql import functions as F

from logloom.functions import scalars, text, vectors
from logloom.operators.parse import parse_lines, with_row_ids
from tests import oracles


def values(spark, items, kind, *exprs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [tuple(r)[1:] for r in rows.select("i", *exprs).orderBy("i").collect()]


def test_entropy_known_values(spark):
    items = ["", "a", "aaaaaaaaaa", "abcdefghij", "2024-01-01 ERROR db timeout after 500 ms", "naïve 😀😀 text", "x" * 50_000 + "y"]
    got = [r[0] for r in values(spark, items, "string", text.entropy(F.col("x")))]
    assert got[:4] == [0.0, 0.0, 0.0, 1.0]
    assert 0.5 <= got[4] <= 1.0
    assert got == pytest.approx([oracles.entropy(t) for t in items], abs=2e-6)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"), max_size=60), min_size=1, max_size=40))
def test_entropy_random(spark, items):
    got = [r[0] for r in values(spark, items, "string", text.entropy(F.col("x")))]
    assert got == pytest.approx([oracles.entropy(t) for t in items], abs=2e-6)


def test_levels_and_flags(spark):
    names = ["trace", "DEBUG", "Info", "WARN", "warning", "ERROR", "fatal", "CRITICAL", "UNKNOWN", "odd", None]
    got = [r[0] for r in values(spark, names, "string", scalars.level_ordinal(F.col("x")))]
    assert got == [0, 1, 2, 2.5, 2.5, 4, 5, 5, 2, 2, 2]
    flags = scalars.http_flags(F.col("x"))
    got = values(spark, [100, 204, 301, 404, 503, 99, 600, None], "int", *flags.values())
    assert [list(r).index(True) if True in r else None for r in got] == [0, 1, 2, 3, 4, None, None, None]
    got = [r[0] for r in values(spark, [200, 399, 400, 499, 500, None], "int", scalars.status_level(F.col("x")))]
    assert got == ["INFO", "INFO", "WARN", "WARN", "ERROR", "INFO"]
    got = [r[0] for r in values(spark, ["Low", " medium", "HIGH", "critical", "?", None], "string", scalars.severity_level(F.col("x")))]
    assert got == ["INFO", "WARN", "ERROR", "FATAL", "INFO", "INFO"]


def test_times(spark):
    items = [
        "2024-01-01 12:00:00", "2024-01-01T12:00:00Z", "2024-01-01T12:00:00.5Z", "2024-01-01T12:00:00", "2024-01-01 12:00:00,123",
        "2024-01-01 12:00:00.123456", "2024-01-01T14:00:00+02:00", "01/Jan/2024:17:30:00 +0530", "", None, "junk", "2024-13-01 12:00:00",
    ]
    got = [r[0] for r in values(spark, items, "string", scalars.to_unix(F.col("x"), "string"))]
    base = 1704110400.0
    assert got == [base, base, base + 0.5, base, base + 0.123, base + 0.123456, base, base, None, None, None, None]
    got = [r[0] for r in values(spark, ["Jan  5 10:00:01", "Dec 31 23:59:59"], "string", scalars.parse_timestamp(F.col("x"), 2024))]
    assert got == [dt.datetime(2024, 1, 5, 10, 0, 1), dt.datetime(2024, 12, 31, 23, 59, 59)]
    assert values(spark, [12.5], "double", scalars.to_unix(F.col("x"), "double")) == [(12.5,)]


def test_defaults_and_numbers(spark):
    got = values(spark, ["", None, "a"], "string", scalars.or_default(F.col("x"), "unknown"), scalars.tolerant_double(F.col("x")))
    assert got == [("unknown", 0.0), ("unknown", 0.0), ("a", 0.0)]
    got = values(spark, ['["500","host-1","x",".5","1e3"]', "{broken", None, "[]"], "string", text.numeric_params(text.params_from_json(F.col("x"))))
    assert [r[0] for r in got] == [[500.0, -1.0, 0.5, 1000.0], [], [], []]
    many = "[" + ",".join(f'"{i}"' for i in range(20)) + "]"
    assert len(values(spark, [many], "string", text.numeric_params(text.params_from_json(F.col("x"))))[0][0]) == 20
    assert len(values(spark, [many], "string", text.numeric_params(text.params_from_json(F.col("x")), 16))[0][0]) == 16


def test_fixed_rounds_like_python(spark):
    items = [0.7235, 0.0625, 1.0005, 2.5, 0.125, 0.0, 123.45649999]
    for digits in (1, 3):
        got = [r[0] for r in values(spark, items, "double", F.format_string(f"%.{digits}f", scalars.fixed(F.col("x"), digits)))]
        assert got == [f"{x:.{digits}f}" for x in items]


def test_masks(spark):
    items = [
        "from 10.0.0.1 id 123e4567-e89b-12d3-a456-426614174000", "at 2024-01-01 10:00:00.5 took 12.5 ms size 10 KB",
        "mail bob@example.com see https://x.org/a?b=1", "GET /index HTTP/1.1 by curl/8.1", "?a=1&b=2 end 123456",
    ]
    got = [r[0] for r in values(spark, items, "string", text.mask_text(F.col("x")))]
    assert got == [
        "from <IP> id <UUID>", "at <TIMESTAMP> took <DURATION> size <SIZE>", "mail <EMAIL> see <URL>",
        "<HTTP_REQUEST> by <USER_AGENT>", "?<PARAM>&<PARAM> end <NUM>",
    ]
    rows = spark.createDataFrame([(items[1],)], "x string")
    hidden = text.with_masks(rows, "x", "m", "v").first()
    assert hidden["m"] == got[1] and hidden["v"] == ["2024-01-01 10:00:00.5", "12.5 ms", "10 KB"]


def test_dynamic_params(spark):
    rows = spark.createDataFrame(
        [("failed after 500 ms", "failed after <*> ms"), ("a=1 b", "a <*>"), ("same", "same"), (" ".join(map(str, range(50))), "<*>")],
        "m string, t string",
    )
    got = [r[0] for r in rows.select(text.dynamic_params(F.col("m"), F.col("t"))).collect()]
    assert got[0] == ["500"] and got[1] == ["1", "b"] and got[2] == []
    assert got[3] == [str(i) for i in range(50)]


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = rows.select(vectors.unit(F.col("a")), vectors.cosine(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == [0.6, 0.8] and got[0][1] == pytest.approx(0.96)
    assert got[1][0] == [0.0, 0.0] and got[1][1] == 0.0
    long = " ".join(f"word{i}" for i in range(3000))
    rows = spark.createDataFrame([("error in db",), ("",), (long,), ("DB in ERROR",)], "t string")
    got = [r[0] for r in rows.select(vectors.hash_embedding(F.col("t"))).collect()]
    assert [len(v) for v in got] == [384] * 4
    assert sum(x * x for x in got[0]) == pytest.approx(1, abs=1e-5) and sum(map(abs, got[1])) == 0
    assert got[0] == got[3]
    custom = vectors.embedder(lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert rows.select(custom("t")).first()[0] == pytest.approx([11 / math.sqrt(122), 1 / math.sqrt(122)])


def test_line_shapes(spark):
    lines = [
        "2024-01-01 12:00:00 INFO service_1 Connection attempt 1 on port 8080 status=200",
        "2024-01-01T12:00:01Z WARNING disk", "Jan  5 10:00:01 host1 sshd[123]: Failed password",
        "2024-01-01 12:00:00,123 ERROR com.x.Y - boom",
        '10.0.0.1 - bob [18/Jul/2024:10:11:12 +0530] "GET /x HTTP/1.1" 404 123 "-" "curl/1"',
        "no shape at all", "2024-01-01 12:00:00.5 hello", "   ", "x" * 50_000, "ünïcode ☃ 2024-01-01 00:00:00 DEBUG \u0001 mark",
    ]
    rows = spark.createDataFrame([("f", i, l) for i, l in enumerate(lines)], "source_file string, line_number long, line string")
    got = {r["line_number"]: r for r in with_row_ids(parse_lines(rows, year=2024)).collect()}
    assert 7 not in got and len(got) == 9
    assert (got[0]["level"], got[0]["service"], got[0]["message"]) == ("INFO", "unknown", "service_1 Connection attempt 1 on port 8080 status=200")
    assert got[1]["level"] == "WARNING" and got[1]["message"] == "disk" and got[1]["timestamp"] == dt.datetime(2024, 1, 1, 12, 0, 1)
    assert (got[2]["service"], got[2]["level"], got[2]["timestamp"]) == ("sshd", "UNKNOWN", dt.datetime(2024, 1, 5, 10, 0, 1))
    assert (got[3]["service"], got[3]["level"], got[3]["message"]) == ("com.x.Y", "ERROR", "boom")
    assert got[4]["http_status"] == 404 and got[4]["http_4xx"] and not got[4]["http_5xx"] and got[4]["message"] == lines[4]
    assert got[5]["level"] is None and got[5]["timestamp"] is None and got[5]["message"] == lines[5]
    assert got[6]["level"] is None and got[6]["service"] == "unknown"
    assert len(got[8]["raw_line"]) == 50_000
    assert got[9]["level"] == "DEBUG"
    assert len({r["log_id"] for r in got.values()}) == 9 and all(len(r["log_id"]) == 16 for r in got.values())
