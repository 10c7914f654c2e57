import random

import pytest
from pyspark.sql import functions as F

from logloom.functions.scalars import http_flags
from logloom.operators import features, windows
from tests import oracles


def make(spark, rows):
    data = [(r["key"], r["service"], r["us"], "f", r["line"], r["numbers"]) for r in rows]
    return spark.createDataFrame(
        data, "template_id string, service string, us long, source_file string, line_number long, numeric_params array<double>"
    ).withColumn("timestamp", F.timestamp_micros("us"))


def check(spark, rows):
    want = oracles.windows(rows)
    df = make(spark, rows)
    both = windows.time_delta(windows.template_windows(df, "template_id", "numeric_params"))
    got = {r["line_number"]: r for r in both.collect()}
    assert len(got) == len(rows)
    for line, (burst, spread, delta) in want.items():
        assert got[line]["burstiness"] == burst, line
        assert got[line]["volatility"] == pytest.approx(spread, rel=1e-6, abs=2e-6), line
        assert got[line]["time_delta"] == pytest.approx(delta, abs=1e-4), line


def test_random_with_ties_nulls_and_hot_key(spark):
    rng = random.Random(7)
    rows = []
    for line in range(600):
        us = None if rng.random() < 0.1 else 1_704_067_200_000_000 + rng.choice([1_000_000, 250_000]) * rng.randrange(60)
        rows.append({
            "key": rng.choice(["hot", "hot", "hot", "a", "b"]), "service": rng.choice(["s", "s", "t"]), "us": us,
            "line": line * 40_000, "numbers": [rng.uniform(-5, 5) for _ in range(rng.randrange(3))],  # spans many line blocks
        })
    check(spark, rows)


def test_one_instant_holds_everything(spark):
    rows = [{"key": "k", "service": "s", "us": 5_000_000, "line": i * 30_000, "numbers": [float(i)]} for i in range(200)]
    check(spark, rows)


def test_known_values(spark):
    base = 1_704_067_200_000_000
    rows = [{"key": "e", "service": "s", "us": base + i * 1_000_000, "line": i, "numbers": []} for i in range(5)]
    rows.append({"key": "e", "service": "s", "us": base + 24_000_000, "line": 9, "numbers": []})
    got = {r["line_number"]: r["burstiness"] for r in windows.burstiness(make(spark, rows)).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 4, 9)] == [1, 2, 3, 4, 5, 1]
    rows = [{"key": "v", "service": "s", "us": base + i, "line": i, "numbers": [x]} for i, x in enumerate([10.0, 20.0, 30.0, 40.0, 50.0])]
    got = {r["line_number"]: r["volatility"] for r in windows.volatility(make(spark, rows)).collect()}
    assert got[0] == 0.0 and got[4] == pytest.approx(200**0.5, abs=1e-6)
    rows = [{"key": "v", "service": "s", "us": base, "line": 0, "numbers": [0.0]}, {"key": "v", "service": "s", "us": base + 1, "line": 1, "numbers": [100.0]}]
    assert {r["volatility"] for r in windows.volatility(make(spark, rows)).collect()} == {0.0, 50.0}
    rows = [{"key": "c", "service": "s", "us": base + i, "line": i, "numbers": [1.7e9]} for i in range(50)]
    assert {r["volatility"] for r in windows.volatility(make(spark, rows)).collect()} == {0.0}
    times = [0, 5, None, 999_999]
    rows = [{"key": "d", "service": "s", "us": None if t is None else t * 1_000_000, "line": i, "numbers": []} for i, t in enumerate(times)]
    got = {r["line_number"]: r["time_delta"] for r in windows.time_delta(make(spark, rows)).collect()}
    assert got == {0: 0.0, 1: 5.0, 2: 0.0, 3: 86400.0}


def test_feature_vector_and_defaults(spark):
    rows = spark.createDataFrame(
        [("l1", "f", 1, None, "", None, "", None, None, "raw text", None), ("l2", "f", 2, "ERROR", "svc", "E1", "tpl <*>", ["7"], "2024-01-01 00:00:00", "raw", 503)],
        "log_id string, source_file string, line_number long, level string, service string, template_id string, template_str string, "
        "dynamic_params array<string>, time string, raw_line string, http_status int",
    ).withColumn("timestamp", F.col("time").cast("timestamp")).drop("time")
    from logloom.functions.scalars import http_flags

    got = {r["log_id"]: r for r in features.feature_rows(rows.withColumns(http_flags(F.col("http_status")))).collect()}
    assert len(got["l1"]["features"]) == 394 and got["l1"]["template_id"] == "E_UNKNOWN"
    assert got["l1"]["embed_text"] == "raw text" and got["l1"]["burstiness"] == 1 and got["l1"]["time_delta"] == 0.0
    assert got["l2"]["features"][-7:] == [0.0, 4.0, 0.0, 0.0, 0.0, 0.0, 1.0] and got["l2"]["level_ordinal"] == 4.0
    assert features.feature_rows(rows.withColumns(http_flags(F.col("http_status"))).limit(0)).count() == 0


def test_few_texts_are_embedded_once_each(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(f"l{i}", "f", i, "INFO", f"s{i % 2}", f"E{i % 3}", "" if i % 3 == 2 else f"tpl {i % 3} <*>", [str(i)], i, "raw text") for i in range(300)],
        "log_id string, source_file string, line_number long, level string, service string, template_id string, template_str string, "
        "dynamic_params array<string>, at long, raw_line string",
    ).withColumn("timestamp", F.timestamp_seconds("at")).withColumns(http_flags(F.lit(503)))
    seen = spark.sparkContext.accumulator(0)

    def embed(text):
        @F.pandas_udf("array<float>")
        def run(texts):
            seen.add(len(texts))
            return texts.map(lambda t: [float(len(t)), 1.0])
        return run(text)

    result = lambda: sorted(map(str, features.feature_rows(rows, embed).collect()))
    once = result()
    assert seen.value == 3 and len(once) == 300
    monkeypatch.setattr(features, "TEXTS", 2)
    assert result() == once and seen.value == 303
    packed = features.packed(features.feature_rows(rows, embed))
    assert "embedding" not in packed.columns
    assert sorted(map(str, features.unpacked(packed).select(*features.feature_rows(rows, embed).columns).collect())) == once


def test_no_group_wider_than_a_cell(spark):
    """The row-level windows are keyed by instant, file and line block, never by the key alone."""
    df = make(spark, [{"key": "k", "service": "s", "us": 1, "line": 1, "numbers": [1.0]}])
    plan = windows.template_windows(df, "template_id", "numeric_params")._jdf.queryExecution().optimizedPlan().toString()
    row_level = [l for l in plan.split("\n") if "Window [row_number()" in l]
    assert row_level and all("_us" in l and "_lines" in l for l in row_level)


def test_late_event_in_a_stream(spark, tmp_path):
    from logloom.streaming import state

    shape = "template_id string, source_file string, line_number long, timestamp timestamp, numbers array<double>"
    for batch in ([(100, 1), (101, 2)], [(50, 3)], [(104, 4), (55, 5), (110.5, 6)]):
        rows = [("t", "f", n, float(s)) for s, n in batch]
        spark.createDataFrame(rows, "template_id string, source_file string, line_number long, s double").select(
            "template_id", "source_file", "line_number", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("timestamp"),
            F.array().cast("array<double>").alias("numbers"),
        ).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        state.replay(state.template_state(stream, "1 day"), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {r["line_number"]: r["burstiness"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 3, 5: 2, 6: 3}


def test_late_event_keeps_the_last_time_of_its_service(spark, tmp_path):
    from logloom.streaming import state

    for batch in ([(101, 1)], [(50, 2)], [(102, 3)]):
        rows = spark.createDataFrame([("s", "f", n, t) for t, n in batch], "service string, source_file string, line_number long, t long")
        rows.select("service", "source_file", "line_number", F.timestamp_seconds("t").alias("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("service string, source_file string, line_number long, timestamp timestamp").parquet(str(tmp_path / "in"))
        state.replay(state.service_state(stream, "1 day"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert {r["line_number"]: r["time_delta"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: 0.0, 2: 0.0, 3: 1.0}


def test_what_a_key_holds_of_a_batch_is_numeric():
    import numpy as np
    import pandas as pd

    from logloom.streaming import state

    frames = [
        pd.DataFrame({"us": [30.0, None], "source_file": ["b", None], "line_number": [2, 9], "numbers": [np.array([1.5, 2.5]), None]}),
        pd.DataFrame({"us": [30.0, 10.0], "source_file": ["a", "b"], "line_number": [7, 1], "numbers": [np.array([]), np.array([4.0])]}),
    ]
    rows, names, flat = state._sorted(frames, numbers=True)
    assert all(kind.kind in "if" for kind in rows.dtypes)
    assert names[rows["file"]].tolist() == ["b", "a", "b", None] and rows["line_number"].to_list() == [1, 7, 2, 9]
    assert [flat[a:b].tolist() for a, b in zip(rows["from"], rows["to"])] == [[4.0], [], [1.5, 2.5], []]
    parts = list(state._out("template_id", "t", rows, names, {"x": np.arange(4)}))
    assert len(parts) == 1 and parts[0]["source_file"].to_list() == ["b", "a", "b", None]
