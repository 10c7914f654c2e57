"""Keyed state across micro-batches: 10 s counts, running deviation, last-seen time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logloom.operators.windows import BURST_US, MAX_DELTA_SECONDS

# How long a silent key keeps its state (event time), in place of a cap on the number of keys.
IDLE_MS = 24 * 3600 * 1000
AT_ONCE = 10_000  # rows of a result that are made at a time


def _sorted(frames, numbers: bool = False):
    """A key's rows in time order, and (values, from, to) of each row's numbers. What is held is numeric: names of files as
    codes, the numbers of all rows in one array."""
    names, parts, flat, sizes = {}, [], [], []
    for frame in frames:
        codes, found = pd.factorize(frame["source_file"])
        place = np.array([names.setdefault(name, len(names)) for name in found] + [-1], dtype=np.int64)
        parts.append(pd.DataFrame({"us": frame["us"], "line_number": frame["line_number"], "file": place[codes]}))
        if numbers:
            held = [np.zeros(0) if x is None else np.asarray(x, dtype=np.float64) for x in frame["numbers"]]
            sizes.append(np.array([len(x) for x in held], dtype=np.int64))
            flat.append(np.concatenate(held) if held else np.zeros(0))
    rows = pd.concat(parts, ignore_index=True)
    order = sorted(names)
    rank = np.empty(len(order) + 1, dtype=np.int64)
    rank[[names[name] for name in order]] = np.arange(len(order))
    rank[-1] = len(order)  # no name comes last
    rows["file"] = rank[rows["file"].to_numpy()]
    if numbers:
        upto = np.cumsum(np.concatenate(sizes))
        rows["to"], rows["from"] = upto, upto - np.concatenate(sizes)
    rows = rows.sort_values(["us", "file", "line_number"], kind="stable", na_position="last", ignore_index=True)
    return rows, np.array([*order, None], dtype=object), np.concatenate(flat) if numbers else None


def _out(key: str, value, rows: pd.DataFrame, names: np.ndarray, columns: dict):
    """The result, some rows at a time."""
    for start in range(0, len(rows), AT_ONCE):
        some = slice(start, start + AT_ONCE)
        yield pd.DataFrame({
            key: value, "source_file": names[rows["file"].to_numpy()[some]], "line_number": rows["line_number"].to_numpy()[some],
            **{name: values[some] for name, values in columns.items()},
        })


def _keep(state: GroupState, rows: pd.DataFrame) -> None:
    latest = rows["us"].max()
    mark = state.getCurrentWatermarkMs()
    if pd.notna(latest):
        state.setTimeoutTimestamp(max(int(latest // 1000), mark) + IDLE_MS)


def _in_window(times, counts, now: np.ndarray) -> np.ndarray:
    """For sorted times the events of the last 10 s: stored ones at or before each, and those of the
    batch up to it."""
    past = np.asarray(times, dtype=np.int64)
    upto = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.int64))])
    stored = upto[np.searchsorted(past, now, "right")] - upto[np.searchsorted(past, now - BURST_US, "left")]
    return stored + np.arange(1, len(now) + 1) - np.searchsorted(now, now - BURST_US, "left")


def _with_times(times, counts, now: np.ndarray, oldest: int) -> tuple[list[int], list[int]]:
    """Stored and new times in order, each once with its count, from `oldest` on: no later event may
    be older than the watermark, so nothing before its window is needed again."""
    every = np.concatenate([np.asarray(times, dtype=np.int64), now])
    weight = np.concatenate([np.asarray(counts, dtype=np.int64), np.ones(len(now), dtype=np.int64)])
    at, place = np.unique(every, return_inverse=True)
    total = np.zeros(len(at), dtype=np.int64)
    np.add.at(total, place, weight)
    return at[at >= oldest].tolist(), total[at >= oldest].tolist()


def _template_rows(key, frames, state: GroupState):
    if state.hasTimedOut:
        state.remove()
        return
    times, counts, n, mean, m2 = state.get if state.exists else ([], [], 0, 0.0, 0.0)
    rows, names, flat = _sorted(frames, numbers=True)
    known = rows["us"].notna().to_numpy()
    now = rows["us"].to_numpy()[known].astype(np.int64)
    burst = np.ones(len(rows), dtype=np.int64)
    burst[known] = _in_window(times, counts, now)
    times, counts = _with_times(times, counts, now, state.getCurrentWatermarkMs() * 1000 - BURST_US)
    spread = np.zeros(len(rows))
    for row, (start, stop) in enumerate(zip(rows["from"].to_numpy(), rows["to"].to_numpy())):
        for x in flat[start:stop].tolist():
            n += 1
            gap = x - mean
            mean += gap / n
            m2 += gap * (x - mean)
        spread[row] = round(math.sqrt(max(m2 / n, 0.0)), 6) if n >= 2 else 0.0
    state.update((times, counts, n, mean, m2))
    _keep(state, rows)
    yield from _out("template_id", key[0], rows, names, {"burstiness": burst, "volatility": spread})


def _service_rows(key, frames, state: GroupState):
    if state.hasTimedOut:
        state.remove()
        return
    last = state.get[0] if state.exists else None
    rows, names, _ = _sorted(frames)
    deltas = np.zeros(len(rows))
    for row, us in enumerate(rows["us"]):
        if pd.isna(us):
            continue
        seconds = 0.0 if last is None else (int(us) - last) / 1e6
        deltas[row] = round(min(max(seconds, 0.0), MAX_DELTA_SECONDS), 4)
        last = int(us) if last is None else max(last, int(us))  # a late event does not set the service back
    if last is not None:
        state.update((last,))
        _keep(state, rows)
    yield from _out("service", key[0], rows, names, {"time_delta": deltas})


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("timestamp", late).withColumn("us", F.unix_micros("timestamp"))


def template_state(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """Burstiness and volatility per event, with the state of a template kept across batches.

    Rows of one batch are put in time order first; how much one task holds is set by the
    source's rate limit (`maxFilesPerTrigger`). A late event counts what came up to its own time; the
    state keeps a key's distinct times as far back as the watermark and a window before it.
    """
    return (
        _timed(events, late)
        .select("template_id", "us", "source_file", "line_number", "numbers", "timestamp")
        .groupBy("template_id")
        .applyInPandasWithState(
            _template_rows,
            "template_id string, source_file string, line_number bigint, burstiness bigint, volatility double",
            "times array<bigint>, counts array<bigint>, n bigint, mean double, m2 double",
            "append", GroupStateTimeout.EventTimeTimeout,
        )
    )


def service_state(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """Time since the service's previous event, with the last time kept across batches."""
    return (
        _timed(events, late)
        .select("service", "us", "source_file", "line_number", "timestamp")
        .groupBy("service")
        .applyInPandasWithState(
            _service_rows,
            "service string, source_file string, line_number bigint, time_delta double",
            "last bigint", "append", GroupStateTimeout.EventTimeTimeout,
        )
    )


def coarse_counts(events: DataFrame, slide: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Events per template and 10 s window: the aggregate form of burstiness, for dashboards."""
    return (
        events.withWatermark("timestamp", late)
        .groupBy("template_id", F.window("timestamp", "10 seconds", slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("template_id", F.col("w.start").alias("window_start"), "n")
    )


def replay_counts(counts: DataFrame, path: str, checkpoint: str) -> None:
    """Run `coarse_counts` over everything available. Each batch writes the windows it changed with their counts so
    far, the newest ones too, to a folder of its number; a repeated batch overwrites its own."""
    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    counts.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The latest count of every window."""
    return spark.read.parquet(path).groupBy("template_id", "window_start").agg(F.max_by("n", "batch").alias("n"))


def replay(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over everything available into Parquet files and wait for it."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def state_report(query) -> list[dict]:
    """Rows, updates and evictions of each state operator after the last batch."""
    progress = query.lastProgress
    operators = (progress["stateOperators"] if progress else []) or []
    return [
        {"operator": o["operatorName"], "rows": o["numRowsTotal"], "updated": o["numRowsUpdated"],
         "removed": o["numRowsRemoved"], "late": o["numRowsDroppedByWatermark"]}
        for o in operators
    ]
