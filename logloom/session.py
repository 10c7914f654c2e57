"""Session helpers: shared folder for checkpoints, and broadcast behind a size check."""

from __future__ import annotations

import contextlib
import gc
import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

# A side may be broadcast only below this many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A private one stands in for it in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="logloom-"))
        current = context.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/logloom-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read on from there (reliable checkpoint)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet to the shared folder and read on from there.

    Cuts the lineage like a checkpoint, but later reads prune columns and push filters down. Inside
    `written()` the folder is noted, so that it can be removed when nothing reads it any more.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_WRITTEN: list[list[str]] = []


@contextlib.contextmanager
def written():
    """The folders that `stored` writes meanwhile, as a list that grows."""
    _WRITTEN.append([])
    try:
        yield _WRITTEN[-1]
    finally:
        _WRITTEN.pop()


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders that `stored` wrote. Shuffle files of their frames go when the driver finds these
    unused, so it is asked to look."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """`stored(build(), name)`, and everything that `build` wrote on the way is removed."""
    with written() as inner:
        df = build()
        path = scratch_path(df.sparkSession, name)
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    del df
    remove(out.sparkSession, inner)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    return out


def unused(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds `name`: 0, 1, 2, ... by `order` (columns or names). Ranges of rows are sorted in parallel and only
    their sizes are summed up, so no task sees more than its range."""
    ranged = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))  # one row per partition
    before = F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return ranged.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + place).drop("_range", "_before")


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether `df` has at most `max_rows` rows, and these at most `max_bytes` bytes written out as JSON;
    counts no more rows than that bound."""
    width = F.octet_length(F.to_json(F.struct("*")))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def spread(df: DataFrame) -> DataFrame:
    """Rows of an input with fewer splits than the session has cores, dealt out to all cores.

    Text work costs far more than the shuffle of a few small files; inputs that already have
    enough splits stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def hint_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint if the checked rows and bytes allow it; otherwise Spark shuffles."""
    return F.broadcast(df) if fits(df, max_rows) else df


def hot_safe_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    weight: str,
    spread: F.Column,
    how: str = "left",
    share: int = 1000,
    salts: int = 64,
) -> DataFrame:
    """Join to a unique-key table whose `weight` says how many left rows hold each key.

    Keys holding more than 1/`share` of all rows are hot. There can be at most `share` of
    them, so that list is safe to broadcast; their rows are spread over `salts` copies of
    the right row. All other keys join as they are.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = right.filter(F.col(weight) * share > F.lit(total)).select(
        F.col(key), F.lit(True).alias("_hot")
    )
    salted_left = left.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(0).cast("int")
    )
    salted_right = right.withColumn(
        "_salt",
        F.explode(
            F.when(
                F.col(weight) * share > F.lit(total), F.sequence(F.lit(0), F.lit(salts - 1))
            ).otherwise(F.array(F.lit(0)))
        ),
    )
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt", "_hot")


def attach(left: DataFrame, right: DataFrame, key: str, spread: F.Column) -> DataFrame:
    """Inner join to a unique-key table, safe for keys that many left rows share."""
    left = cut(left)
    held = left.groupBy(key).agg(F.count(F.lit(1)).alias("_held"))
    return hot_safe_join(left, right.join(held, key), key, "_held", spread, "inner").drop("_held")


def first_rows(df: DataFrame, value: F.Column, order: list, n: int) -> DataFrame:
    """The first `n` rows by `order`, whose leading term is `value` ascending.

    A plain ordered limit sends `n` rows of every partition to one task. Here an approximate
    quantile first drops rows that cannot be among them: a bound is kept only if at least `n`
    rows lie at or below it, so the result is the same, and the last step sees about `n` rows.
    """
    rows, total = df, df.count()
    while total > 4 * n:
        share = min(1.0, 1.2 * n / total + 2e-4)
        bound = rows.agg(F.percentile_approx(value, share, 10_000)).first()[0]
        nearer = rows.filter(value <= F.lit(bound))
        size = nearer.count()
        if size < n or size > 0.9 * total:
            break
        rows, total = nearer, size
    return rows.orderBy(*order).limit(n)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session, once.

    Does what `--py-files` does at submission, for sessions that were started without it.
    """
    context = spark.sparkContext
    if getattr(context, "_logloom_shipped", False):
        return
    folder = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="logloom-code-")) / "logloom-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(folder.rglob("*.py")):
            out.write(source, source.relative_to(folder.parent))
    context.addPyFile(str(archive))
    context._logloom_shipped = True
