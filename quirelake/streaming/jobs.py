"""Streams: request batches with in-flight sharing, progress upserts, debounced positions, windowed activity.

Spark-side generalisations of an in-process request queue and progress saver: micro-batches stand for drained queues.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import latest

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str | None) -> StreamingQuery:
    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs = spark._jvm.org.apache.hadoop.fs
    root = fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [str(s.getPath().getName()) for s in files.listStatus(root)] if files.exists(root) else []
    return sorted(int(x[2:]) for x in names if x.startswith("v="))


def last_version(spark: SparkSession, path: str) -> DataFrame:
    """The table as the last batch left it."""
    return spark.read.parquet(f"{path}/v={_versions(spark, path)[-1]}")


def progress(stream: DataFrame, path: str, checkpoint: str, every: str | None = None, keep: int = 3) -> StreamingQuery:
    """Keeps the latest position of each user in a table, a version for each batch; the last ``keep`` versions stay.

    A batch that runs again writes the same folder, so the result is the same after a failure.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", F.pmod("event_id", F.lit(50)).alias("chapter_id"), F.floor("value").alias("position"), "ts")
        before = [k for k in _versions(spark, path) if k < n]
        if before:
            old = spark.read.parquet(f"{path}/v={before[-1]}")
            new = latest(old.unionByName(new), ["user_id"], [F.desc("ts")])
        new.write.mode("overwrite").parquet(f"{path}/v={n}")
        fs = spark._jvm.org.apache.hadoop.fs
        for k in before[: 1 - keep]:
            p = fs.Path(f"{path}/v={k}")
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    return _start(stream, each, checkpoint, every)


def requests(stream: DataFrame, key: str, render: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Each distinct key is rendered once and its result given to all requests for it, those of later batches too; failures are rows with an error.

    A key that failed is rendered again when it is asked for again. Results are kept beside the answers, a folder for each batch.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        first = latest(batch, [key], [F.col("event_id")])
        done = [f"{path}-results/v={k}" for k in _versions(spark, f"{path}-results") if k < n]
        known = spark.read.parquet(*done).select(key, "result", "error") if done else None
        made = render(first.join(known.select(key), key, "left_anti") if known is not None else first).select(key, "result", "error")
        made.where("result is not null").write.mode("overwrite").parquet(f"{path}-results/v={n}")
        made = made.where("result is null").unionByName(spark.read.schema(made.schema).parquet(f"{path}-results/v={n}"))
        if known is not None:
            made = made.unionByName(known.join(first.select(key), key, "left_semi"))
        out = batch.select(key, "event_id").join(made, key, "left")
        out.withColumn("error", F.coalesce("error", F.when(F.col("result").isNull(), "missing result"))).write.mode("overwrite").parquet(f"{path}/v={n}")

    return _start(stream, each, checkpoint, every)


def debounced(rows: DataFrame, wait: str = "250 milliseconds") -> DataFrame:
    """The last position of each user in each burst (bursts end after ``wait``), without repeats of the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    last = F.lead("ts").over(w).isNull() | (F.lead("ts").over(w) > F.col("ts") + F.expr(f"interval {wait}"))
    kept = rows.withColumn("_last", last).where("_last").drop("_last")
    changed = ~F.floor("value").eqNullSafe(F.lag(F.floor("value")).over(w)) | (F.row_number().over(w) == 1)
    return kept.withColumn("_new", changed).where("_new").drop("_new")


def activity(stream: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events of each type by window, deduplicated, with a watermark for late ones."""
    return stream.withWatermark("ts", late).dropDuplicates(["event_id", "ts"]).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
