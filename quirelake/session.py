"""Session, table and durability helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "quirelake", cores: str = "*") -> SparkSession:
    """A local session with the settings the library expects; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("QUIRELAKE_SHUFFLE", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One parquet table, narrowed to the named columns so that the scan reads nothing else."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame, *keys: str, per_core: int = 3) -> DataFrame:
    """Enough partitions for Python-heavy maps over a small number of input splits.

    The planner's size of the input is compared with the size of a split: a large input has more splits than cores can
    use and is left alone, so nothing is shuffled there. The rows are the same either way.
    """
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism * per_core
    split = spark.conf.get("spark.sql.files.maxPartitionBytes").lower().rstrip("b")
    split = int(split.rstrip("kmg")) << {"k": 10, "m": 20, "g": 30}.get(split[-1], 0)
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > want * split:
        return df
    return df.repartition(want, *[F.col(k) for k in keys]) if keys else df.repartition(want)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder the cluster names, and read it back.

    The folder is ``spark.checkpoint.dir`` of the session. The table survives the loss of executors, unlike a local
    checkpoint, and is columnar and compressed, unlike a checkpoint. ``release`` removes it, at the latest the end of the application does.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "rows")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[id(out)] = (out, path)
    return out


def release(*tables: DataFrame) -> None:
    """Removes tables that ``durable`` wrote, once nothing reads them any more; without tables all of them."""
    for key in [id(t) for t in tables] or list(_tables):
        if key in _tables:
            df, path = _tables.pop(key)
            _remove(df.sparkSession, path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see, removed when the application ends."""
    path = f"{_shared_folder(spark)}/quirelake-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _shared_folder(spark: SparkSession) -> str:
    """The folder the session names; on one machine (tests) one of our own where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("intermediate tables need a folder that all executors share: set spark.checkpoint.dir")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quirelake-"))
    return _own[0]


_own: list[str] = []
_tables: dict[int, tuple[DataFrame, str]] = {}


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass
