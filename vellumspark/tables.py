"""Reading tables, picking current rows, cutting lineage."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir` (one file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_rows(df: DataFrame, keys: Sequence[str], ts: str, payload: Sequence[str] = ()) -> DataFrame:
    """For each key the row with the latest `ts`, with columns keys + payload (all columns if no payload is named).

    Repeated rows collapse to one. A null timestamp is older than any other. Rows of one key with the same timestamp but
    other values: the one whose payload sorts first wins, so the result does not depend on partitioning. The filter on
    row_number becomes a WindowGroupLimit, which drops all but one row a key before the shuffle; a key that holds a
    third of all rows is cut down to one row in each map task.
    """
    cols = list(payload) or [c for c in df.columns if c not in keys]
    ties = [F.col(c).asc_nulls_last() for c in cols if c != ts and not df.schema[c].dataType.typeName() == "map"]
    rn = "__current_rn"
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc_nulls_last(), *ties)
    return df.select(*keys, *dict.fromkeys([*cols, ts])).withColumn(rn, F.row_number().over(w)).where(F.col(rn) == 1).select(*keys, *cols)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: spark.checkpoint.dir. Where it is unset, a temporary one on one machine, an error on a cluster, whose executors share none."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="vellum-checkpoint-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder and read again: its lineage ends there and survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """`df` written as a compressed table below the checkpoint folder and read again: for what is read more than once and is much smaller in columns. Removed when Python ends."""
    return measured(df)[0]


def measured(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """`df` written as `written` does, with aggregates over its rows that the same job takes."""
    folder = own_folder(df.sparkSession)
    seen = Observation()
    rows = df.observe(seen, *[c.alias(n) for n, c in metrics.items()]) if metrics else df
    rows.write.option("compression", "zstd").parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    return table, observed(seen, lambda: table.agg(*[c.alias(n) for n, c in metrics.items()]).first().asDict()) if metrics else {}


def own_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, removed when Python ends."""
    folder = f"{ensure_checkpoint_dir(spark)}/vellum-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    return folder


def observed(seen: Observation, otherwise: Callable[[], dict]) -> dict:
    """What an observation saw. Where adaptive execution found its rows to be empty and dropped it from the plan, `otherwise` counts them."""
    try:
        return seen.get
    except Exception:  # noqa: BLE001 - the JVM's assertion that there is a row
        return otherwise()


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more, which it does when the driver's memory is collected."""
    gc.collect()
    spark._jvm.System.gc()


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may be gone
        pass
