"""Session helpers: table loading and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import io
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a local session gets a temporary folder of
    its own; on a cluster, whose machines share no such folder, that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = temporary_dir()
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def temporary_dir() -> str:
    """A folder of this machine, removed at exit; for local sessions only."""
    where = tempfile.mkdtemp(prefix="riskframe-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    return "file://" + where


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once per application, whether or not it is installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_riskframe_shipped", False):
        return
    root = Path(__file__).parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/riskframe-{uuid.uuid4().hex}.zip")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(buffer.getvalue()))
    out.close()
    sc.addPyFile(path.toString())
    sc._riskframe_shipped = True


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


class Scratch:
    """Written intermediate tables of one operator run.

    ``cut`` writes a DataFrame to the shared folder and reads it back, so that later rounds start from
    files, which outlive any executor, and so that sizes are known to the planner. ``drop`` removes a
    table that a later round has replaced. What the returned result still reads stays in the folder, which
    belongs to the application's run.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n:04d}"

    def cut(self, df: DataFrame) -> DataFrame:
        at = self.path()
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        return out

    def counted(self, df: DataFrame, condition) -> tuple[DataFrame, int]:
        """``cut``, and how many of the written rows meet a condition. They are counted as written: metrics of the write itself
        may count a row twice where a lost executor's tasks run again."""
        out = self.cut(df)
        return out, out.where(condition).count()

    def split(self, df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
        """Writes a DataFrame once, by a flag, and reads the rows where it holds and where it doesn't as two tables,
        so that the planner knows the size of each."""
        at = self.path()
        df.write.partitionBy(flag).parquet(at)
        kept = [f for f in df.schema if f.name != flag]
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = []
        for value in ("true", "false"):
            part = f"{at}/{flag}={value}"
            there = fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(part))
            rows = self.spark.read.schema(StructType(kept)).parquet(part) if there else self.spark.createDataFrame([], StructType(kept))
            rows = rows.withColumn(flag, F.lit(value == "true")).select(*df.columns)
            rows._scratch_path = part
            out.append(rows)
        return out[0], out[1]

    def drop(self, df: DataFrame | None) -> None:
        at = getattr(df, "_scratch_path", None)
        if at:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def session(app: str = "riskframe", cpus: int | None = None) -> SparkSession:
    """A local session for tests and the bench."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", os.environ.get("RISKFRAME_SHARED_DIR") or temporary_dir())
        .getOrCreate()
    )
