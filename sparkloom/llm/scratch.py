"""Tables kept between jobs in the shared folder that the cluster names.

A job that cuts its lineage writes Parquet below ``spark.checkpoint.dir``, so a
lost executor costs a re-read and never a recomputation of everything before.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, and only where
    that is unset the warehouse (a cluster) or a temporary folder (local mode)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        made = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    else:
        made = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_sparkloom_scratch"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may have ended before the interpreter
        pass


class Scratch:
    """Named tables of one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, self.base)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Free a table that no later plan reads."""
        _remove(self.spark, f"{self.base}/{name}")


def importable(spark: SparkSession) -> None:
    """Ship the package to Python workers that won't find it: those of a driver
    that has it from neither its working folder nor PYTHONPATH."""
    root = Path(__file__).resolve().parents[2]
    places = [Path.cwd(), *map(Path, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))]
    context = spark.sparkContext
    if any((p / "sparkloom").is_dir() for p in places) or getattr(context, "_sparkloom_shipped", False):
        return
    made = Path(tempfile.mkdtemp(prefix="sparkloom-")) / "sparkloom.zip"
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted((root / "sparkloom").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(made))
    context._sparkloom_shipped = True


#: Bytes of an Arrow batch on its way to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole documents small, and workers able to import
    this package. The limit is one of the session, read when a plan starts; every
    operator sets the same one, and only where a larger one holds."""
    importable(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").strip().lower()
    unit = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = now.rstrip("kmgb")
    size = int(digits) * unit.get(now[len(digits) :][:1], 1) if digits.isdigit() else -1
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
