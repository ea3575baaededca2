"""What the operators of this subpackage share: reading, hold-out rows and written intermediate tables."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []
_own_dir: list[str] = []


#: Bytes of a batch to Python workers: texts can be long, and a batch is held several times over.
BATCH_BYTES = 16 << 20


def on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where they share its folder; elsewhere it is shipped by --py-files.

    The session's bound on a batch is lowered to ``BATCH_BYTES`` where it is larger, and stays so: results are lazy.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    return spark


def _bytes(setting: str) -> float:
    """A setting like 64m or 67108864b in bytes; none: without a bound."""
    m = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", setting.strip().lower())
    n = int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m[2]] if m and not m[1].startswith("-") else 0
    return n or float("inf")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where none is named and all tasks run here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="inkmeter-"))
        atexit.register(shutil.rmtree, _own_dir[0].removeprefix("file://"), ignore_errors=True)
    return _own_dir[0]


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/inkmeter-{what}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stable(df: DataFrame, what: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    This cuts lineage without executor-local state: a lost executor loses nothing, and values that depend
    on how rows were dealt to tasks can't change on a second evaluation.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete intermediate tables, all that were written so far unless some are named.

    Call it when no result that reads them is needed any more: results are read lazily from the last of them.
    """
    jvm = spark.sparkContext._jvm
    for path in list(_written if paths is None else paths):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _written.remove(path)


def remainder(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; null ids give null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % m


def held_out(id_col: str, m: int, r: int) -> Column:
    """True where crc32(id as text) mod ``m`` is ``r``; rows with a null id count as not held out."""
    return F.coalesce(remainder(id_col, m) == r, F.lit(False))


def whole(col: str) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(col), F.lit(""))
