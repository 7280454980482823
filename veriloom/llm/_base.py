"""What the training-data operators share: cut lineage in the shared folder, read tables, keep workers able to import."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (tests on one machine) a temporary folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="veriloom-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


_PATHS: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _PATHS.append(f"{shared_dir(spark)}/veriloom/{name}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def mark() -> int:
    """A point in time for sweep()."""
    return len(_PATHS)


def sweep(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes what was written to the shared folder since a mark, but for the last `keep` tables; frames that read it are void."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = _PATHS[since : len(_PATHS) - keep]
    for p in gone:
        path = fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    _PATHS[since : len(_PATHS) - keep] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs that nothing refers to any more: it finds them when the driver collects garbage."""
    spark.sparkContext._jvm.System.gc()


#: Rows of an Arrow batch: documents are long, and a worker holds some batches at once.
BATCH_ROWS = 1024


def importable(spark: SparkSession) -> None:
    """Python workers find this package under the path that the driver uses, and get batches that fit their memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Gives memory that a Python worker has freed back to the system: workers live on between tasks, and their freed memory would add up."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def summed(rows: DataFrame, fan: int = 64):
    """(n, numbers) added over rows (n long, numbers binary: 64-bit floats, of one length): up a tree, `fan` rows at a time."""
    import numpy as np
    import pandas as pd

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype="<f8") for x in pdf.sort_values(["n", "numbers"])["numbers"])
        return pd.DataFrame({"n": [int(pdf["n"].sum())], "numbers": [total.tobytes()]})

    importable(rows.sparkSession)
    now = written(rows, "sums")
    left = now.count()
    while left > fan:
        left = -(-left // fan)
        now = written(now.groupBy(F.pmod(F.xxhash64("n", "numbers"), F.lit(left))).applyInPandas(add, "n long, numbers binary"), "sums")
    found = sorted((r["n"], bytes(r["numbers"])) for r in now.collect())  # `fan` rows at most
    return sum(n for n, _ in found), sum(np.frombuffer(x, dtype="<f8") for _, x in found)
