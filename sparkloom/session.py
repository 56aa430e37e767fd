"""Makes the package importable in the executors' Python workers, wherever they run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
#: Bytes of a batch between the JVM and Python: whole texts come in batches of even size, however long they are.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once per application, and sets the size of the batches that it gets there."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        work = Path(tempfile.mkdtemp(prefix="loom-ship-"))
        shutil.copytree(root, work / "src" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(str(work / root.name), "zip", work / "src", root.name))
        _SHIPPED.add(sc.applicationId)
    return spark


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a local one only where it is unset and Spark runs on
    this machine alone, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("intermediate tables need a folder that all executors share: set spark.checkpoint.dir")
            own = tempfile.mkdtemp(prefix="loom-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            spark.sparkContext.setCheckpointDir("file://" + own)
        root = context.getCheckpointDir().get()
    return root.rstrip("/")


_STORED: dict[str, SparkSession] = {}


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df once as a table in the shared folder and reads it again, which ends its lineage. The table is deleted when
    the driver ends, or before by forget()."""
    path = f"{scratch(df.sparkSession)}/loom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED[path] = df.sparkSession
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by stored() that no later step reads."""
    for df in tables:
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            for path in [p for p in _STORED if p.rsplit("/", 1)[1] == folder.rsplit("/", 1)[1]]:
                _delete(path)


def _delete(path: str) -> None:
    spark = _STORED.pop(path)
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


@atexit.register
def _forget_all() -> None:
    for path in list(_STORED):
        try:
            _delete(path)
        except Exception:  # the session, and with it the way to the folder, may be gone
            _STORED.pop(path, None)


#: Estimated bytes up to which a counted side is broadcast.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """df with a broadcast hint if its counted rows are few, else as it is. df should be cheap to count, as a stored table is."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def spread(spark: SparkSession) -> int:
    """Partitions for rows that make much work of few bytes, which are neither split by bytes nor coalesced."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
