"""Tables between the steps of a long plan, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``. Where that is unset, below the warehouse, which a
    cluster's machines share; with a local master, which is one machine, below a temporary folder."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and spark.sparkContext.master.startswith("local["):
            root = f"file://{tempfile.mkdtemp(prefix='tidepanel-')}"
        root = root or spark.conf.get("spark.sql.warehouse.dir")
        _folders[app] = f"{root.rstrip('/')}/panel-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended before; the folder stays for the cluster's own clean-up
        pass


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written once and read back. What follows is planned from the table, and lost executors cost nothing."""
    path = new_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def merged(frame: DataFrame) -> DataFrame:
    """``frame`` for a join with rows of names and dates, of which it has about as many: both are shuffled and merged.

    A written table of few bytes a row would be taken for small by the size of its files, sent whole to the driver and broadcast.
    """
    return frame.hint("merge")


#: Rows of a task, about, that goes through windows.
ROWS = 250_000


def spread(frame: DataFrame, *keys: str, count: int | None = None) -> DataFrame:
    """A written table ``frame`` by ``keys`` in as many parts as shuffles have, and more where parts would hold more than ``ROWS``.

    For windows with long work on few bytes, which would be coalesced into a task, and for tasks whose rows may not grow with the table.
    With ``count``, how many rows each becomes in all by later steps, ``frame`` needn't be written and up to ``ROWS`` stay as Spark deals them.
    """
    if count is not None and count <= ROWS:
        return frame.repartition(*keys)
    parts = max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(frame.count() if count is None else count) // ROWS))
    return frame.repartition(parts, *keys)


def bounded(frame: DataFrame, *keys: str) -> DataFrame:
    """:func:`spread` of a written table of more than ``ROWS`` rows; a smaller one as it is."""
    return spread(frame, *keys) if frame.count() > ROWS else frame
