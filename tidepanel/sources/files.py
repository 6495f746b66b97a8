"""Readers and writers of the file formats: price archives, vendor records, ticker metadata and checkpoints."""

from __future__ import annotations

import csv
import io
import itertools
import json
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OHLCV = "date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, Name STRING"
VENDOR = "date STRING, adjClose DOUBLE, adjVolume DOUBLE"
METADATA = "ticker STRING, exchange STRING, assetType STRING, startDate DATE, endDate DATE"


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A CSV archive of daily prices as ``date, ticker, close, volume``; a wrong file fails, and is never replaced by made-up data."""
    return spark.read.schema(OHLCV).option("header", True).option("mode", "FAILFAST").csv(path).select("date", F.col("Name").alias("ticker"), "close", "volume")


def read_vendor(spark: SparkSession, path: str) -> DataFrame:
    """Folders ``ticker=X`` of JSON records as ``ticker, date, close, volume``; the time zone of a date is dropped, rows without values too."""
    raw = spark.read.schema(VENDOR + ", ticker STRING").json(path)
    return raw.select("ticker", F.to_date(F.substring("date", 1, 10)).alias("date"), F.col("adjClose").alias("close"), F.col("adjVolume").alias("volume")).dropna(how="all", subset=["close", "volume"])


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Ticker metadata from CSV files, or from ZIP files with one CSV inside."""
    if not path.endswith(".zip"):
        return spark.read.schema(METADATA).option("header", True).csv(path)

    def unpacked(batches):
        import pyarrow as pa

        names = [field.split(" ")[0] for field in METADATA.split(", ")]
        for batch in batches:
            for content in batch.column("content"):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    for member in archive.namelist():
                        with archive.open(member) as file:
                            rows = csv.DictReader(io.TextIOWrapper(file, "utf-8", newline=""))  # by the header, whatever its order; quoted fields may break lines
                            while part := list(itertools.islice(rows, 10_000)):
                                yield pa.record_batch([pa.array([r.get(name) or None for r in part], pa.string()) for name in names], names=names)

    names = [field.split(" ")[0] for field in METADATA.split(", ")]
    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpacked, ", ".join(f"{name} STRING" for name in names))
    return rows.select(*[F.col(field.split(" ")[0]).cast(field.split(" ")[1]) for field in METADATA.split(", ")])


#: The file that names a checkpoint's current parts.
POINTER = "CURRENT"


def _at(spark: SparkSession, path: str):
    """Hadoop's file system and path, so that any store that Spark reads will do."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _current(spark: SparkSession, path: str) -> list[str]:
    """The folders of the checkpoint's parts; none before the first is complete."""
    system, pointer = _at(spark, f"{path}/{POINTER}")
    if not system.exists(pointer):
        return []
    reader = spark.sparkContext._jvm.java.io.BufferedReader(spark.sparkContext._jvm.java.io.InputStreamReader(system.open(pointer), "UTF-8"))
    try:
        return json.loads(reader.readLine())
    finally:
        reader.close()


def write_checkpoint(panel: DataFrame, path: str, *, append: bool = False) -> None:
    """A new version of a checkpoint, or with ``append`` a further part of it.

    Rows go to a folder of their own, and only when that is complete does one small file, swapped by a rename, name it. So
    a job that ends halfway leaves the old version as it was; what it wrote is ignored. Folders of older versions stay until
    :func:`clear_checkpoint`, for readers that have begun on them.
    """
    spark = panel.sparkSession
    part = f"part-{uuid.uuid4().hex}"
    panel.write.parquet(f"{path}/{part}")
    parts = [*(_current(spark, path) if append else []), part]
    system, fresh = _at(spark, f"{path}/{POINTER}-{uuid.uuid4().hex}")
    out = system.create(fresh, True)
    try:
        out.write(bytearray(json.dumps(parts).encode()))
    finally:
        out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, _at(spark, f"{path}/{POINTER}")[1], overwrite)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the checkpoint's current version."""
    parts = _current(spark, path)
    if not parts:
        raise FileNotFoundError(f"no complete checkpoint at {path}")
    return spark.read.parquet(*[f"{path}/{part}" for part in parts])


def clear_checkpoint(spark: SparkSession, path: str) -> int:
    """Deletes what no current version names, and tells how many folders or files that were."""
    system, where = _at(spark, path)
    kept, gone = {POINTER, *_current(spark, path)}, 0
    for status in system.listStatus(where) if system.exists(where) else []:
        if status.getPath().getName().removeprefix(".").removesuffix(".crc") not in kept:
            gone += bool(system.delete(status.getPath(), True))
    return gone


def remaining(universe: DataFrame, done: DataFrame) -> DataFrame:
    """The tickers of ``universe`` that a checkpoint doesn't hold."""
    return universe.join(done.select("ticker").distinct(), "ticker", "left_anti")
