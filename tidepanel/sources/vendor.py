"""A vendor of price series, asked ticker by ticker, as a Spark data source.

Tickers are dealt to partitions when the scan is planned. Filters on ``date`` and ``ticker`` reach the reader, so the
vendor is asked for the wanted range only; Spark applies them again to what comes. A busy vendor is asked again after a
pause that doubles; a ticker that the vendor doesn't know gives no rows. How a series is fetched is a function of the
user's: it gets any credential from their configuration, and a test gives it files.
"""

from __future__ import annotations

import datetime
import time
import zlib
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "ticker string, date date, close double, volume double"
#: A series' rows: date, close and volume, for a ticker and a range of dates, of which either end may be open.
Fetch = Callable[[str, datetime.date | None, datetime.date | None], Iterable[tuple[datetime.date, float | None, float | None]]]


class Busy(Exception):
    """The vendor asks to wait; ``pause`` seconds if it says how long."""

    def __init__(self, pause: float | None = None) -> None:
        super().__init__("the vendor is busy")
        self.pause = pause


class Unknown(Exception):
    """The vendor has no such ticker."""


class _Bucket(InputPartition):
    def __init__(self, tickers: list[str]) -> None:
        super().__init__(None)
        self.tickers = tickers


class _Reader(DataSourceReader):
    def __init__(self, fetch: Fetch, tickers: list[str], buckets: int, attempts: int, pause: float) -> None:
        self.fetch, self.tickers, self.buckets, self.attempts, self.pause = fetch, tickers, buckets, attempts, pause
        self.since: datetime.date | None = None
        self.until: datetime.date | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        day = datetime.timedelta(days=1)
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if name == ("date",) and value is not None:
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    low = value + day if isinstance(f, GreaterThan) else value
                    self.since = low if self.since is None else max(self.since, low)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    high = value - day if isinstance(f, LessThan) else value
                    self.until = high if self.until is None else min(self.until, high)
            elif name == ("ticker",) and isinstance(f, (EqualTo, In)):
                named = {value} if isinstance(f, EqualTo) else set(value)
                self.tickers = [t for t in self.tickers if t in named]
            yield f  # Spark checks each again

    def partitions(self) -> list[InputPartition]:
        dealt: dict[int, list[str]] = {}
        for ticker in self.tickers:
            dealt.setdefault(zlib.crc32(ticker.encode()) % self.buckets, []).append(ticker)
        return [_Bucket(tickers) for _, tickers in sorted(dealt.items())] or [_Bucket([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for ticker in partition.tickers:
            for date, close, volume in self._asked(ticker):
                if close is not None or volume is not None:
                    yield ticker, date, close, volume

    def _asked(self, ticker: str) -> list[tuple]:
        for attempt in range(1, self.attempts + 1):
            try:
                return list(self.fetch(ticker, self.since, self.until))
            except Unknown:
                return []
            except (Busy, OSError) as error:
                if attempt == self.attempts:
                    raise
                given = getattr(error, "pause", None)
                time.sleep(self.pause * 2 ** (attempt - 1) if given is None else given)
        return []


def vendor_source(name: str, fetch: Fetch, tickers: list[str], *, buckets: int = 64, attempts: int = 5, pause: float = 1.0) -> type[DataSource]:
    """A data source to be registered under ``name``: the series of ``tickers``, in up to ``buckets`` partitions."""

    class Vendor(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(fetch, tickers, buckets, attempts, pause)

    return Vendor


def read_series(spark: SparkSession, fetch: Fetch, tickers: DataFrame, done: DataFrame | None = None, **options) -> DataFrame:
    """``ticker, date, close, volume`` of ``tickers(ticker)``, without those that ``done(ticker, ...)`` holds already. The list of tickers, not of rows, is planned on the driver."""
    left = tickers.select("ticker").distinct() if done is None else tickers.select("ticker").distinct().join(done.select("ticker").distinct(), "ticker", "left_anti")
    names = sorted(r["ticker"] for r in left.collect())
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source = vendor_source(f"vendor_{zlib.crc32(repr(names).encode()):08x}", fetch, names, **options)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load()
