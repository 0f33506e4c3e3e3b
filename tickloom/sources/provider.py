"""Bars from a price provider, fetched by Spark tasks in chunks of tickers."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from datetime import date
from functools import partial

import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame

from tickloom.sources.tables import BAR

SCHEMA = pa.schema([("ticker", pa.string()), ("d", pa.date32()), *((c, pa.float64()) for c in ("open", "high", "low", "close", "volume"))])


class Throttled(Exception):
    """The provider asks for fewer calls: the same call may succeed later."""


class PriceProvider(ABC):
    """A source of daily bars; its objects travel to the tasks."""

    @abstractmethod
    def history(self, tickers: list[str], first: date, last: date) -> pa.Table:
        """Bars in ``SCHEMA`` of the tickers that the source knows, both dates included."""


class StoredProvider(PriceProvider):
    """A provider over Parquet bars, by month or not, on any path that Arrow reads."""

    def __init__(self, path: str):
        self.path = path

    def history(self, tickers: list[str], first: date, last: date) -> pa.Table:
        stored = pads.dataset(self.path, format="parquet", partitioning="hive")
        day, month = pads.field("d"), pads.field("month")
        wanted = pads.field("ticker").isin(tickers) & (day >= first) & (day <= last)
        if "month" in stored.schema.names:
            wanted &= (month >= f"{first:%Y-%m}") & (month <= f"{last:%Y-%m}")
        return stored.to_table(columns=SCHEMA.names, filter=wanted)


def with_retries(call: Callable[[], pa.Table], tries: int, wait: float) -> pa.Table | None:
    """The call's bars; while it is throttled again after ``wait``, twice that and so on; None where it fails."""
    for k in range(tries):
        try:
            return call()
        except Throttled:
            if k + 1 < tries:
                time.sleep(wait * 2**k)
        except Exception:  # noqa: BLE001 - whatever a provider raises, these tickers have no bars
            return None
    return None


def _fetch(batches: Iterator[pa.RecordBatch], provider: PriceProvider, first: date, last: date, chunk: int, tries: int, wait: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tickers = batch.column(0).drop_null().to_pylist()
        for at in range(0, len(tickers), chunk):
            some = tickers[at : at + chunk]
            found = with_retries(partial(provider.history, some, first, last), tries, wait)
            alone = [] if found is not None or len(some) == 1 else [with_retries(partial(provider.history, [t], first, last), tries, wait) for t in some]
            for bars in [found, *alone]:
                if bars is not None:
                    yield from bars.select(SCHEMA.names).cast(SCHEMA).to_batches()


def fetched(tickers: DataFrame, provider: PriceProvider, first: date, last: date, chunk: int = 50, calls: int = 8, tries: int = 3, wait: float = 2.0) -> DataFrame:
    """Bars of the tickers in the first column of ``tickers``, each asked for once, both dates included.

    At most ``calls`` tasks call the provider at a time, with ``chunk`` tickers a
    call.  A throttled call is repeated up to ``tries`` times, the wait doubling
    from ``wait`` seconds.  Where a chunk fails its tickers are asked for one by
    one; those that fail alone have no rows, as have unknown ones (``missing``).
    """
    names = tickers.toDF("ticker").where("ticker is not null").distinct().repartition(calls, "ticker")
    return names.mapInArrow(partial(_fetch, provider=provider, first=first, last=last, chunk=chunk, tries=tries, wait=wait), BAR)


def missing(tickers: DataFrame, bars: DataFrame) -> DataFrame:
    """The tickers without any bar."""
    return tickers.toDF("ticker").distinct().join(bars.select("ticker").distinct(), "ticker", "left_anti")
