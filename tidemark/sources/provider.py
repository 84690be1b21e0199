"""A data source of price bars behind a registry of providers, by Spark's Python Data Source API.

    spark.dataSource.register(BarsDataSource)
    spark.read.format("tidemark_bars").option("provider", "steps").option("symbols", "A,B").load()
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Row = tuple[str, dt.date, float, float, float, float, float]


def step_bars(symbol: str, start: dt.date, end: dt.date) -> Iterator[Row]:
    """Deterministic weekday bars, for tests and examples."""
    day, k = start, sum(map(ord, symbol)) % 17
    while day <= end:
        if day.weekday() < 5:
            base = 100.0 + k % 23
            yield symbol, day, base, base + 2, base - 1, base + 1, 1000.0 + k
            k += 1
        day += dt.timedelta(days=1)


PROVIDERS: dict[str, Callable[[str, dt.date, dt.date], Iterator[Row]]] = {"steps": step_bars}


class _Symbol(InputPartition):
    def __init__(self, symbol: str):
        super().__init__(symbol)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.provider = options.get("provider", "steps")
        if self.provider not in PROVIDERS:
            raise ValueError(f"unknown provider {self.provider!r}; known: {sorted(PROVIDERS)}")
        self.symbols = [s.strip() for s in options.get("symbols", "").split(",") if s.strip()]
        self.start = dt.date.fromisoformat(options.get("start", "2024-01-01"))
        self.end = dt.date.fromisoformat(options.get("end", "2024-01-31"))

    def partitions(self) -> list[InputPartition]:
        return [_Symbol(s) for s in self.symbols]

    def read(self, partition: InputPartition) -> Iterator[Row]:
        yield from PROVIDERS[self.provider](partition.value, self.start, self.end)


class BarsDataSource(DataSource):
    """Bars of the options ``symbols``, ``start`` and ``end``; one partition a symbol."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_bars"

    def schema(self) -> str:
        return "symbol string, ts date, open double, high double, low double, close double, volume double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
