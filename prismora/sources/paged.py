"""Paged remote sources as a Python data source; what fetches a page is given, so no network is assumed."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[str, str | None], tuple[list[tuple], str | None]]


class _Part(InputPartition):
    def __init__(self, anchor: str):
        self.anchor = anchor


class _Reader(DataSourceReader):
    def __init__(self, fetch: Fetch, anchors: list[str], most: int | None):
        self.fetch, self.anchors, self.most = fetch, anchors, most

    def partitions(self) -> list[InputPartition]:
        return [_Part(a) for a in self.anchors]

    def read(self, partition: _Part) -> Iterator[tuple]:
        cursor, given = None, 0
        while True:
            rows, cursor = self.fetch(partition.anchor, cursor)
            for r in rows:
                if self.most is not None and given >= self.most:
                    return
                given += 1
                yield (partition.anchor, *r)
            if not cursor or not rows:
                return


class PagedSource(DataSource):
    """One partition an anchor, pages by cursor."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> DataSourceReader:
        fetch, anchors, most = cloudpickle.loads(base64.b64decode(self.options["call"]))
        return _Reader(fetch, anchors, most)


def read_paged(spark: SparkSession, fetch: Fetch, anchors: list[str], columns: str, most: int | None = None) -> DataFrame:
    """anchor and `columns` of all pages that fetch(anchor, cursor) -> (rows, next cursor) gives, `most` rows an anchor (a service's hard limit)."""
    spark.dataSource.register(PagedSource)
    call = base64.b64encode(cloudpickle.dumps((fetch, anchors, most))).decode()
    return spark.read.format("paged").option("columns", f"anchor string, {columns}").option("call", call).load()


def bisected(count: Callable[[int, int], int], low: int, high: int, most: int = 1000) -> list[tuple[int, int]]:
    """Ranges of size that a search with a result limit can answer whole: halved while they have more."""
    out, todo = [], [(low, high)]
    while todo:
        a, b = todo.pop()
        n = count(a, b)
        if n > most and a < b:
            mid = (a + b) // 2
            todo += [(mid + 1, b), (a, mid)]
        elif n:
            out.append((a, b))
    return out


def first_route(routes: list[tuple[str, Callable[[str], str | None]]], key: str, least: int = 2000) -> tuple[str | None, str | None, list[str]]:
    """(route, text, log) of the first route with a long enough text."""
    log = []
    for name, route in routes:
        try:
            text = route(key)
        except Exception as e:  # a route's failure is a log entry, and the next is tried
            log.append(f"{name}: {type(e).__name__}")
            continue
        if text and len(text) >= least:
            return name, text, [*log, f"{name}: ok"]
        log.append(f"{name}: {len(text or '')} characters")
    return None, None, log


def routed(df: DataFrame, key: str, routes: list[tuple[str, Callable[[str], str | None]]], least: int = 2000) -> DataFrame:
    """df with route, text and log: what the first route with a long enough text gives for each row's key, fetched on the executors."""
    names = df.columns

    def run(parts: Iterator) -> Iterator:
        import pandas as pd

        for part in parts:
            got = [first_route(routes, k, least) if k is not None else (None, None, []) for k in part[key]]
            yield pd.concat([part.reset_index(drop=True), pd.DataFrame(got, columns=["route", "text", "log"])], axis=1)

    return df.mapInPandas(run, ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), "route string, text string, log array<string>"]))


def todo(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumable fetch has still to do."""
    return candidates.join(done.select(key).distinct(), key, "left_anti")
