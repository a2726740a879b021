"""A paged service as a Spark source: one partition for each query, whose pages lead from one to the next.

Pages of a query can't be asked for side by side, since each names the next; queries can. A page that fails is tried again
after growing waits. When it keeps failing, what was read so far is the result, marked as not complete. A query's
rows are at most `limit`, and a task holds one page at a time beside the rows of its own query.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from winnow.sources.folders import file_system

SCHEMA = "query string, page int, place int, entry string, complete boolean, error string"


@dataclass(frozen=True)
class Page:
    """Entries as JSON text, and the token of the page that follows, None after the last."""

    entries: list[str]
    next: str | None


#: Gives the page of a query at a token (None: the first); anything that it raises counts as a failed try.
Fetch = Callable[[str, str | None], Page]


@dataclass
class OneQuery(InputPartition):
    query: str


def pages_of(query: str, fetch: Fetch, limit: int, tries: int, wait: float, pace: float, sleep=time.sleep) -> Iterator[tuple]:
    """Rows of SCHEMA for a query. Waits are wait, 2 wait, 4 wait... seconds between tries, pace seconds between pages.

    A query that fails before its first entry gives one row, with a null entry, so it can be told from an empty one.
    """
    token, seen, page, found, error = None, set(), 0, [], None
    while len(found) < limit:
        for turn in range(tries):
            try:
                got = fetch(query, token)
                break
            except Exception as e:  # whatever the service's client raises
                error = f"{type(e).__name__}: {e}"
                if turn + 1 < tries:
                    sleep(wait * 2**turn)
        else:
            break
        error = None
        found += [(page, place, entry) for place, entry in enumerate(got.entries[: limit - len(found)])]
        if got.next is None:
            break
        if got.next in seen:
            error = f"page {got.next} comes again"
            break
        seen.add(got.next)
        token, page = got.next, page + 1
        if len(found) < limit:
            sleep(pace)
    if error and not found:
        yield query, page, 0, None, False, error
    for at, place, entry in found:
        yield query, at, place, entry, error is None, error


def read_pages(spark: SparkSession, queries: list[str], fetch: Fetch, limit: int = 500, tries: int = 3, wait: float = 1.0, pace: float = 0.5, name: str = "paged") -> DataFrame:
    """(query, page, place, entry, complete, error) of all queries, read by as many tasks. fetch goes to the tasks with the source."""
    if limit < 1 or tries < 1:
        raise ValueError("limit and tries are at least 1")
    asked = list(dict.fromkeys(queries))

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [OneQuery(q) for q in asked]

        def read(self, partition: OneQuery) -> Iterator[tuple]:
            return pages_of(partition.query, fetch, limit, tries, wait, pace)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    if not asked:
        return spark.createDataFrame([], SCHEMA)
    spark.dataSource.register(Source)
    return spark.read.format(name).load()


class LandedPages:
    """fetch over pages that were landed as Parquet (query, page, entries array<string>), in order of query and page."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, query: str, token: str | None) -> Page:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        files, path = file_system(self.path)
        page = int(token or 0)
        wanted = (pc.field("query") == query) & pc.field("page").isin([page, page + 1])
        # row groups of other queries are skipped by their statistics
        rows = {r["page"]: r["entries"] for r in ds.dataset(path, filesystem=files, format="parquet").to_table(filter=wanted).to_pylist()}
        return Page(rows.get(page) or [], str(page + 1) if page + 1 in rows else None)
