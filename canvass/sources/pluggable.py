"""Sources that a user plugs in: page readers as Spark data sources, and searchers over a table of queries.

``PageSource`` is a partitioned reader of ``(query, page, status, body)`` rows,
the table that ``sources.responses`` works on.  A subclass names itself, lists
its ``splits`` (on the driver: small descriptions, not data) and yields the
``pages`` of one split (inside a task).  ``CapturedPages`` reads captured pages
from a folder of parquet or JSON-lines files, a split per row group or file.

``search_with`` calls an object that has ``search_businesses`` or, as older
ones, ``search_places`` for every row of a query table, in tasks, and returns
lead columns whatever names the records' fields have.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files
from .responses import FIELD_CANDIDATES

PAGES = pa.schema([("query", pa.string()), ("page", pa.int64()), ("status", pa.int32()), ("body", pa.string())])
BATCH_ROWS = 256  # page bodies are long


class Split(InputPartition):
    """One split of a source; a class of its own, as Spark pickles it."""

    def __init__(self, value: Any):
        super().__init__(value)


class PageSource(DataSource):
    """Subclass it: ``name``, ``splits`` and ``pages``; ``self.options`` holds the reader's options."""

    def schema(self) -> str:
        return "query string, page bigint, status int, body string"

    def splits(self) -> list:
        """What the tasks read, one entry each; runs on the driver."""
        return [None]

    def pages(self, split) -> Iterator[tuple]:
        """(query, page, status, body) rows of a split; runs inside a task."""
        raise NotImplementedError

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self)


class PageReader(DataSourceReader):
    def __init__(self, source: PageSource):
        self.source = source

    def partitions(self) -> list[Split]:
        return [Split(s) for s in self.source.splits()]

    def read(self, partition: Split | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in for a source without splits
            return
        rows = iter(self.source.pages(partition.value))
        while some := list(islice(rows, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), PAGES)], schema=PAGES)


class CapturedPages(PageSource):
    """Pages captured as ``*.parquet`` or ``*.json`` files in the folder ``path`` (a URI that pyarrow reads)."""

    @classmethod
    def name(cls) -> str:
        return "captured_pages"

    def _store(self):
        return arrow_fs.FileSystem.from_uri(self.options["path"])

    def splits(self) -> list:
        store, root = self._store()
        out = []
        for info in store.get_file_info(arrow_fs.FileSelector(root, recursive=True)):
            hidden = info.base_name.startswith(("_", "."))
            if info.type == arrow_fs.FileType.File and not hidden:
                if info.base_name.endswith(".parquet"):
                    groups = pq.ParquetFile(store.open_input_file(info.path)).metadata.num_row_groups
                    out += [(info.path, g) for g in range(groups)]
                elif info.base_name.endswith(".json"):
                    out.append((info.path, None))
        return out

    def pages(self, split) -> Iterator[tuple]:
        path, group = split
        store, _ = self._store()
        if group is not None:
            kept = pq.ParquetFile(store.open_input_file(path)).read_row_group(group, columns=PAGES.names)
            for batch in kept.to_batches(max_chunksize=BATCH_ROWS):
                yield from zip(*[batch.column(n).to_pylist() for n in PAGES.names])
            return
        with store.open_input_stream(path) as f:
            for line in _lines(f):
                row = json.loads(line)
                yield tuple(row.get(n) for n in PAGES.names)


def _lines(stream) -> Iterator[str]:
    """Lines of a byte stream, read in blocks."""
    rest = b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from (w.decode() for w in whole if w.strip())
    if rest.strip():
        yield rest.decode()


def _by_value(obj) -> None:
    """Ship this package, and the module of ``obj`` if it is no installed one, with the tasks."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])
    module = sys.modules.get(getattr(obj, "__module__", None) or type(obj).__module__)
    path = getattr(module, "__file__", None) or ""
    if path and "site-packages" not in path and "dist-packages" not in path and not path.startswith(sys.prefix):
        cloudpickle.register_pickle_by_value(module)


def read_pages(spark: SparkSession, source: type[PageSource] = CapturedPages, **options) -> DataFrame:
    """The pages of a source; ``path``, if given, is qualified as Spark would."""
    _by_value(source)
    spark.dataSource.register(source)
    if "path" in options:
        options["path"] = files.qualified(spark, options["path"])
    return spark.read.format(source.name()).options(**{k: str(v) for k, v in options.items()}).load()


def _search(searcher, query: str, max_results: int) -> list[dict]:
    if hasattr(searcher, "search_businesses"):
        return searcher.search_businesses(query, max_results=max_results)
    return searcher.search_places(query, max_results)


def search_with(queries: DataFrame, searcher, max_results: int = 20, partitions: int | None = None,
                query_col: str = "query") -> DataFrame:
    """(query, rank, lead columns, error) of every query: what ``searcher`` returns, at most ``max_results`` each.

    ``partitions``: the most searches in flight.  A null or blank query is not
    searched.  A search that raises gives one row with its ``error``; the
    others go on.
    """
    if not (hasattr(searcher, "search_businesses") or hasattr(searcher, "search_places")):
        raise AttributeError("a searcher needs search_businesses or search_places")
    if max_results <= 0:
        raise ValueError("max_results must be > 0")
    _by_value(searcher)
    wanted = queries.select(F.col(query_col).cast("string").alias("query")).where(F.trim("query") != "").distinct()
    if partitions:
        wanted = wanted.repartition(partitions, "query")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query in batch.column(0).to_pylist():
                try:
                    found, error = list(_search(searcher, query, max_results))[:max_results], None
                except Exception as e:  # one failed search never stops the job
                    found, error = [{}], f"Exception during search: {e}"
                n = len(found)
                cells = [[(k, None if v is None else str(v)) for k, v in r.items()] for r in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([query] * n, pa.string()), pa.array(range(1, n + 1), pa.int32()),
                     pa.array(cells, pa.map_(pa.string(), pa.string())), pa.array([error] * n, pa.string())],
                    names=["query", "rank", "record", "error"])

    raw = wanted.mapInArrow(ask, "query string, rank int, record map<string,string>, error string")
    columns = []
    for name, candidates in FIELD_CANDIDATES.items():
        first = F.coalesce(*[F.col("record")[c] for c in candidates])
        kind = {"rating": "double", "review_count": "bigint"}.get(name)
        columns.append((first.try_cast(kind) if kind else F.coalesce(first, F.lit(""))).alias(name))
    return raw.select("query", "rank", *columns, "error")
