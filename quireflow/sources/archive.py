"""Archives that are read page by page: a data source with a partition for each page, for tables and for streams.

After `register(spark)` it is read with format "archive". Another transport is a subclass with its own `last_page` and `fetch`.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual


def register(spark: SparkSession, source: type[Archive] | None = None) -> None:
    """Makes an archive known to the session, and lets filters be pushed down to sources in Python, which reading it needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source or ParquetArchive)


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        super().__init__(number)
        self.number = number


class Wanted(NamedTuple):
    """Numbers of pages from low to below high and, where `only` is given, among these."""

    low: int
    high: int
    only: frozenset[int] | None = None

    def numbers(self) -> Iterable[int]:
        if self.only is None:
            return range(self.low, self.high)
        return sorted(n for n in self.only if self.low <= n < self.high)


class Archive(DataSource):
    """(page, page_id, url, html) of an archive whose pages are numbered from 0. Executors fetch each page on its own; a page that cannot be fetched fails its task, which Spark tries again.

    An archive that holds many pages in a piece overrides `pieces` and `read_piece`, so that each piece is opened once and not once for every page in it.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "page long, page_id long, url string, html string"

    def last_page(self) -> int:
        """The number of the last page that is there, -1 for none."""
        raise NotImplementedError

    def fetch(self, number: int) -> Iterable[pa.RecordBatch]:
        """The rows of one page, with the columns of the schema."""
        raise NotImplementedError

    def pieces(self, wanted: Wanted) -> list[InputPartition]:
        """What tasks read, each on its own, to have all pages that are wanted."""
        return [Page(n) for n in wanted.numbers()]

    def read_piece(self, piece: InputPartition) -> Iterable[pa.RecordBatch]:
        """The rows of the wanted pages in a piece; what is no piece has none, as Spark asks for where there are no pieces."""
        return self.fetch(piece.number) if isinstance(piece, Page) else ()

    def reader(self, schema) -> DataSourceReader:
        return Pages(self)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return NewPages(self)


class Pages(DataSourceReader):
    """All pages, or those that filters on `page` leave; other filters are Spark's."""

    def __init__(self, archive: Archive) -> None:
        self.archive, self.low, self.high, self.only = archive, 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if not isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) or f.attribute != ("page",):
                yield f
                continue
            values = {*f.value} if isinstance(f, In) else {f.value}
            if isinstance(f, EqualTo | In):
                self.only = values if self.only is None else self.only & values
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            else:
                past = f.value + isinstance(f, LessThanOrEqual)
                self.high = past if self.high is None else min(self.high, past)

    def partitions(self) -> list[InputPartition]:
        past = self.archive.last_page() + 1
        high = past if self.high is None else min(past, self.high)
        return self.archive.pieces(Wanted(self.low, high, None if self.only is None else frozenset(self.only)))

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return iter(self.archive.read_piece(partition))


class NewPages(DataSourceStreamReader):
    """Pages as they come; an offset is the number of pages that have been read."""

    def __init__(self, archive: Archive) -> None:
        self.archive = archive

    def initialOffset(self) -> dict:  # noqa: N802
        return {"pages": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"pages": self.archive.last_page() + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.archive.pieces(Wanted(start["pages"], end["pages"]))

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return iter(self.archive.read_piece(partition))

    def commit(self, end: dict) -> None:
        pass


class Groups(InputPartition):
    """Row groups of one file, and the pages that are wanted of them."""

    def __init__(self, path: str, groups: list[int], wanted: Wanted) -> None:
        super().__init__((path, groups, wanted))
        self.path, self.groups, self.wanted = path, groups, wanted


#: Bytes, before compression, of the row groups that a task reads, if it reads several, and of the rows that it holds at a time.
PIECE_BYTES, HELD_BYTES = 32_000_000, 4_000_000


class ParquetArchive(Archive):
    """Pages out of a Parquet table of (page_id, url, html): option `path`, one that pyarrow can open, and `size`, so many ids a page. A row without id is on none.

    A task reads whole row groups, each once and some rows at a time, and tells for each row what page it is on: the work grows with the table, in whatever order its ids are.
    Row groups whose ids are known to be on no wanted page are not read.
    """

    def _data(self):
        import pyarrow.dataset as ds

        return ds.dataset(self.options["path"].removeprefix("file://"), format="parquet")

    @property
    def size(self) -> int:
        return int(self.options.get("size", "100"))

    def _groups(self) -> Iterator[tuple[str, int, int, tuple[int, int] | None]]:
        """(file, number, bytes, first and last page or None if not known) of all row groups with rows."""
        for file in self._data().get_fragments():
            for g in file.row_groups:
                ids = (g.statistics or {}).get("page_id")
                if g.num_rows:
                    yield file.path, g.id, g.total_byte_size, (ids["min"] // self.size, ids["max"] // self.size) if ids and ids["max"] is not None else None

    def last_page(self) -> int:
        import pyarrow.compute as pc

        last, unknown = -1, {}
        for path, group, _, span in self._groups():
            if span:
                last = max(last, span[1])
            else:
                unknown.setdefault(path, []).append(group)
        for path, groups in unknown.items():
            for batch in self._open(path).iter_batches(row_groups=groups, columns=["page_id"], use_threads=False):
                ids = batch.column(0).drop_null()
                last = max(last, pc.max(ids).as_py() // self.size if len(ids) else -1)
        return last

    def pieces(self, wanted: Wanted) -> list[InputPartition]:
        numbers = wanted.numbers()
        out, held = [], 0
        for path, group, n, span in self._groups():
            if not len(numbers) or (span and bisect_right(numbers, span[1]) <= bisect_left(numbers, span[0])):
                continue
            if out and out[-1].path == path and held + n <= PIECE_BYTES:
                out[-1].groups.append(group)
                held += n
            else:
                out.append(Groups(path, [group], wanted))
                held = n
        return out

    def read_piece(self, piece: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(piece, Groups):
            yield from self._rows(piece.path, piece.groups, piece.wanted)

    def fetch(self, number: int) -> Iterator[pa.RecordBatch]:
        for piece in self.pieces(Wanted(number, number + 1)):
            yield from self.read_piece(piece)

    def _open(self, path: str):
        import pyarrow.parquet as pq

        return pq.ParquetFile(path, filesystem=self._data().filesystem, buffer_size=1 << 20, pre_buffer=False)

    def _rows(self, path: str, groups: list[int], wanted: Wanted) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        file = self._open(path)
        rows, total = (sum(x) for x in zip(*((g.num_rows, g.total_byte_size) for g in map(file.metadata.row_group, groups)), strict=True))
        only = None if wanted.only is None else pa.array(wanted.numbers(), pa.int64())
        for batch in file.iter_batches(max(1, min(256, HELD_BYTES * rows // max(1, total))), row_groups=groups, columns=["page_id", "url", "html"], use_threads=False):
            batch = batch.filter(pc.is_valid(batch.column("page_id")))
            page_id = batch.column("page_id").cast(pa.int64())
            page = pa.array(page_id.to_numpy() // self.size, pa.int64())
            own = pc.and_(pc.greater_equal(page, wanted.low), pc.less(page, wanted.high))
            own = pc.and_(own, pc.is_in(page, only)) if only is not None else own
            found = pa.RecordBatch.from_arrays([page, page_id, batch.column("url"), batch.column("html")], names=["page", "page_id", "url", "html"]).filter(own)
            if found.num_rows:
                yield found
