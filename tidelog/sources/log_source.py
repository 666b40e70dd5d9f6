"""The observation log as a data source: ``spark.read.format("observation_log")``
and ``spark.readStream`` after :func:`register`.

The log is a folder of Parquet files as :func:`tidelog.operators.scans.append`
writes it (``data_type`` and ``day`` in the paths), or a plain folder of them.

Options: ``path``; ``form`` (``typed``, the default, or ``raw``); ``start`` for
streams (``earliest``, the default, or ``tip``: nothing that is there already).

A stream goes forward by the cursor (created_at, id), which is its offset, and
exclusive: rows of equal created_at are told apart by id.  Rows without either
are read in batches only.  As appends stamp created_at when they write, a row
that is appended later with a cursor that passed isn't read by the stream.
Row groups are read in pieces of about 64 MiB (``PIECE``); groups whose
statistics lie outside the cursors or the pushed filters on data_type, ts and
created_at are not read.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tidelog import schema as S

NAME = "observation_log"
Cursor = tuple[int, str]
#: Uncompressed bytes of the row groups that a task reads, unless one alone is larger.
PIECE = 64 << 20
#: Before every row.
ORIGIN: Cursor = (-(2**63), "")
ARROW = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


@dataclass(frozen=True)
class Group:
    """A row group and the bounds of its columns, as far as they are known."""

    path: str
    index: int
    from_path: tuple[tuple[str, str | None], ...]
    bounds: tuple[tuple[str, object, object], ...]
    size: int

    def may_hold(self, column: str, low: object | None, high: object | None) -> bool:
        for name, least, most in self.bounds:
            if name == column:
                return not (low is not None and most < low or high is not None and least > high)
        return True


@dataclass
class Piece(InputPartition):
    """What one task reads: row groups, between two cursors for streams."""

    groups: list[Group]
    after: Cursor | None = None
    upto: Cursor | None = None


def pieces(groups: list[Group], after: Cursor | None = None, upto: Cursor | None = None) -> list[Piece]:
    made, size = [], PIECE
    for g in groups:
        if size + g.size > PIECE:
            made.append(Piece([], after, upto))
            size = 0
        made[-1].groups.append(g)
        size += g.size
    return made


class Folder:
    """The files of a log.  They never change, so each footer is read once."""

    BOUNDED = ("ts", "created_at", "data_type")

    def __init__(self, uri: str):
        self.uri, self.known = uri, {}

    def open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.uri) if "://" in self.uri else (pafs.LocalFileSystem(), self.uri)

    def _footer(self, fs: pafs.FileSystem, top: str, path: str) -> list[Group]:
        keys = [p.split("=", 1) for p in posixpath.relpath(path, top).split("/")[:-1] if "=" in p]
        from_path = tuple((k, None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v)) for k, v in keys)
        with fs.open_input_file(path) as f:
            meta = pq.ParquetFile(f).metadata
        groups = []
        for i in range(meta.num_row_groups):
            bounds = [(k, v, v) for k, v in from_path if k == "data_type" and v is not None]
            for j in range(meta.num_columns):
                column = meta.row_group(i).column(j)
                stats = column.statistics
                if column.path_in_schema in self.BOUNDED and stats is not None and stats.has_min_max:
                    bounds.append((column.path_in_schema, stats.min, stats.max))
            groups.append(Group(path, i, from_path, tuple(bounds), meta.row_group(i).total_byte_size))
        return groups

    def groups(self) -> list[Group]:
        fs, top = self.open()
        found = fs.get_file_info(pafs.FileSelector(top, recursive=True, allow_not_found=True))
        hidden = lambda p: any(x.startswith(("_", ".")) and "=" not in x for x in posixpath.relpath(p, top).split("/"))
        paths = sorted(i.path for i in found if i.is_file and not hidden(i.path))
        self.known = {p: self.known.get(p) or self._footer(fs, top, p) for p in paths}
        return [g for p in paths for g in self.known[p]]

    def read(self, group: Group, columns: Iterable[str]) -> pa.Table:
        """The columns of a row group; those of the path and missing ones too."""
        fs, _ = self.open()
        with fs.open_input_file(group.path) as f:
            file = pq.ParquetFile(f)
            there = set(file.schema_arrow.names)
            rows = file.read_row_group(group.index, [c for c in columns if c in there])
            count = file.metadata.row_group(group.index).num_rows
        given = dict(group.from_path)
        return pa.table({c: rows[c] if c in there else pa.array([given.get(c)] * count, pa.string()) for c in columns})

    def tip(self) -> Cursor:
        """The greatest cursor: only the groups that reach its second are read."""
        groups = self.groups()
        ends = {g: next((high for name, _, high in g.bounds if name == "created_at"), None) for g in groups}
        last = max((e for e in ends.values() if e is not None), default=None)
        best = ORIGIN
        for g, end in ends.items():
            if end is None or end == last:
                best = max(best, _last(self.read(g, ("created_at", "id")), best))
        return best


def _last(rows: pa.Table, best: Cursor) -> Cursor:
    rows = rows.filter(pc.and_(pc.is_valid(rows["created_at"]), pc.is_valid(rows["id"])))
    at = pc.max(rows["created_at"]).as_py()
    if at is None:
        return best
    return at, pc.max(rows.filter(pc.equal(rows["created_at"], at))["id"]).as_py()


def _beyond(rows: pa.Table, cursor: Cursor) -> pa.ChunkedArray:
    at, i = cursor
    return pc.or_(pc.greater(rows["created_at"], at), pc.and_(pc.equal(rows["created_at"], at), pc.greater(rows["id"], i)))


class _Pieces:
    """Reads pieces as Arrow batches of the declared schema."""

    def __init__(self, folder: Folder, schema: StructType):
        self.folder = folder
        self.fields = [(f.name, ARROW[f.dataType.simpleString()]) for f in schema.fields]

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        """Spark asks for no piece where there are none."""
        if piece is None:
            return
        for group in piece.groups:
            rows = self.folder.read(group, [n for n, _ in self.fields])
            rows = pa.table({n: rows[n].cast(kind) for n, kind in self.fields})
            if piece.after is not None:
                rows = rows.filter(_beyond(rows, piece.after))
                rows = rows.filter(pc.invert(_beyond(rows, piece.upto)))
            yield from rows.to_batches(max_chunksize=10_000)


class BatchReader(_Pieces, DataSourceReader):
    def __init__(self, folder: Folder, schema: StructType):
        super().__init__(folder, schema)
        self.wanted: list[tuple[str, object, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Bounds prune row groups; Spark applies every filter to the rows itself."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in Folder.BOUNDED:
                pass
            elif isinstance(f, In):
                values = [v for v in f.value if v is not None]
                if values:
                    self.wanted.append((column, min(values), max(values)))
            elif isinstance(f, EqualTo):
                self.wanted.append((column, f.value, f.value))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.wanted.append((column, f.value, None))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.wanted.append((column, None, f.value))
            yield f

    def partitions(self) -> list[Piece]:
        return pieces([g for g in self.folder.groups() if all(g.may_hold(*w) for w in self.wanted)])


class StreamReader(_Pieces, DataSourceStreamReader):
    def __init__(self, folder: Folder, schema: StructType, start: str):
        super().__init__(folder, schema)
        self.start = start

    def initialOffset(self) -> dict:  # noqa: N802
        return _offset(self.folder.tip() if self.start == "tip" else ORIGIN)

    def latestOffset(self) -> dict:  # noqa: N802
        return _offset(self.folder.tip())

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        after, upto = (start["created_at"], start["id"]), (end["created_at"], end["id"])
        return pieces([g for g in self.folder.groups() if after < upto and g.may_hold("created_at", after[0], upto[0])], after, upto)

    def commit(self, end: dict) -> None:
        pass


def _offset(cursor: Cursor) -> dict:
    return {"created_at": cursor[0], "id": cursor[1]}


class ObservationLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        forms = {"typed": S.TYPED_DDL, "raw": S.RAW_DDL}
        form = self.options.get("form", "typed")
        if form not in forms:
            raise ValueError(f"form: {form!r} is neither of {sorted(forms)}")
        return forms[form]

    def _folder(self) -> Folder:
        if not self.options.get("path"):
            raise ValueError("the option path is missing")
        return Folder(self.options["path"])

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(self._folder(), schema)

    def streamReader(self, schema: StructType) -> StreamReader:  # noqa: N802
        start = self.options.get("start", "earliest")
        if start not in ("earliest", "tip"):
            raise ValueError(f"start: {start!r} is neither earliest nor tip")
        return StreamReader(self._folder(), schema, start)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ObservationLog)
