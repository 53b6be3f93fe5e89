"""Source plug point. A posting source is a name, a way to get landed payloads as rows, and
a ``parse`` function from such rows to postings.

``SYSTEMS`` maps the board systems to their parse functions; ``add_system`` adds another. Payloads
come from Spark's own text reader (``read_board``), or from the ``job_board`` data source, which
any client of ``spark.read`` can load, filter and stream into its own parse function:

    spark.dataSource.register(LandedBoards)
    spark.read.format("job_board").option("path", root).option("system", "lever").load()

The data source lists the folder once on the driver (names and sizes only) and plans partitions of
about ``PART_BYTES``, each file counting for ``OPEN_BYTES`` more, so that tasks follow the bytes
landed and not the number of boards (up to ``FEW`` files have a partition each). It reads through pyarrow's file systems (local paths and the
URIs that they know).

Landed payloads come in two layouts: one file per payload, its folders naming the rest, or packed
(``land_packed``; option ``packed``): JSON lines under ``system=<name>/``, one object per payload with
``value`` and the folder columns. Packed files are read in ranges of ``RANGE_BYTES``, cut at line ends."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import ats

SYSTEMS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "greenhouse": ats.parse_greenhouse, "lever": ats.parse_lever, "ashby": ats.parse_ashby,
    "smartrecruiters": ats.parse_smartrecruiters, "workday": ats.parse_workday,
}
#: Folder columns: system=<name>/company=<name>/board=<token>/... (``api_base``, ``site`` and
#: ``offset`` for the systems that need them).
FOLDERS = ("system", "company", "board", "api_base", "site", "offset")


def add_system(name: str, parse: Callable[[DataFrame], DataFrame]) -> None:
    """Plug in a source: ``parse`` gets (value, path, folder columns) and returns postings."""
    SYSTEMS[name] = parse


PART_BYTES, OPEN_BYTES, RANGE_BYTES, FEW = 32 << 20, 1 << 20, 8 << 20, 200


class _Files(InputPartition):
    def __init__(self, pieces: list[tuple[str, int, int]]):
        self.pieces = pieces        # (path, first byte, last byte exclusive)


def _dealt(pieces: list[tuple[str, int, int]]) -> list[_Files]:
    """Neighbouring pieces together, up to ``PART_BYTES``, but in ``FEW`` parts if there are so many."""
    cost = [end - start + OPEN_BYTES for _, start, end in pieces]
    most, out, size = min(PART_BYTES, sum(cost) // FEW), [], 0
    for piece, n in zip(pieces, cost):
        if not out or size + n > most:
            out.append(_Files([]))
            size = 0
        out[-1].pieces.append(piece)
        size += n
    return out


def _lines(file, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin in a range of bytes."""
    f = io.BufferedReader(file, 1 << 20)
    if start:
        f.seek(start - 1)
        f.readline()                # the line before, or its end
    while f.tell() < end and (line := f.readline()):
        if line.strip():
            yield line


def _file_system(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _folders(path: str) -> dict[str, str]:
    """Column values of a file's folders, as Spark's partition discovery reads them."""
    parts = dict(p.split("=", 1) for p in path.split("/")[:-1] if "=" in p)
    return {k: unquote(v) for k, v in parts.items() if k in FOLDERS}


class _Reader(DataSourceReader):
    def __init__(self, root: str, system: str | None, packed: bool):
        self.root, self.system, self.packed = root, system, packed

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs
        system, root = _file_system(self.root)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda p: p.rsplit("/", 1)[-1][:1] in "._"
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f.path))
        mine = [(p, n) for p, n in files if self.system is None or _folders(p).get("system") in (None, self.system)]
        if not self.packed:
            return _dealt([(p, 0, n) for p, n in mine])
        return _dealt([(p, at, min(n, at + RANGE_BYTES)) for p, n in mine for at in range(0, n, RANGE_BYTES)])

    def read(self, partition) -> Iterator[tuple]:
        if partition is None:       # an empty folder: Spark asks for one part without a file
            return
        system, _ = _file_system(self.root)
        for path, start, end in partition.pieces:
            have = _folders(path)
            if self.packed:
                with system.open_input_file(path) as f:
                    for line in _lines(f, start, end):
                        row = have | json.loads(line)
                        yield (row.get("value"), path, *(row.get(c) for c in FOLDERS))
            else:
                with system.open_input_stream(path) as f:
                    value = f.read().decode("utf-8", "replace")
                yield (value, path, *(have.get(c) for c in FOLDERS))


class LandedBoards(DataSource):
    """``job_board``: one row per landed payload under ``path`` (of one ``system``, if given); with
    ``packed`` the files are those of ``land_packed``."""

    @classmethod
    def name(cls) -> str:
        return "job_board"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in ("value", "path", *FOLDERS))

    def reader(self, schema) -> DataSourceReader:
        if not self.options.get("path"):
            raise ValueError("job_board needs a path")
        return _Reader(self.options["path"], self.options.get("system"), self.options.get("packed", "false").lower() == "true")


def land_packed(payloads: DataFrame, path: str) -> None:
    """Land payloads (system, value and folder columns) as JSON lines: files follow the bytes, however
    many boards there are."""
    payloads.write.partitionBy("system").json(path)


def read_board(spark: SparkSession, system: str, path: str, by: str = "files", packed: bool = False, **given: str) -> DataFrame:
    """Postings of one system's landed payloads: ``by`` Spark's own readers (``files``) or the
    ``job_board`` data source (``source``), one file per payload or ``packed``. ``given`` sets folder
    columns that the path lacks."""
    if system not in SYSTEMS:
        raise ValueError(f"unknown system {system!r}; known: {', '.join(sorted(SYSTEMS))}")
    from pyspark.sql import functions as F
    if by == "source":
        spark.dataSource.register(LandedBoards)
        rows = spark.read.format("job_board").option("path", path).option("system", system).option("packed", str(packed).lower()).load()
    elif packed:
        # a payload may be longer than the JSON reader's usual limit for a string
        rows = spark.read.schema(", ".join(f"{c} string" for c in ("value", *FOLDERS[1:]))).option("maxStringLen", (1 << 31) - 1).json(path)
    else:
        rows = spark.read.text(path, wholetext=True)
        for c in FOLDERS:
            rows = rows.withColumn(c, F.col(c).cast("string")) if c in rows.columns else rows
    for c, v in given.items():
        rows = rows.withColumn(c, F.lit(v))
    return SYSTEMS[system](rows)
