"""Text files whose names and failures matter: a sink of named files, and a scan that keeps errors as rows.

Both are Python data sources.  Paths are URIs or paths that ``pyarrow.fs`` can
open on every executor.
"""

from __future__ import annotations

import gzip
import io
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

PENDING = "_pending"
#: A scan is dealt to some ``TASKS`` tasks or more, of at most ``PACK`` bytes each; opening a file counts as ``OPENING`` bytes.
TASKS, PACK, OPENING = 256, 32 << 20, 64 << 10
LINES = "area string, file_path string, split int, line long, value string, error string"
_ARROW = pa.schema([("area", pa.string()), ("file_path", pa.string()), ("split", pa.int32()), ("line", pa.int64()), ("value", pa.string()), ("error", pa.string())])


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a URI or a path."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# --- named files -----------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a file is now, and its name


class NamedText(DataSource):
    """Sink ``named_text``: rows (name, value) become lines of the file ``name`` below ``path``.

    A file appears under its name when the whole job has succeeded; a job that
    fails leaves none.  A file of that name is replaced, others stay.
    """

    @classmethod
    def name(cls) -> str:
        return "named_text"

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema, overwrite: bool) -> NamedTextWriter:
        return NamedTextWriter(self.options["path"], uuid.uuid4().hex)


class NamedTextWriter(DataSourceArrowWriter):
    def __init__(self, path: str, job: str):
        self.path, self.job = path, job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Write the rows of a task, one file at a time; rows of a name come together and in order."""
        fs, root = opened(self.path)
        folder = f"{root}/{PENDING}-{self.job}"
        fs.create_dir(folder)
        files: list[tuple[str, str]] = []
        out, now = None, None
        try:
            for batch in iterator:
                names, values = batch.column("name").to_pylist(), batch.column("value").to_pylist()
                at = 0
                while at < len(names):
                    to = at
                    while to < len(names) and names[to] == names[at]:
                        to += 1
                    if names[at] != now:
                        if out is not None:
                            out.close()
                        now = names[at]
                        if any(now == n for _, n in files):
                            raise ValueError(f"rows of {now} do not come together")
                        files.append((f"{folder}/{uuid.uuid4().hex}", now))
                        out = fs.open_output_stream(files[-1][0])
                    out.write("".join(f"{'' if v is None else v}\n" for v in values[at:to]).encode())
                    at = to
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Give every file its name; two tasks with rows of one name are an error."""
        fs, root = opened(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        if len({n for _, n in files}) != len(files):
            self.abort(messages)
            raise ValueError("rows of one name lie in several partitions")
        for at, name in files:
            fs.create_dir(posixpath.dirname(f"{root}/{name}"))
            fs.move(at, f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, root = opened(self.path)
        folder = f"{root}/{PENDING}-{self.job}"
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


def write_named(lines: DataFrame, path: str, name: str, order: list[str], value: str = "value") -> None:
    """Write ``value`` as lines of one file per ``name``, in the order of ``order``.

    Names are dealt to tasks, and a task streams its rows to one file after the
    other: it holds a batch, never a file.  One ordered file has one writer.
    """
    lines.sparkSession.dataSource.register(NamedText)
    ready = lines.repartition(name).sortWithinPartitions(name, *order).select(F.col(name).alias("name"), F.col(value).alias("value"))
    ready.write.format("named_text").option("path", path).mode("append").save()


# --- lines with errors -----------------------------------------------------------------------------------------------


@dataclass
class Run:
    """Pieces of a file that follow each other, from number ``no`` on: a range of bytes, without an end of a file that is read whole."""

    path: str
    no: int
    begin: int
    end: int | None


@dataclass
class Pack(InputPartition):
    """What one task reads."""

    area: str
    runs: list[Run]


class CheckedText(DataSource):
    """Scan ``checked_text`` of ``<path>/<area>/**/*.txt`` and ``*.txt.gz``: lines, or an error where a file cannot be read.

    A line that is not UTF-8, and a file that breaks off or cannot be opened,
    give a row with ``error`` and no ``value``; the lines before it stay and
    the job goes on.  Lines are numbered in pieces of ``split_bytes``, compressed
    files are one piece.  A task reads many small pieces, those of a file that follow
    each other in one go.  Option ``areas``, a JSON list, chooses the areas that are listed.
    """

    @classmethod
    def name(cls) -> str:
        return "checked_text"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> CheckedReader:
        return CheckedReader(self.options["path"], int(self.options.get("split_bytes", 32 << 20)), json.loads(self.options.get("areas", "null")))


class CheckedReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, areas: list[str] | None):
        self.path, self.split_bytes, self.areas = path, split_bytes, areas

    def partitions(self) -> list[Pack]:
        fs, root = opened(self.path)
        areas = sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.Directory and (self.areas is None or i.base_name in self.areas))
        found = {area: sorted((i for i in fs.get_file_info(pafs.FileSelector(f"{root}/{area}", recursive=True)) if i.type == pafs.FileType.File and i.path.endswith((".txt", ".txt.gz"))), key=lambda i: i.path) for area in areas}
        total = sum((i.size or 0) + OPENING for infos in found.values() for i in infos)
        most = max(self.split_bytes, min(PACK, total // TASKS)) + OPENING
        packs = []
        for area, infos in found.items():
            runs, held = [], 0
            for info in infos:
                size, k = info.size or 0, 0
                n = 1 if info.path.endswith(".gz") else max(1, -(-size // self.split_bytes))
                while k < n:
                    if runs and held + OPENING + min(size, self.split_bytes) > most:
                        packs.append(Pack(area, runs))
                        runs, held = [], 0
                    some = max(1, min(n - k, (most - held - OPENING) // self.split_bytes))
                    begin, end = k * self.split_bytes, min((k + some) * self.split_bytes, size)
                    whole = info.path.endswith(".gz")
                    runs.append(Run(info.path, k, begin, None if whole else end))
                    held += OPENING + (size if whole else end - begin)
                    k += some
            if runs:
                packs.append(Pack(area, runs))
        return packs

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, int, str | None, str | None]] = []

        def batch() -> pa.RecordBatch:
            columns = [[partition.area] * len(rows), *([r[k] for r in rows] for k in range(5))]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

        for run in partition.runs:
            for row in self._lines(run):
                rows.append((run.path, *row))
                if len(rows) >= 10_000:
                    yield batch()
                    rows = []
        if rows:
            yield batch()

    def _lines(self, run: Run) -> Iterator[tuple[int, int, str | None, str | None]]:
        """(piece, line within the piece, text, error): the lines that begin within the pieces of a run."""
        pieces = [0] if run.end is None else range(run.begin, max(run.end, run.begin + 1), self.split_bytes)
        raw, stream, at = None, None, 0
        try:
            for piece, begin in enumerate(pieces, run.no):
                end, no = None if run.end is None else min(begin + self.split_bytes, run.end), 0
                try:
                    if stream is None:  # at the first piece, and again after one that broke off
                        if raw is not None:
                            raw.close()
                        fs, _ = opened(self.path)
                        raw = fs.open_input_file(run.path)
                        at = max(begin - 1, 0)
                        raw.seek(at)
                        stream = gzip.GzipFile(fileobj=raw) if end is None else io.BufferedReader(raw, 1 << 20)
                        if begin:  # a line that began before belongs to the piece before
                            at += len(stream.readline())
                    while end is None or at < end:
                        line = stream.readline()
                        if not line:
                            break
                        at += len(line)
                        try:
                            yield piece, no, line.rstrip(b"\r\n").decode("utf-8"), None
                        except UnicodeDecodeError as e:
                            yield piece, no, None, f"not UTF-8: {e.reason} at byte {e.start} of the line"
                        no += 1
                except (OSError, EOFError, pa.ArrowException) as e:  # gzip and zlib errors among them
                    stream = None
                    yield piece, no, None, f"{type(e).__name__}: {e}"
        finally:
            if raw is not None and not raw.closed:
                raw.close()


def read_checked(spark: SparkSession, path: str, areas: list[str] | None = None, split_bytes: int = 32 << 20) -> DataFrame:
    """``(area, file_path, line_no, value, error)`` of the text files below the areas.

    Lines are numbered through a file, broken ones included.  Windows run over
    the pieces of a file, never over its lines.
    """
    spark.dataSource.register(CheckedText)
    rows = spark.read.format("checked_text").option("path", path).option("split_bytes", split_bytes).option("areas", json.dumps(areas)).load()
    before = Window.partitionBy("file_path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy("file_path", "split").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return rows.join(pieces, ["file_path", "split"]).select("area", "file_path", (F.col("_base") + F.col("line")).alias("line_no"), "value", "error")


def unreadable(lines: DataFrame) -> DataFrame:
    """``(file_path, n_errors, first_line, error)``: the quarantine of :func:`read_checked`."""
    bad = lines.where("error IS NOT NULL").groupBy("file_path").agg(F.count("*").alias("n_errors"), F.min(F.struct("line_no", "error")).alias("_f"))
    return bad.select("file_path", "n_errors", F.col("_f.line_no").alias("first_line"), F.col("_f.error").alias("error"))


def readable(lines: DataFrame) -> DataFrame:
    """``(file_path, line_no, value)`` of the files without an error."""
    return lines.join(unreadable(lines).select("file_path"), "file_path", "left_anti").select("file_path", "line_no", "value")
