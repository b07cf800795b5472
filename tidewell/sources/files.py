"""Byte-level access to journals: a stream that follows growing files by byte offset, and a sink that publishes all files at once or none."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: A follower begins with the last so many bytes and, of these, lines.
TAIL_BYTES, TAIL_LINES = 512 * 1024, 8
#: The bytes that one task of the follower reads.
PART_BYTES = 32 * 1024 * 1024


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or of a plain path, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


def _sizes(path: str) -> dict[str, int]:
    fs, inner = file_system(path)
    info = fs.get_file_info(inner)
    found = fs.get_file_info(pafs.FileSelector(inner, recursive=False)) if info.type == pafs.FileType.Directory else [info]
    return {f.path: f.size for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))}


def _complete(f, size: int) -> int:
    """The bytes up to the last line end: what comes after it is a line that is being written."""
    end = size
    while end > 0:
        begin = max(0, end - 65536)
        f.seek(begin)
        at = f.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return 0


def _attached(f, end: int) -> int:
    """Where a follower begins in a file's first ``end`` bytes: at the eighth last line that isn't empty, within the last 512 KiB, where the first line is only the rest of one."""
    begin = max(0, end - TAIL_BYTES)
    f.seek(begin)
    data = f.read(end - begin)
    lines, at = [], 0
    for line in data.split(b"\n")[:-1]:
        if line:
            lines.append(begin + at)
        at += len(line) + 1
    if begin > 0:
        lines = lines[1:]
    return lines[-TAIL_LINES:][0] if lines else end


@dataclass
class _Part(InputPartition):
    path: str
    begin: int
    end: int
    limit: int


class _TailReader(DataSourceStreamReader):
    """Offsets are {file: bytes up to a line end}. A file that got shorter than its offset begins anew."""

    def __init__(self, path: str, whole: bool):
        self.path, self.whole = path, whole

    def _ends(self) -> dict[str, int]:
        fs, _ = file_system(self.path)
        out = {}
        for name, size in _sizes(self.path).items():
            with fs.open_input_file(name) as f:
                out[name] = _complete(f, size)
        return out

    def _begin(self, name: str, end: int) -> int:
        if self.whole:
            return 0
        fs, _ = file_system(self.path)
        with fs.open_input_file(name) as f:
            return _attached(f, end)

    def initialOffset(self) -> dict:
        return {name: self._begin(name, end) for name, end in self._ends().items()}

    def latestOffset(self) -> dict:
        return self._ends()

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        out = []
        for name, to in end.items():
            at = start.get(name)
            if at is None or to < at:  # a new file, or one that began anew
                at = self._begin(name, to)
            out += [_Part(name, p, min(p + PART_BYTES, to), to) for p in range(at, to, PART_BYTES)]
        return out or [_Part("", 0, 0, 0)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if not partition.path:
            return
        fs, _ = file_system(self.path)
        with fs.open_input_file(partition.path) as f:
            at = partition.begin
            # a line belongs to the part that its first byte is in; the byte before tells whether a part begins with one
            rest, begin, ahead, skip = b"", at, at, False
            if at > 0:
                f.seek(at - 1)
                skip = f.read(1) != b"\n"
            while begin < partition.end or rest:
                data = f.read(min(1 << 20, partition.limit - ahead))
                if not data:
                    return
                ahead += len(data)
                pieces = (rest + data).split(b"\n")
                rest = pieces.pop()
                for line in pieces:
                    if skip:
                        skip = False
                    elif begin >= partition.end:
                        return
                    elif line:
                        yield partition.path, begin, line.decode("utf-8", "replace")
                    begin += len(line) + 1
                if begin >= partition.end:
                    return

    def commit(self, end: dict) -> None:
        pass


class JournalTail(DataSource):
    """Format journal_tail: (path, at, line) of a file or a folder's files as they grow; at is the line's first byte."""

    @classmethod
    def name(cls) -> str:
        return "journal_tail"

    def schema(self) -> str:
        return "path string, at long, line string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _TailReader(self.options["path"], self.options.get("whole", "false").lower() == "true")


def follow_tail(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """A growing journal, or a folder of them, as a stream of (path, at, session_id, record_type, raw).

    A file begins with its last eight lines, or wholly if ``whole``; lines come once they are complete, empty ones are passed over. A file that was cut short begins anew.
    Offsets are kept by the query's checkpoint, so that a restart repeats and loses nothing. Paths are read by executors, as local or shared files or by URI.
    """
    spark.dataSource.register(JournalTail)
    rows = spark.readStream.format("journal_tail").option("whole", str(whole).lower()).load(path)
    return rows.select("path", "at", F.get_json_object("line", "$.sessionID").alias("session_id"), F.get_json_object("line", "$.recordType").alias("record_type"), F.col("line").alias("raw"))


@dataclass
class _Staged(WriterCommitMessage):
    name: str
    rows: int


class _JournalWriter(DataSourceWriter):
    """Tasks write into a folder of the job's own beside the path; the commit makes it the path."""

    def __init__(self, path: str):
        self.path = path
        self.stage = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
        fs, inner = file_system(path)
        if fs.get_file_info(inner).type != pafs.FileType.NotFound:
            raise FileExistsError(f"{path} exists")
        fs.create_dir(file_system(self.stage)[1], recursive=True)

    def write(self, iterator: Iterator) -> _Staged:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, inner = file_system(self.stage)
        # attempts of a task write files of their own; only the ones that the commit names are kept
        name, n = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.jsonl", 0
        with fs.open_output_stream(f"{inner}/{name}") as out:
            for (value,) in iterator:
                if value is None:
                    raise ValueError("a journal's line is null")
                out.write(value.encode() + b"\n")
                n += 1
        if isinstance(fs, pafs.LocalFileSystem):
            os.chmod(f"{inner}/{name}", 0o600)
        return _Staged(name, n)

    def commit(self, messages: list[_Staged | None]) -> None:
        fs, inner = file_system(self.stage)
        kept = {m.name for m in messages if m is not None and m.rows}
        for f in fs.get_file_info(pafs.FileSelector(inner)):
            if f.base_name not in kept:
                fs.delete_file(f.path)
        target = file_system(self.path)[1]
        if fs.get_file_info(target).type != pafs.FileType.NotFound:
            fs.delete_dir(inner)
            raise FileExistsError(f"{self.path} exists")
        fs.move(inner, target)

    def abort(self, messages: list[_Staged | None]) -> None:
        fs, inner = file_system(self.stage)
        if fs.get_file_info(inner).type != pafs.FileType.NotFound:
            fs.delete_dir(inner)


class JournalSink(DataSource):
    """Format journal_sink: one column of lines, published as a folder of files at once."""

    @classmethod
    def name(cls) -> str:
        return "journal_sink"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a journal is never overwritten")
        return _JournalWriter(self.options["path"])


def publish_journal(rows: DataFrame, path: str, session_id: str | None = None, order: list[str] | None = None) -> None:
    """Writes rows as JSON lines, keys sorted, nulls left out, with ``session_id`` as sessionID of each; files can be read by their owner alone.

    All or nothing: a failed task or job leaves no path, and a path that exists is refused. With ``order``, files are ordered ranges.
    """
    rows.sparkSession.dataSource.register(JournalSink)
    made = rows.withColumn("sessionID", F.lit(session_id)) if session_id is not None else rows
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(made.columns)]))
    ordered = made.orderBy(*order) if order else made
    ordered.select(body.alias("value")).write.format("journal_sink").mode("append").save(path)


def remaining(expected: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of expected (keys, place from 0) that a result journal (keys, place) doesn't hold yet.

    What it holds must be the first rows of expected in their order, each once; the rows are an error where it isn't.
    """
    own = held.select(*[F.col(k).alias(f"{k}_of") for k in keys], F.col("place").alias("place_of"))
    met = expected.join(own, F.col("place") == F.col("place_of"), "full_outer")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_of"))
    counted = held.agg(F.count("*").alias("n_held_"))  # one row
    met = met.join(F.broadcast(counted))
    wrong = F.col("place_of").isNotNull() & (F.col("place").isNull() | ~same | (F.col("place_of") >= F.col("n_held_")))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("the journal is not a prefix at place "), F.col("place_of").cast("string")))).otherwise(F.col("place_of").isNull())
    return met.where(checked).select(*expected.columns)
