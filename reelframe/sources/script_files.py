"""A data source for script files: spark.read.format("scripts"), readStream and write, after register(spark).

Rows (script_id, source_format, source_filename, text, error) go to screenplay.parse_all as they are (see readable). A file that
cannot be used is a row with an error and no text, so one bad file fails no job: an unknown extension, bytes that are not UTF-8, a Final
Draft file without a document, a file that is gone or cannot be opened. Hidden files are left out; an empty file is an empty text.

Options: formats (a comma-separated list; other files are not opened and give no row), partitionBytes (files are put together up
to this size a task; a larger file is a task of its own). Paths are those of pyarrow's file systems (local, HDFS, object stores).

Streams number their listings: each listing that finds new files is written to the folder of the option log before its number is
handed out as an offset, so a batch that comes again reads the same files. A file counts as seen by its path; what is known of
seen files is held as paths, on the driver, as Spark's own file source does.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from posixpath import basename

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .screenplay import FORMATS

SCHEMA = "script_id string, source_format string, source_filename string, text string, error string"
TEXT_FORMATS = {"fountain", "txt", "md", "fdx"}
PARTITION_BYTES = 32 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path)


def form_of(path: str) -> str | None:
    """The format that a path's extension names, as screenplay.file_format does."""
    name = basename(path)
    return FORMATS.get(name.rsplit(".", 1)[1].lower()) if "." in name else None


def listed(path: str, formats: set[str] | None) -> list[tuple[str, int]]:
    """(path, size) of the files under a path, in order of their paths."""
    store, root = opened(path)
    if store.get_file_info(root).type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    own = [store.get_file_info(root)] if store.get_file_info(root).is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda p: any(part.startswith((".", "_")) for part in p[len(root) :].strip("/").split("/") if p != root)
    return sorted((f.path, f.size) for f in own if f.is_file and not hidden(f.path) and (formats is None or form_of(f.path) in formats))


class Files(InputPartition):
    """The files of one task."""

    def __init__(self, paths: list[str]):
        self.paths = paths


def dealt(files: list[tuple[str, int]], most: int) -> list[Files]:
    """Files in order, put together until the next one would exceed `most` bytes."""
    out, held, total = [], [], 0
    for path, size in files:
        if held and total + size > most:
            out.append(Files(held))
            held, total = [], 0
        held.append(path)
        total += size
    return out + [Files(held)] if held else out


def row_of(store: fs.FileSystem, path: str) -> tuple[str, str | None, str, str | None, str | None]:
    """A file's row."""
    form, text, error = form_of(path), None, None
    if form not in TEXT_FORMATS:
        error = "not a text format"
    else:
        try:
            with store.open_input_stream(path) as f:
                text = f.read().decode("utf-8")
        except (OSError, UnicodeDecodeError) as e:
            error = f"{type(e).__name__}: {e}"
        if form == "fdx" and text is not None and not ("<FinalDraft" in text and "<Content" in text and "</FinalDraft>" in text):
            text, error = None, "not a Final Draft document"
    return path, form, basename(path), text, error


class ScriptReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("scripts: a path is needed")
        self.path = options["path"]
        self.formats = {f.strip().lower() for f in options["formats"].split(",")} if "formats" in options else None
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))

    def partitions(self) -> list[InputPartition]:
        return dealt(listed(self.path, self.formats), self.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store = opened(self.path)[0]
        return (row_of(store, path) for path in partition.paths)


class ScriptStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        if "log" not in options:
            raise ValueError("scripts: a stream needs the option log, a folder that stays")
        self.files, self.log, self.seen, self.last = ScriptReader(options), options["log"], set(), 0

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def listing(self, n: int) -> list[tuple[str, int]]:
        store, root = opened(self.log)
        with store.open_input_stream(f"{root}/{n}.json") as f:
            return [tuple(x) for x in json.loads(f.read())]

    def latestOffset(self) -> dict:
        store, root = opened(self.log)
        store.create_dir(root, recursive=True)
        known = sorted(int(basename(f.path)[:-5]) for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".json"))
        for n in known:
            if n > self.last:
                self.seen.update(path for path, _ in self.listing(n))
                self.last = n
        new = [f for f in listed(self.files.path, self.files.formats) if f[0] not in self.seen]
        if new:
            aside = f"{root}/.{uuid.uuid4().hex}"
            with store.open_output_stream(aside) as out:
                out.write(json.dumps(new).encode())
            store.move(aside, f"{root}/{self.last + 1}.json")
            self.seen.update(path for path, _ in new)
            self.last += 1
        return {"listing": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        new = [f for n in range(start["listing"] + 1, end["listing"] + 1) for f in self.listing(n)]
        return dealt(new, self.files.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.files.read(partition)


class ScriptWriter(DataSourceWriter):
    """A file a row, named by source_filename; each appears whole, and a task that runs again replaces what it wrote."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        name, text = self.columns.index("source_filename"), self.columns.index("text")
        for row in rows:
            if not row[name] or row[name] != basename(row[name]):
                raise ValueError(f"not a file name: {row[name]}")
            aside = f"{root}/.{uuid.uuid4().hex}"
            with store.open_output_stream(aside) as out:
                out.write((row[text] or "").encode("utf-8"))
            store.move(aside, f"{root}/{row[name]}")
        return WriterCommitMessage()


class ScriptFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scripts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ScriptReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ScriptStream(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("scripts: files are added or replaced by name; use mode append")
        return ScriptWriter(self.options["path"], schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ScriptFiles)


def read_once(spark: SparkSession, path: str, home: str, **options: str) -> DataFrame:
    """The rows of the files under a path, kept as Parquet under `home`: tables parsed from them open no file again."""
    register(spark)
    rows = spark.read.format("scripts").options(**options).load(path)
    rows.write.mode("overwrite").parquet(home)
    return spark.read.schema(rows.schema).parquet(home)


def readable(rows: DataFrame) -> DataFrame:
    """The rows that can be parsed."""
    return rows.where(F.col("error").isNull()).drop("error")


def problems(rows: DataFrame) -> DataFrame:
    """(script_id, source_filename, error) of the files that cannot."""
    return rows.where(F.col("error").isNotNull()).select("script_id", "source_filename", "error")
