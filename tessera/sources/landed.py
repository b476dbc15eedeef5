"""Landed pages as a Spark data source: ``spark.read`` and ``spark.readStream`` of format "landed_pages".

A folder has one folder for each source (``cfr``, or ``source_system=cfr`` as Spark
writes them), and in it the pages that were fetched:
files of JSON lines, a raw record each, that are named so that later ones sort
behind earlier ones and aren't changed once they are there. A source with a file
``_down`` isn't well: only its pages up to the one that this file names are taken
(none if it names none), those behind it once the file is gone. A batch read has
one row that says so.

Every row has source_system, page, position and error, and the canonical record
(``records.RECORD``). What goes wrong stays where it is: a record that can't be
normalised is one row with its error, a page that can't be read is one row, and
all others are read. Records that their source's normaliser skips give no row.

A partition is a run of pages of one source, cut at about ``pageBytes`` (4 MB),
so a source that holds most pages is read by many tasks. The offset of a stream
is the last page taken of each source.

Options: ``path``; ``sources``, comma-separated, all where it is missing;
``pageBytes``. The path is opened by pyarrow's file systems (local and shared
folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tessera.sources.records import NORMALISERS, RECORD

SCHEMA = f"source_system string, page string, position int, error string, {RECORD}"
ROWS = 2000


def schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "date": pa.date32(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])


@dataclass
class Pages(InputPartition):
    source: str
    folder: str
    pages: list[str]  # their names
    down: bool = False


class Folder:
    """The pages in a folder, by source."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.sources = [s.strip() for s in options.get("sources", "").split(",") if s.strip()]
        self.page_bytes = int(options.get("pagebytes", options.get("pageBytes", 4 << 20)))

    def opened(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def listed(self) -> dict[str, tuple[str, bool, list[tuple[str, int]]]]:
        """source: (its folder, is it well, its whole pages with their sizes in order)."""
        from pyarrow import fs

        files, root = self.opened()
        found = {}
        for d in files.get_file_info(fs.FileSelector(root)):
            source = d.base_name.rpartition("=")[2]
            if d.type == fs.FileType.Directory and (not self.sources or source in self.sources):
                inside = [f for f in files.get_file_info(fs.FileSelector(d.path)) if f.type == fs.FileType.File]
                pages = sorted((f.base_name, f.size) for f in inside if not f.base_name.startswith(("_", ".")))
                well = all(f.base_name != "_down" for f in inside)
                if not well:
                    with files.open_input_stream(f"{d.path}/_down") as f:
                        last = f.read().decode("utf-8", "replace").strip()
                    pages = [p for p in pages if p[0] <= last]
                found[source] = d.base_name, well, pages
        return dict(sorted(found.items()))

    def cut(self, source: str, folder: str, pages: list[tuple[str, int]]) -> Iterator[Pages]:
        run, held = [], 0
        for name, size in pages:
            if run and held + size > self.page_bytes:
                yield Pages(source, folder, run)
                run, held = [], 0
            run.append(name)
            held += size
        if run:
            yield Pages(source, folder, run)

    def rows(self, part: Pages) -> Iterator[dict]:
        blank = {c.split()[0]: None for c in SCHEMA.split(", ")} | {"source_system": part.source}
        if part.down:
            yield blank | {"error": "the source is down"}
            return
        normalise = NORMALISERS.get(part.source)
        files, root = self.opened()
        for page in part.pages:
            at = blank | {"page": page}
            if normalise is None:
                yield at | {"error": f"no normaliser for {part.source}"}
                continue
            try:
                with files.open_input_stream(f"{root.rstrip('/')}/{part.folder}/{page}") as f:
                    lines = f.read().decode("utf-8").splitlines()
            except (OSError, UnicodeDecodeError) as e:
                yield at | {"error": f"unreadable page: {type(e).__name__}"}
                continue
            for i, line in enumerate(lines):
                if line.strip():
                    try:
                        record = normalise(json.loads(line))
                    except Exception as e:  # whatever is wrong with one record
                        yield at | {"position": i, "error": f"{type(e).__name__}: {e}"}
                        continue
                    if record is not None:
                        yield at | {"position": i} | record

    def batches(self, part: Pages) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for r in self.rows(part):
            held.append(r)
            if len(held) == ROWS:
                yield pa.RecordBatch.from_pylist(held, schema=schema())
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema())


class BatchReader(DataSourceReader):
    def __init__(self, folder: Folder):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for source, (folder, well, pages) in self.folder.listed().items():
            out += [*self.folder.cut(source, folder, pages), *([] if well else [Pages(source, folder, [], True)])]
        return out or [Pages("", "", [])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.folder.batches(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, folder: Folder):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The last whole page of every source."""
        return {s: pages[-1][0] for s, (_, _, pages) in self.folder.listed().items() if pages}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for source, (folder, _, pages) in self.folder.listed().items():
            if source in end:
                out += self.folder.cut(source, folder, [p for p in pages if start.get(source, "") < p[0] <= end[source]])
        return out or [Pages("", "", [])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.folder.batches(partition)


class LandedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchReader(Folder(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(Folder(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedPages)


def mark_down(spark: SparkSession, folder: str, last: str = "") -> None:
    """Say that the source of this folder isn't well, and which of its pages is its last whole one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_down")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(last.encode()))
    out.close()


def mark_well(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_down")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)
