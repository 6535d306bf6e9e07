"""CSV folders as a streaming source: new files, the names in each one's header, byte ranges.

The source keeps a log of its own in the shared folder: entry n lists the files that the n-th look at the
folder found new. An offset is the number of an entry, so the same offsets always mean the same files,
and a batch that is run again reads what it read before. The driver lists names and sizes only. Tasks read
byte ranges; a line belongs to the range its first byte is in. Of a file's head they read no more than the
header. All headers go through one plan: rows come out by name, with what the schema lacks in a map.
"""

import csv
import io
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv as arrow_csv
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from roomledger.functions.parsing import soft_cast
from roomledger.schemas import SOURCE_SCHEMA
from roomledger.sources.landing import BAD_LINE, header_names
from roomledger.sources.tables import stored

RANGE = 64 << 20  # bytes of a file, or of several small ones, that a task reads
CHUNK = 4 << 20  # bytes parsed at once
HEAD = 1 << 14  # bytes read at a time until the header ends
SURPLUS, FILE = "_surplus", "_source_file"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


@dataclass
class Ranges(InputPartition):
    """What one task reads: (path, size, from byte, to byte)."""

    parts: tuple[tuple[str, int, int, int], ...]


class FileLog:
    """Numbered lists of files; an entry is renamed into place and never changed."""

    def __init__(self, folder: str):
        self.store, self.folder = open_store(folder)
        self.entries: list[list[tuple[str, int]]] = []

    def load(self) -> None:
        """Read the entries that are not known yet."""
        self.store.create_dir(self.folder, recursive=True)
        while True:
            try:
                with self.store.open_input_stream(f"{self.folder}/{len(self.entries) + 1}.json") as file:
                    self.entries.append([tuple(x) for x in json.loads(file.read())])
            except FileNotFoundError:
                return

    def add(self, files: list[tuple[str, int]]) -> None:
        name = f"{self.folder}/{len(self.entries) + 1}.json"
        with self.store.open_output_stream(f"{name}.part") as file:
            file.write(json.dumps(files).encode())
        self.store.move(f"{name}.part", name)
        self.entries.append(files)


def plan_ranges(files: list[tuple[str, int]], most: int = RANGE) -> list[Ranges]:
    """Long files cut into ranges, short ones put together."""
    plans, now, size = [], [], 0
    for path, length in files:
        for start in range(0, length, most):
            end = min(start + most, length)
            if now and size + end - start > most:
                plans.append(Ranges(tuple(now)))
                now, size = [], 0
            now.append((path, length, start, end))
            size += end - start
    return [*plans, Ranges(tuple(now))] if now else plans


def _line_end(file, at: int, size: int) -> int:
    """The place behind the next line break at or after a place."""
    file.seek(at)
    while at < size:
        block = file.read(min(HEAD, size - at))
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(block)
    return size


def whole_lines(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin in a range, behind the header, in blocks of bounded size; first the header."""
    body = _line_end(file, 0, size)
    file.seek(0)
    yield file.read(body)
    at = max(body, _line_end(file, start - 1, size) if start else 0)
    stop = size if end >= size else max(at, _line_end(file, end - 1, size))
    file.seek(at)
    rest = b""
    while at < stop:
        block = file.read(min(CHUNK, stop - at))
        at += len(block)
        cut = block.rfind(b"\n") + 1 if at < stop else len(block)
        if cut:
            yield rest + block[:cut]
            rest = block[cut:]
        else:
            rest += block


def _text(raw: bytes) -> bytes:
    """The bytes if they are UTF-8, else with replacement characters."""
    try:
        raw.decode("utf-8")
        return raw
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()


def parse(block: bytes, names: list[str], wanted: list[str], source: str) -> Iterator[pa.RecordBatch]:
    """Rows of whole lines, as text by name.

    Lines with too many or too few fields keep the fields that have a name, and come whole in a column.
    An empty field is null, a quoted empty one is empty text.
    """
    bad: list[str] = []

    def misfit(row) -> str:
        bad.append(row.text)
        return "skip"

    block = _text(block)
    if not block.strip():
        return
    table = arrow_csv.read_csv(
        io.BytesIO(block),
        read_options=arrow_csv.ReadOptions(column_names=names, use_threads=False, block_size=len(block) + 1),
        parse_options=arrow_csv.ParseOptions(escape_char="\\", invalid_row_handler=misfit),
        convert_options=arrow_csv.ConvertOptions(
            column_types=dict.fromkeys(names, pa.string()), null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=False),
    )
    yield from _shaped({n: table.column(n).combine_chunks() for n in names}, [None] * len(table), names, wanted, source)
    if bad:
        fields = [next(csv.reader([line], escapechar="\\"), []) for line in bad]
        columns = {n: pa.array([f[i] or None if i < len(f) else None for f in fields], pa.string()) for i, n in enumerate(names)}
        yield from _shaped(columns, bad, names, wanted, source)


def _shaped(columns: dict[str, pa.Array], bad: list, names: list[str], wanted: list[str], source: str) -> Iterator[pa.RecordBatch]:
    count = len(bad)
    if not count:
        return
    surplus = [n for n in names if n not in wanted]
    maps = [None] * count
    if surplus:
        rows = zip(*(columns[n].to_pylist() for n in surplus), strict=True)
        maps = [[(n, v) for n, v in zip(surplus, row, strict=True) if v is not None] or None for row in rows]
    yield pa.RecordBatch.from_arrays([
        *(columns.get(n, pa.nulls(count, pa.string())) for n in wanted), pa.array(maps, pa.map_(pa.string(), pa.string())),
        pa.array(bad, pa.string()), pa.array([source] * count, pa.string()),
    ], names=[*wanted, SURPLUS, BAD_LINE, FILE])


class CsvFolderReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.wanted = options["path"], json.loads(options["names"])
        self.range = int(options.get("rangeBytes", RANGE))
        self.log = FileLog(options["log"])

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        self.log.load()
        seen = {path for files in self.log.entries for path, _ in files}
        store, folder = open_store(self.path)
        found = store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        hidden = lambda path: any(p[0] in "._" for p in path.removeprefix(folder).split("/") if p)
        new = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f.path) and f.path not in seen)
        if new:
            self.log.add(new)
        return {"entry": len(self.log.entries)}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        self.log.load()
        return plan_ranges([f for files in self.log.entries[start["entry"] : end["entry"]] for f in files], self.range)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        for path, size, start, end in partition.parts:
            source = f"file://{path}" if isinstance(store, fs.LocalFileSystem) else path
            with store.open_input_file(path) as file:
                blocks = whole_lines(file, size, start, end)
                names = header_names(next(blocks).decode("utf-8", "replace").rstrip("\r\n"))
                for block in blocks:
                    yield from parse(block, names, self.wanted, source)


class CsvFolder(DataSource):
    """Options: path, log (a folder of the source's own), names (JSON list of columns), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "csv_folder"

    def schema(self) -> str:
        names = json.loads(self.options["names"])
        return ", ".join([*(f"`{n}` string" for n in names), f"{SURPLUS} map<string, string>", f"{BAD_LINE} string", f"{FILE} string"])

    def streamReader(self, schema: T.StructType) -> CsvFolderReader:
        return CsvFolderReader(dict(self.options))


def folder_stream(
    spark: SparkSession, path: str, log: str, schema: T.StructType = SOURCE_SCHEMA, range_bytes: int = RANGE
) -> DataFrame:
    """Rows of the folder's CSV files as a stream: the schema's columns, rescue, time and file.

    What ``with_rescue`` makes of a batch read, in one plan for all headers: a JSON object of the values
    that are not of their column's type, of columns that the schema lacks, of a line with a wrong number
    of fields, and of the file; NULL for a clean row.
    """
    spark.dataSource.register(CsvFolder)
    raw = (
        spark.readStream.format("csv_folder").option("path", path).option("log", log)
        .option("names", json.dumps(schema.names)).option("rangeBytes", str(range_bytes)).load()
    )
    typed = {f.name: soft_cast(f.name, f.dataType.simpleString(), "string") for f in schema.fields}
    misfits = [
        F.struct(F.lit(f.name).alias("name"), F.when(F.col(f.name).isNotNull() & typed[f.name].isNull(), F.col(f.name)).alias("value"))
        for f in schema.fields if not isinstance(f.dataType, T.StringType)
    ]
    wrong = F.map_from_entries(F.filter(
        F.array(*misfits, F.struct(F.lit(BAD_LINE).alias("name"), F.col(BAD_LINE).alias("value"))), lambda x: x["value"].isNotNull()))
    found = F.map_concat(wrong, F.coalesce(SURPLUS, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    rescue = F.to_json(F.map_concat(found, F.create_map(F.lit("_file_path"), F.col(FILE))))
    return raw.select(
        *[typed[n].alias(n) for n in schema.names], F.when(F.size(found) > 0, rescue).alias("_rescued_data"),
        F.current_timestamp().alias("_ingested_at"), FILE,
    )


def land_folder(
    spark: SparkSession, src_dir: str, out_dir: str, checkpoint: str, schema: T.StructType = SOURCE_SCHEMA, range_bytes: int = RANGE
):
    """New CSV files of a folder to bronze, each byte read once, each file landed once.

    A batch has a folder of its own, so one that is run again after a failure replaces what it wrote. The
    run after a failed one repeats that batch and no more; files that came since are for the next run.
    """
    def land(batch: DataFrame, number: int) -> None:
        stored(batch).mode("overwrite").parquet(f"{out_dir}/landed={number}")

    return (
        folder_stream(spark, src_dir, os.path.join(checkpoint, "files"), schema, range_bytes)
        .writeStream.queryName("bronze_folder")
        .option("checkpointLocation", f"{checkpoint}/stream")
        .trigger(availableNow=True)
        .foreachBatch(land)
        .start()
    )
