"""Reading source CSV files: schema inference, rescue of bad data, file lineage."""

import csv
from urllib.parse import unquote

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomledger.functions.parsing import soft_cast
from roomledger.schemas import SOURCE_SCHEMA

BAD_LINE = "_corrupt_record"
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
FILES_PER_BATCH = 10_000  # bounds a batch, drops nothing
FILE_ROWS = 1_000_000  # a compressed file is read by one task


def infer_schema(spark: SparkSession, path: str, sampling_ratio: float = 1.0) -> T.StructType:
    """Column types from a first look at the files, to be frozen and passed to the stream."""
    return (
        spark.read.option("header", True)
        .option("inferSchema", True)
        .option("samplingRatio", sampling_ratio)
        .csv(path)
        .schema
    )


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
    )


def headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """header, files: the files of each distinct first line.

    The first line of a file is the one with the lowest number in its first block; the numbers are
    found with one long per file, then sent to where the lines are, so no other line leaves its task.
    """
    lines = _lines(spark, paths).where("block = 0")
    first = lines.groupBy("file").agg(F.min("line").alias("line"))
    return lines.join(F.broadcast(first), ["file", "line"]).groupBy(F.col("value").alias("header")).agg(
        F.collect_list("file").alias("files")
    )


def header_names(header: str) -> list[str]:
    """Column names of a header line; one without a name or seen before is named by its place."""
    names: list[str] = []
    for i, name in enumerate(next(csv.reader([header]), [])):
        name = name.lstrip("\ufeff")
        names.append(name if name and name not in names else f"_c{i}")
    return names


def with_rescue(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns matched to the schema by name and cast, the rest kept in ``_rescued_data``.

    A column that the text lacks is NULL. The rescue is a JSON object of the values that are not of
    their column's type, the values of columns that the schema lacks, the whole line when it has too
    many or too few fields, and the file. It is NULL for a clean row. No row is lost.
    """
    here = [name for name in raw.columns if name != BAD_LINE]
    values = {
        f.name: soft_cast(f.name, f.dataType.simpleString(), "string") if f.name in here
        else F.lit(None).cast(f.dataType)
        for f in schema.fields
    }
    misfits = {
        f.name: F.col(f.name).isNotNull() & values[f.name].isNull()
        for f in schema.fields
        if f.name in here and not isinstance(f.dataType, T.StringType)
    }
    misfits |= {name: F.col(f"`{name}`").isNotNull() for name in here if name not in schema.names}
    anything = F.col(BAD_LINE).isNotNull()
    for misfit in misfits.values():
        anything = anything | misfit
    kept = [F.when(misfit, F.col(f"`{name}`")).alias(name) for name, misfit in misfits.items()]
    rescued = F.to_json(F.struct(*kept, BAD_LINE, F.col("_metadata.file_path").alias("_file_path")))
    return raw.select(
        *[value.alias(name) for name, value in values.items()],
        F.when(anything, rescued).alias("_rescued_data"),
        F.current_timestamp().alias("_ingested_at"),
        F.col("_metadata.file_path").alias("_source_file"),
    )


def csv_batch(spark: SparkSession, paths: str | list[str], schema: T.StructType = SOURCE_SCHEMA) -> DataFrame:
    """Rows of CSV files, each read by the names in its own header.

    Files with one header are read together; there are as many readers as different headers.
    """
    out = None
    for found in headers(spark, paths).toLocalIterator():
        names = header_names(found.header)
        text = T.StructType([T.StructField(n, T.StringType()) for n in [*names, BAD_LINE]])
        raw = (
            spark.read.schema(text)
            .option("header", True)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", BAD_LINE)
            .csv([unquote(f) for f in found.files])  # metadata has paths as escaped URIs
        )
        rows = with_rescue(raw, schema)
        out = rows if out is None else out.union(rows)
    return out if out is not None else spark.createDataFrame([], landed_schema(schema))


def landed_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([
        *schema.fields, T.StructField("_rescued_data", T.StringType()),
        T.StructField("_ingested_at", T.TimestampType()), T.StructField("_source_file", T.StringType()),
    ])


def file_stream(spark: SparkSession, src_dir: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """The names of new files as a stream; a checkpoint remembers the ones it has seen.

    Only names are read here, no content.
    """
    return (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch).load(src_dir).select("path")
    )


def csv_files(df: DataFrame, compression: str = "none") -> DataFrameWriter:
    """Writer of CSV files with a header. Only plain ones can be read in byte ranges."""
    return df.write.options(header=True, compression=compression, maxRecordsPerFile=FILE_ROWS)


def write_csv(df: DataFrame, path: str, schema: T.StructType = SOURCE_SCHEMA, compression: str = "none") -> None:
    """Source columns as CSV with a header, a file per task or more."""
    csv_files(df.select(*schema.names), compression).csv(path)
