"""CSV files with headers of their own, as one table of text whose rows are numbered in file order."""

import csv
import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.sizing import first_line, written

# Of up to so many files, the driver reads the first line itself.
DRIVER_FILES = 200

_HEADERS = pa.schema([("file", pa.string()), ("header", pa.string())])


def _first_lines(split_bytes: int, open_bytes: int):
    def first_lines(batches):
        """Lines of blocks that begin a file, cut to the first one of each file.

        A partition of one whole split holds no other file, so nothing more of it is read.
        """
        before = None
        for batch in batches:
            lines, files, starts, lengths = (batch.column(i) for i in range(4))
            names, places = files.to_pylist(), starts.to_pylist()
            found = []
            for i, (name, place) in enumerate(zip(names, places)):
                if name != before and place == 0:
                    found.append({"file": name, "header": lines[i].as_py()})
                before = name
            yield pa.RecordBatch.from_pylist(found, _HEADERS)
            if len(batch) and lengths[-1].as_py() + open_bytes > split_bytes:
                return

    return first_lines


def _bytes_of(setting: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", setting.lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit[:1]]


def _first_lines_of(spark: SparkSession, paths) -> list[tuple[str, str]]:
    """(file, first line) of every file that is not empty, by a job that reads little else."""
    split, opened = (
        _bytes_of(spark.conf.get(f"spark.sql.files.{name}"))
        for name in ("maxPartitionBytes", "openCostInBytes")
    )
    lines = spark.read.text(paths).select(
        "value", "_metadata.file_path", "_metadata.file_block_start", "_metadata.file_block_length"
    )
    firsts = lines.mapInArrow(_first_lines(split, opened), "file string, header string")
    return [(row.file, row.header) for row in firsts.collect()]


def headers(spark: SparkSession, paths, driver_files: int = DRIVER_FILES):
    """(columns, files) for every distinct header line; all but the first lines is left unread.

    The driver opens a few files itself, and has a job do so for many. It gets a name and a line per
    file, as it does when Spark lists the files.
    """
    files = spark.read.text(paths).inputFiles()
    if len(files) <= driver_files:
        found = [(file, first_line(spark, unquote(file))) for file in files]
    else:
        found = _first_lines_of(spark, paths)
    by_header: dict[str, list[str]] = {}
    for file, line in sorted(found):
        if line is not None:
            by_header.setdefault(line.removeprefix("\ufeff").rstrip("\r"), []).append(file)
    return [(next(csv.reader([line])), files) for line, files in by_header.items()]


def _path(file: str) -> str:
    """A file's own name as a path for readers, which take some characters for patterns."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(file))


def read_tables(spark: SparkSession, paths, needed) -> list[DataFrame]:
    """One DataFrame of text per distinct header.

    Columns are named by the headers, so files may have them in any order. A header without one of
    `needed` is an error.
    """
    tables = []
    for columns, files in headers(spark, paths):
        lacking = [name for name in needed if name not in columns]
        if lacking:
            raise ValueError(f"{files[0]}: no column {', '.join(lacking)} in its header")
        schema = ", ".join(f"`{name.replace('`', '``')}` STRING" for name in columns)
        table = spark.read.schema(schema).option("header", True).csv([_path(f) for f in files])
        tables.append(table)
    return tables


def with_positions(tables: list[DataFrame], name: str) -> list[DataFrame]:
    """The tables with the column `name`: the exact place of a row, from 0, in all files together.

    Files follow each other by path, and rows as they stand in a file. A first pass counts the rows
    of each block of a file; running sums of these counts, of which there is one row per block, give
    the place of a block's first row. Should blocks be cut in another way when the rows are read, an
    error says so.
    """
    tables = [
        table.select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_id"),
        )
        for table in tables
    ]
    counts = None
    for number, table in enumerate(tables):
        own = table.groupBy("_file", "_block").agg(
            F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first")
        )
        own = own.withColumn("_table", F.lit(number))
        counts = own if counts is None else counts.unionByName(own)
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    starts = written(starts, "csv-blocks")
    placed = []
    for number, table in enumerate(tables):
        own = starts.where(F.col("_table") == number).drop("_table", "_rows")
        inside = F.col("_id") - F.col("_first")
        same = (inside >= 0) & (inside < (1 << 33))
        changed = F.raise_error(F.lit("the files were cut into other blocks than when counted"))
        place = F.when(same, F.col("_start") + inside).otherwise(changed.cast("bigint"))
        joined = table.join(own, ["_file", "_block"], "left").withColumn(name, place)
        placed.append(joined.drop("_file", "_block", "_id", "_first", "_start"))
    return placed
