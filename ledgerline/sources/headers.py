"""Header rows of CSV files, resolved file by file.

A folder may hold files with different column orders or further columns. The
first record of each file is read (by its file system, a few at a time; no
data beyond it), files of one header form a group, and each group is read with
its own column names. Rows of all groups are then put together by name.
"""

from __future__ import annotations

import csv
import io
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A value that never occurs in a feed, used as the CSV null marker so that
# empty cells stay empty text while missing cells (short rows) become null.
NO_NULL = "\u0000<none>\u0000"

# Standard CSV: a quote inside a quoted field is doubled, and blanks around a
# cell belong to it.
STANDARD_CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
                "ignoreTrailingWhiteSpace": False}

#: Files whose first record is read at once.
READERS = 16
#: The column that only rows with more cells than their header fill.
EXTRA = "_extra"


def named(name: str) -> Column:
    """Column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def safe_names(cells: list[str]) -> list[str]:
    """Column names of a header row: names without text become ``_c<place>``,
    names that occur twice (in any case) get their place appended."""
    seen = Counter(c.lower() for c in cells)
    return [f"_c{i}" if not c else f"{c}{i}" if seen[c.lower()] > 1 else c for i, c in enumerate(cells)]


def _first_record(spark: SparkSession, file: str, encoding: str, multi_line: bool) -> str | None:
    """Text of the first record that isn't blank; None if there is none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        source = codec.createInputStream(stream) if codec else stream
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(source, encoding))
        record = None
        while (line := reader.readLine()) is not None:
            line = line.removeprefix("\ufeff") if record is None else line
            if record is None and not line.strip():
                continue
            record = line if record is None else f"{record}\n{line}"
            if not multi_line or record.count('"') % 2 == 0:
                break
        return record
    finally:
        stream.close()


def header_groups(spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "UTF-8",
                  multi_line: bool = False) -> list[tuple[list[str], list[str]]]:
    """(column names, files) for each different header, in the order of their
    first file; files without any record are left out."""
    files = sorted(unquote(f) for f in spark.read.text(path).inputFiles())  # names as the file system has them
    with ThreadPoolExecutor(READERS) as pool:
        records = list(pool.map(lambda f: _first_record(spark, f, encoding, multi_line), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, record in zip(files, records):
        if record is not None:
            cells = next(csv.reader(io.StringIO(record, newline=""), delimiter=sep))
            groups.setdefault(tuple(safe_names(cells)), []).append(file)
    return [(list(names), found) for names, found in groups.items()]


def read_group(spark: SparkSession, names: list[str], files: list[str], sep: str = ",", encoding: str = "UTF-8",
               multi_line: bool = False) -> DataFrame:
    """All-text rows of files with one header, and ``_extra``. Empty cells stay
    empty, missing ones are null. ``multi_line`` allows line breaks inside
    quoted cells; such a file can't be split, so large inputs should be many
    files."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, EXTRA]])
    return (spark.read.options(**STANDARD_CSV).option("sep", sep).option("encoding", encoding)
            .option("multiLine", multi_line).option("mode", "PERMISSIVE").option("nullValue", NO_NULL)
            .schema(schema).csv(files))


def put_together(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts by column name; columns that a part lacks are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
