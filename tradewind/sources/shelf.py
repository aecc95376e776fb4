"""The shelf as files: CSV in and out, JSON lines, whole files with their digests, and tables kept by key."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..operators.ordinals import running
from ..schemas import REQUIRED, TABLES, raw_schema, typed_schema


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, with a header; a byte order mark is dropped, surplus cells are left out."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", True).csv(path)


class Shelf(dict):
    """Tables of a folder by name, typed. A missing optional table is empty; a missing required one is an error."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder = spark, folder

    def raw(self, table: str) -> DataFrame:
        path = f"{self.folder}/{table}.csv"
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            if table in REQUIRED:
                raise FileNotFoundError(path)
            return self.spark.createDataFrame([], raw_schema(table))
        return read_csv(self.spark, path)

    def __missing__(self, table: str) -> DataFrame:
        if table not in TABLES:
            raise KeyError(table)
        df = ingest.prepare(self.raw(table), table)
        self[table] = df = df.select(*(ingest.typed(table, c).alias(c) for c in TABLES[table])).to(typed_schema(table))
        return df


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line, value of the lines that hold no JSON object; blank lines are passed over but counted. Lines are numbered
    by where their file's blocks begin and their order in a block, over many tasks."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    parsed = F.try_parse_json("value")
    bad = ~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)) & (F.trim("value") != "")
    # Only numbers and marks are sorted; of the values, those of bad lines.
    marked = rows.select("path", "block", "id", F.when(bad, F.col("value")).alias("value"))
    numbered_rows = running(marked, ["path"], [F.col("block"), F.col("id")], {"line": F.lit(1)})
    return numbered_rows.filter("value is not null").select("path", "line", "value")


def files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = (), denied: tuple[str, ...] = ()) -> DataFrame:
    """path, group (its first folder below `folder`), extension, bytes, sha256, status (ok, too_large) of a folder's
    files, recursively, filtered by extension and by folder name. Spark lists no empty files."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    below = F.regexp_extract("path", re.escape("/" + folder.rstrip("/").rsplit("/", 1)[-1]) + "/(?:([^/]+)/)?[^/]*", 1)
    df = df.select("path", below.alias("group"), ext.alias("extension"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.when(F.col("length") > ingest.MOST_BYTES, "too_large").otherwise("ok").alias("status"))
    if extensions:
        df = df.filter(F.col("extension").isin(*extensions))
    for d in denied:
        df = df.filter(~F.col("path").contains(f"/{d}/"))
    return df


def text_of(content, encodings: tuple[str, ...] = ("UTF-8", "windows-1258", "ISO-8859-1")):
    """Bytes as text by the first encoding that has a character for all of them; a byte order mark is dropped."""
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    tries = [utf8 if e == "UTF-8" else _one_byte(content, e) for e in encodings]
    return F.regexp_replace(F.coalesce(*tries), "^\ufeff", "")


def _one_byte(content, encoding: str):
    """Text in an encoding of one byte a character, by its table; null where a byte has no character."""
    text, table, none = F.decode(content, "ISO-8859-1"), {}, ""
    for b in range(256):
        try:
            table[chr(b)] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            none += chr(b)
    other = {k: v for k, v in table.items() if k != v}
    read = F.translate(text, "".join(other), "".join(other.values())) if other else text
    return F.when(F.translate(text, none, "") == text, read) if none else read


def write_csv(df: DataFrame, path: str, mark: bool = True) -> bool:
    """CSV files with a header, each after a byte order mark; no rows write nothing, and give False."""
    if df.isEmpty():
        return False
    first = df.columns[0]
    named = df.withColumnRenamed(first, f"\ufeff{first}") if mark else df
    named.write.mode("overwrite").option("header", True).csv(path)
    return True


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `old` whose key `new` doesn't have, and all of `new`."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)
