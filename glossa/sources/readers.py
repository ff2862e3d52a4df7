"""Scans and sinks of reading-time corpora and predictor tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.session import cut, small_side

ABSENT = "\x00absent"
#: What the Windows-1252 code page has at 0x80 to 0x9f, in order; undefined codes keep their own.
CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def read_table(spark: SparkSession, path: str, schema: str | None = None, sep: str = "\t", quoting: bool = True, empty_is_null: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """A delimited table with a header whose words 'NA', 'null' and
    'nan' stay strings. quoting off reads quotes as they are; empty_is_null makes ''
    missing."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("nullValue", "" if empty_is_null else ABSENT)
    reader = reader.option("emptyValue", "") if not quoting else reader.option("emptyValue", "").option("quote", '"').option("escape", '"')
    reader = reader if quoting else reader.option("quote", "")
    read = (reader.schema(schema) if schema else reader).csv(path)
    if empty_is_null:
        return read
    return read.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in read.dtypes])


def from_cp1252(text: Column) -> Column:
    """Text read as ISO-8859-1 whose bytes were Windows-1252."""
    return F.translate(text, "".join(map(chr, range(0x80, 0xA0))), CP1252)


def read_fixation_files(spark: SparkSession, folder: str, pattern: str, name: str, columns: list[str], on: str = "file_name") -> DataFrame:
    """White-space separated Windows-1252 files; worker and text id come from
    the file's name (or path: on) by the regular expression name (two groups),
    row_idx keeps the order within a file."""
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("encoding", "ISO-8859-1").option("sep", "\x00").option("quote", "").option("header", False).schema("line string").csv(folder)
    file = F.col(f"_metadata.{on}")
    parts = F.filter(F.split(from_cp1252(F.col("line")), r"\s+"), lambda w: w != "")
    rows = lines.select(F.regexp_extract(file, name, 1).alias("worker"), F.regexp_extract(file, name, 2).cast("long").alias("text_id"), parts.alias("parts"), F.monotonically_increasing_id().alias("row_idx"))
    header = F.get("parts", F.lit(0)) == columns[0]
    return rows.where(~header & (F.size("parts") > 0)).select("worker", "text_id", "row_idx", *[F.get("parts", F.lit(k)).alias(c) for k, c in enumerate(columns)])


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """One passage a line; the id is the line's number from 0 over the files in
    the order of their paths, and blank lines keep theirs. Lines are numbered within
    their block of a file; a row a block says how many lines lie before it."""
    block = ["path", "start"]
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), F.rtrim(F.col("value"), F.lit("\r")).alias("text"))
    blocks = cut(lines.groupBy(*block).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.select(*block, "first", before.alias("before"))
    return lines.join(small_side(placed, blocks.count()), block).select((F.col("before") + F.col("row") - F.col("first")).alias("text_id"), "text")


def write_passages(passages: DataFrame, path: str) -> None:
    """One line a passage in the order of ids."""
    passages.orderBy("text_id").select("text").write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str, sep: str | None = None, quoting: bool = True, encoding: str = "UTF-8", parts: list[str] | None = None) -> None:
    """Parquet, or delimited text where sep is given, in folders by the columns
    parts; Spark's committer swaps it in whole."""
    writer = rows.write.mode("overwrite").partitionBy(*(parts or []))
    if sep is None:
        return writer.parquet(path)
    quotes = {"quote": '"', "escape": '"'} if quoting else {"quote": ""}
    writer.options(sep=sep, header=True, emptyValue="", nullValue="", encoding=encoding, **quotes).csv(path)


def read_result_grid(spark: SparkSession, folder: str, pattern: str, name: str, families: dict[str, str] | None = None, on: str = "file_name") -> DataFrame:
    """All result files of a grid that are there, tagged dataset and model from
    their names (or paths) by a pattern of two groups, and the model's family."""
    read = spark.read.options(pathGlobFilter=pattern, recursiveFileLookup=True, header=True, sep="\t").csv(folder)
    file = F.col(f"_metadata.{on}")
    tagged = read.select("*", F.regexp_extract(file, name, 1).alias("dataset"), F.regexp_extract(file, name, 2).alias("model"))
    known = F.create_map(*[F.lit(x) for pair in (families or {"": ""}).items() for x in pair])
    return tagged.withColumn("family", F.coalesce(F.element_at(known, F.col("model")), F.substring_index("model", "-", 1)))
