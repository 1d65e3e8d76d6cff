"""Line sources: files, framed chunks, and their time stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Longest line from a socket and from a pipe.
MAX_SOCKET_LINE, MAX_PIPE_LINE = 1024, 65536


def read_lines(spark: SparkSession, path: str, keep_bytes: bool = False) -> DataFrame:
    """(seq, line) of text files, blank lines included. seq follows partition and place, so lines of one file are in
    order. keep_bytes reads every byte as one character, for lines that aren't UTF-8."""
    if keep_bytes:
        rows = spark.read.option("sep", "\u0001").option("quote", "").option("escape", "").option("encoding", "ISO-8859-1").schema("line string").csv(path)
        rows = rows.select(F.coalesce("line", F.lit("")).alias("line"))
    else:
        rows = spark.read.text(path).withColumnRenamed("value", "line")
    return rows.select(F.monotonically_increasing_id().alias("seq"), "line")


def stream_lines(spark: SparkSession, directory: str, per_batch: int = 100) -> DataFrame:
    """The same for a directory that files land in."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", per_batch).load(directory).withColumnRenamed("value", "line")


def framed(chunks: DataFrame, max_length: int = MAX_SOCKET_LINE) -> DataFrame:
    """(seq, place, line) of the complete lines in rows (seq, chunk): one carriage return is stripped from the end,
    empty lines are left out, lines longer than max_length with it are dropped whole. A chunk ends with its last line
    feed; what follows belongs to the next chunk, so chunks are cut at line feeds by whoever writes them."""
    raw = chunks.select("seq", F.posexplode(F.split("chunk", "\n", -1)).alias("place", "raw"))
    line = F.regexp_replace("raw", "\r$", "")
    return raw.filter(F.length("raw") <= max_length).select("seq", "place", line.alias("line")).filter("line <> ''")


def slice_of_area(fixes: DataFrame, hour_start: float, south: float, west: float, north: float, east: float) -> DataFrame:
    """One hour of one box."""
    inside = F.col("lat").between(south, north) & F.col("lon").between(west, east)
    return fixes.filter((F.col("t") >= hour_start) & (F.col("t") < hour_start + 3600) & inside)
