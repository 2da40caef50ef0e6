"""What a file is, from its first bytes and never from its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def media_type(content: Column) -> Column:
    """pdf, zip, rtf, png, jpeg, or null: what no reader is there for."""
    head = lambda n: F.hex(F.substring(content, 1, n))
    return (
        F.when(head(5) == "255044462D", "pdf")
        .when(head(4).isin("504B0304", "504B0506"), "zip")
        .when(head(5) == "7B5C727466", "rtf")
        .when(head(8) == "89504E470D0A1A0A", "png")
        .when(head(3) == "FFD8FF", "jpeg")
    )


def aims_at_pdf(content: Column) -> Column:
    """Whether a PDF reader's own refusal is the right one: the mark stands first, or all there is is a part of its beginning, nothing included."""
    head = F.hex(F.substring(content, 1, 5))
    return F.when(F.octet_length(content) >= 5, head == "255044462D").otherwise(F.lit("255044462D").startswith(head))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, media) of all files under a path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", "length", "content", media_type(F.col("content")).alias("media"))
