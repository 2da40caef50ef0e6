"""Jobs over a folder of files: ``python -m quire classify PATH`` and ``python -m quire extract PATH OUT``.

classify prints how many files of each kind are read and refused, and ends with
0 if all are read, 1 if some need attention, 2 if none is. extract writes the
runs of PDF files and the nodes of office files and RTF as Parquet, a refused
file as a row with its reason, and ends alike.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.sources import office, pdf, routing

USAGE = "usage: python -m quire classify PATH | extract PATH OUT"


def nodes(files: DataFrame) -> DataFrame:
    """(path, format, ord, address, text, refusal) of every file (path, content, media), in the order of each."""
    drawn = pdf.runs(files.where("media = 'pdf'"))
    place = F.when(F.col("ord").isNotNull(), F.concat_ws(":", F.col("page").cast("string"), F.col("x").cast("string"), F.col("y").cast("string")))
    order = F.when(F.col("ord").isNotNull(), F.row_number().over(W.partitionBy("path").orderBy("page", "ord")) - 1).cast("bigint")
    drawn = drawn.select("path", F.lit("pdf").alias("format"), order.alias("ord"), place.alias("address"), "text", "refusal")
    flowed = office.nodes(files.where("media in ('zip', 'rtf')")).select("path", "format", "ord", F.concat_ws("!", "part", "address").alias("address"), "text", "refusal")
    other = files.where("media is null or media not in ('pdf', 'zip', 'rtf')").select("path", F.col("media").alias("format"), F.lit(None).cast("bigint").alias("ord"), F.lit(None).cast("string").alias("address"), F.lit(None).cast("string").alias("text"), F.lit("unsupported-format").alias("refusal"))
    return drawn.unionByName(flowed).unionByName(other)


def summary(found: DataFrame) -> DataFrame:
    """(format, read, refused): files of each kind."""
    per = found.groupBy("path").agg(F.first("format").alias("format"), F.max("refusal").alias("refusal"))
    return per.groupBy("format").agg(F.count_if(F.col("refusal").isNull()).alias("read"), F.count("refusal").alias("refused"))


def main(argv: list[str], spark: SparkSession) -> int:
    if not (argv[:1] == ["classify"] and len(argv) == 2 or argv[:1] == ["extract"] and len(argv) == 3):
        print(USAGE, file=sys.stderr)
        return 2
    found = nodes(routing.files(spark, argv[1]))
    if argv[0] == "extract":
        found.write.mode("error").parquet(argv[2])
        found = spark.read.parquet(argv[2])
    rows = summary(found).orderBy("format").collect()  # a row for each kind of file
    for r in rows:
        print(f"{r['format'] or 'unknown'}\t{r['read']}\t{r['refused']}")
    read, refused = (sum(r[c] for r in rows) for c in ("read", "refused"))
    return 0 if read and not refused else 1 if read else 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:], SparkSession.builder.appName("quire").getOrCreate()))
