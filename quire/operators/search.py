"""Locating strings: every occurrence of a quote in a block, and the nodes that it touches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Longest quote in bytes, most occurrences that are listed.
MAX_QUOTE = 16_384
MAX_OCCURRENCES = 1_000_000
#: Quotes that are searched at once: bounds what a task holds.
BLOCK = 4096


def _find(batches, quotes):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for q, text in quotes:
        machine.add_word(text, [*machine.get(text, []), q])
    machine.make_automaton()
    size = {q: len(text) for q, text in quotes}
    for batch in batches:
        docs, ids, starts = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for end, qs in machine.iter(text.as_py() or ""):
                for q in qs:
                    docs.append(doc)
                    ids.append(q)
                    starts.append(end + 1 - size[q])
        yield pa.RecordBatch.from_arrays([pa.array(docs, batch.column(0).type), pa.array(ids, pa.int64()), pa.array(starts, pa.int64())], ["block", "quote", "start"])


def refused(quotes: DataFrame) -> DataFrame:
    """Quotes that can't be asked for: empty ones and those over the limit."""
    return quotes.where((F.octet_length("text") == 0) | (F.octet_length("text") > MAX_QUOTE) | F.col("text").isNull())


def locate(blocks: DataFrame, quotes: DataFrame) -> DataFrame:
    """(block, quote, start, length): every occurrence, overlapping ones included, in code points.

    blocks: (block, text); quotes: (quote, text). One pass over the blocks for
    each BLOCK quotes, whatever their number there.
    """
    spark = blocks.sparkSession
    kind = dict(blocks.dtypes)["block"]
    asked = quotes.join(refused(quotes).select("quote"), "quote", "left_anti")
    n = asked.count()
    out = spark.createDataFrame([], f"block {kind}, quote bigint, start bigint")
    parts = max(1, -(-n // BLOCK))
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("quote"), F.lit(parts)))
    for p in range(parts if n else 0):
        some = [(r["quote"], r["text"]) for r in dealt.where(F.col("part") == p).collect()]
        out = out.unionByName(blocks.select("block", "text").mapInArrow(lambda b, s=some: _find(b, s), f"block {kind}, quote bigint, start bigint"))
    return out.join(quotes.select("quote", F.length("text").cast("bigint").alias("length")), "quote").select("block", "quote", "start", "length")


def withheld(found: DataFrame, ceiling: int = MAX_OCCURRENCES) -> DataFrame:
    """(quote, occurrences, withheld): over the ceiling no place is listed, the count stays."""
    return found.groupBy("quote").agg(F.count("*").alias("occurrences")).withColumn("withheld", F.col("occurrences") > ceiling)


def offsets(members: DataFrame, block: str, order: str) -> DataFrame:
    """Members with their start and end in the block, by sums of the lengths before."""
    w = W.partitionBy(block).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).cast("bigint")
    return members.withColumn("m_start", start).withColumn("m_end", F.col("m_start") + F.length("text"))


def parts(found: DataFrame, members: DataFrame, block: str = "block", order: str = "ord") -> DataFrame:
    """(block, quote, start, node, char_start, char_end): the members that an occurrence touches, in their own offsets."""
    end = F.col("start") + F.col("length")
    both = found.join(members, block).where((F.col("m_start") < end) & (F.col("m_end") > F.col("start")))
    return both.select(block, "quote", "start", F.col(order).alias("node"), (F.greatest("start", "m_start") - F.col("m_start")).alias("char_start"), (F.least(end, F.col("m_end")) - F.col("m_start")).alias("char_end"))


def node_get(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of these ids, with found false for ids that no node has."""
    return ids.join(nodes.withColumn("found", F.lit(True)), [c for c in ids.columns], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def touching(segments: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, span, segment, kind): the segments that a span [a, b) overlaps."""
    return spans.join(segments, key).where((F.col("s_start") < F.col("b")) & (F.col("a") < F.col("s_end"))).select(key, "span", "segment", "kind")


def invertible(segments: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, span, invertible): the span touches segments, all of them from the source."""
    hit = touching(segments, spans, key).groupBy(key, "span").agg(F.bool_and(F.col("kind") == "source").alias("all"))
    return spans.join(hit, [key, "span"], "left").select(key, "span", (F.coalesce("all", F.lit(False)) & (F.col("b") > F.col("a"))).alias("invertible"))
