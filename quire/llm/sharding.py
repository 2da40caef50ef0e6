"""Sharding by extendible hashing, with DataFrame functions only.

A directory is indexed by the first bits of a hash. A bucket whose bytes go
over the limit splits on the next bit, the others stay; a document belongs to
the shortest prefix whose bucket fits. Sizes are summed once for each of the
finest cells, and the sums of every shorter prefix follow from those, so no
level reads the documents again. Cells that are still too large are refined by
all further bits of the hash; what shares a whole hash
(rows that repeat, rows with one id) can't be told apart by bits, and is dealt
to numbered pages of the bucket, as with overflow pages, in as many runs as its
bytes need. Which page such a row gets depends on the layout of the input. A
single document over the limit has a page of its own and ``oversize`` set.

A null id is an id like any other, a null text has no bytes. An empty table
gives an empty result. Other columns are kept by ``shard`` and not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm import store

BITS = 60
SEED = "shard-1"
LIMIT = 128 << 20

#: Of the query: small enough for the tables at hand to split.
OP9_LIMIT = 1 << 20


def hash_bits(key, seed: str = SEED) -> F.Column:
    """60 bits as a long, most significant first, from a SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256), 1, BITS // 4), 16, 10).cast("long")


def prefix(h, bits: int) -> F.Column:
    """The first bits of the hash, as a number."""
    return F.shiftright(h, BITS - bits)


def _leaves(cells: DataFrame, start: int, end: int, limit: int) -> DataFrame:
    """(depth, bits, bytes): the buckets, prefixes from ``start`` bits on that fit while the one a bit shorter doesn't.

    cells: (cell, bytes) of ``end`` bits. A cell that itself doesn't fit is a
    bucket of its own. Sums are taken before the shuffle, and each prefix meets
    its parent only.
    """
    sums = cells.select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("depth"), "cell", "bytes").groupBy("depth", F.expr(f"shiftright(cell, {end} - depth)").alias("bits")).agg(F.sum("bytes").alias("bytes"))
    sums = store.written(sums, "shard-sums")
    parent = sums.select((F.col("depth") + 1).alias("depth"), F.col("bits").alias("up"), F.col("bytes").alias("up_bytes"))
    both = sums.withColumn("up", F.shiftright("bits", 1)).join(parent, ["depth", "up"], "left")
    return both.where(((F.col("bytes") <= limit) | (F.col("depth") == end)) & ((F.col("depth") == start) | (F.col("up_bytes") > limit))).select("depth", "bits", "bytes")


def _dense(leaves: DataFrame, end: int) -> DataFrame:
    """The bucket of each of the 2**end cells, by spreading every bucket over its cells; ``assign`` bounds them by the rows."""
    width = F.expr(f"shiftleft(1L, {end} - depth)")
    return leaves.select(F.explode(F.sequence(F.col("bits") * width, (F.col("bits") + 1) * width - 1)).alias("cell"), "depth", "bits", "bytes")


def _sparse(leaves: DataFrame, cells: DataFrame, start: int, end: int) -> DataFrame:
    """The bucket of each of a few cells, by looking for its prefixes."""
    prefixes = cells.select("cell", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("depth")).withColumn("bits", F.expr(f"shiftright(cell, {end} - depth)"))
    return prefixes.join(leaves, ["depth", "bits"]).select("cell", "depth", "bits", "bytes")


def assign(rows: DataFrame, limit: int) -> DataFrame:
    """rows (with __hash and __bytes) and depth, shard_id, shard_bytes, oversize.

    Cells are about a 64th of a shard, so nearly every bucket is found among
    them, but no more than twice the rows, however large these are. Cells that are too large by themselves hold heavy ids or texts; their
    hashes, taken whole, are the cells of a second ladder.
    """
    names = rows.columns
    rows = store.written(rows.withColumn("__quire_row", F.monotonically_increasing_id()), "shard-rows")
    total, n = rows.agg(F.coalesce(F.sum("__quire_bytes"), F.lit(0)), F.count("*")).first()
    fine = 1
    while fine < BITS and (total >> fine) > limit >> 6 and 1 << fine < n:
        fine += 1
    cells = rows.groupBy(prefix(F.col("__quire_hash"), fine).alias("cell")).agg(F.sum("__quire_bytes").alias("bytes"))
    first = store.written(_dense(_leaves(cells, 0, fine, limit), fine), "shard-cells")
    heavy = first.where(F.col("bytes") > limit).select("cell")
    hashes = rows.select("__quire_hash", "__quire_bytes").join(heavy, prefix(F.col("__quire_hash"), fine) == F.col("cell"), "left_semi").groupBy(F.col("__quire_hash").alias("cell")).agg(F.sum("__quire_bytes").alias("bytes"))
    second = store.written(_sparse(_leaves(hashes, fine, BITS, limit), hashes, fine, BITS), "shard-cells")
    first = first.where(F.col("bytes") <= limit).select(F.col("cell").alias("__quire_cell"), F.struct("depth", "bits", "bytes").alias("__quire_b1"))
    second = second.select(F.col("cell").alias("__quire_whole"), F.struct("depth", "bits", "bytes").alias("__quire_b2"))
    both = rows.join(first, prefix(F.col("__quire_hash"), fine) == F.col("__quire_cell"), "left").join(second, F.col("__quire_hash") == F.col("__quire_whole"), "left").withColumn("__quire_b", F.coalesce("__quire_b1", "__quire_b2"))
    name = F.concat_ws("-", F.lpad(F.col("__quire_b.depth").cast("string"), 2, "0"), F.lpad(F.lower(F.hex("__quire_b.bits")), BITS // 4, "0"))
    keep = [F.col(f"`{c}`") for c in names]
    fits = both.where(F.col("__quire_b.bytes") <= limit).select(*keep, F.col("__quire_b.depth").alias("depth"), name.alias("shard_id"), F.col("__quire_b.bytes").alias("shard_bytes"), F.lit(False).alias("oversize"))
    # What shares a whole hash: salted runs of about eight shards, so that none holds all of a hot id, and pages of so many rows as fit at the run's largest size.
    both = both.withColumn("__quire_salt", F.pmod(F.col("__quire_row"), F.ceil(F.col("__quire_b.bytes") / F.lit(8 * limit))))
    run = W.partitionBy("__quire_hash", "__quire_salt")
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.max("__quire_bytes").over(run), F.lit(1))))
    over = both.where(F.col("__quire_b.bytes") > limit).withColumn("__quire_each", each).withColumn("__quire_page", F.floor((F.row_number().over(run.orderBy("__quire_bytes")) - 1) / F.col("__quire_each")))
    size = F.sum("__quire_bytes").over(W.partitionBy("__quire_hash", "__quire_salt", "__quire_page"))
    over = over.select(*keep, F.col("__quire_b.depth").alias("depth"), F.concat_ws("-", name, F.col("__quire_salt").cast("string"), F.col("__quire_page").cast("string")).alias("shard_id"), size.alias("shard_bytes"), (F.col("__quire_bytes") > limit).alias("oversize"))
    return fits.unionByName(over)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.withColumn("__quire_hash", hash_bits(F.col(f"`{key}`"))).withColumn("__quire_bytes", F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long"))


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs with shard_id, which has the depth and bits of its bucket."""
    return assign(_keyed(docs, key, text), limit).select(*(F.col(f"`{c}`") for c in docs.columns), "shard_id")


def op9_extendible_shards(spark: SparkSession, sf_dir: str, limit: int = OP9_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, depth, shard_id, shard_bytes, oversize) of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = _keyed(docs, "doc_id", "text").drop("text")
    return assign(rows, limit).select("doc_id", F.col("__quire_bytes").alias("n_bytes"), F.col("depth").cast("int").alias("depth"), "shard_id", "shard_bytes", "oversize")


#: Level by level: a bucket over the limit gives its rows to the next bit. {docs}: the relation that is sharded; ids must not repeat.
SHARD_SQL = r"""
keyed AS (SELECT *, ('0x' || substr(sha256('shard-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes FROM {docs}),
summed AS (SELECT d.depth, h >> (60 - d.depth)::INT AS bits, sum(n_bytes)::BIGINT AS shard_bytes FROM keyed, (SELECT unnest(generate_series(0, 60)) AS depth) d GROUP BY ALL),
placed AS (SELECT k.*, s.depth, s.bits, s.shard_bytes, row_number() OVER (PARTITION BY k.h, k.doc_id ORDER BY s.depth) AS n
  FROM keyed k, (SELECT unnest(generate_series(0, 60)) AS depth) d JOIN summed s ON s.depth = d.depth AND s.bits = k.h >> (60 - d.depth)::INT WHERE s.shard_bytes <= {limit}),
sharded AS (SELECT *, lpad(depth::VARCHAR, 2, '0') || '-' || lpad(lower(to_hex(bits)), 15, '0') AS shard_id FROM placed WHERE n = 1)
"""

OP9_SQL = "WITH " + SHARD_SQL.format(docs="documents", limit=OP9_LIMIT) + "SELECT doc_id, n_bytes, depth::INT AS depth, shard_id, shard_bytes, false AS oversize FROM sharded"
