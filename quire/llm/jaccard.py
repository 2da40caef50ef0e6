"""Similarity join on word shingles: a grouped prefix join.

A document is the set of its distinct five-word shingles. In one order of all
shingles, rare ones first, two sets of similarity 0.75 share one of their first
few shingles (the prefix). Documents of one prefix and size form a group, sets
that are equal one class; groups that share a prefix shingle, and fit by size
and by the places of that shingle, are expanded to their members and compared.

A family of n near copies has n * n / 2 links, all in one component, so not all
are verified. First every group is compared with the leaders of its shingles,
groups most of whose prefix others have too, and every class with the least of
its group. Then, in rounds, what a shingle still holds of different components
(parts of groups) is compared with a leader out of the shingle's largest
component, another one in each round. When
rounds no longer halve what is left, or little is left, all pairs of parts of
different components that share a shingle and fit are made distinct, expanded
to their classes and compared. A pair that is never compared is one whose
members are connected already, so no component loses a link. The rounds are run
twice: with a bound of the intersection, which tells whose sets are needed, and
with the sets.

The order puts shingles that more than RARE documents have behind all others,
so that a passage with many readers is no reason to compare them. For that
every slice sends a short fingerprint of each of its shingles, which are
counted over all documents; the frequent ones come back. A fingerprint is a
function of the shingle, so all documents sort alike even where two shingles
share one. Of the shingles themselves only those of prefixes are sent, and only
those that occur twice are posted.

Shingles and sets are told by 64-bit hashes (``quire.llm.text``): among n
distinct shingles two agree with a chance of n * n / 2**65.

Documents without words or text have no set, link with nothing and are their
own component. Those under five words have one shingle, the whole. Repeated
rows and equal ids are rows like any other; the component of rows whose ids are
all null is null. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import components, repeats, store
from quire.llm import text as X

SPAN = 5
#: Links need 100 * intersection >= SIMILAR * union.
SIMILAR = 75
#: Documents beyond which a shingle is frequent.
RARE = 48
#: Leaders that a group is compared with in each round.
LEADERS = 2
#: Pairs for each part of a shingle that count as little.
LITTLE = 4
#: Buckets of a set's counts, from which an intersection is bounded before sets are sent.
CELLS = 512
#: Of a sieve: bits for each row, of one of its tables (as bitmap_construct_agg has them), and most tables, 8 MB.
BITS, TABLE, TABLES = 32, 1 << 15, 1 << 11

SLICE, NAMES = 1 << 20, 8 << 20


def shingles(buf: np.ndarray, off: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle, repeats included. Texts under ``span`` words have one, of all their words."""
    low = X.LOWER[buf]
    start, end, first = X.words(low, off)
    h = X.word_hashes(low, start, end)
    sums = X.prefix_sums(h)
    n = np.diff(first)
    row, place = X.ragged(np.where(n > 0, np.maximum(n - span + 1, 1), 0))
    at = first[:-1][row] + place
    return row, X.range_hash(sums, at, np.minimum(at + span, first[1:][row]))


def _pack(sorted_values: np.ndarray) -> bytes:
    """Sorted 32-bit values as differences, byte by byte, which compress well."""
    return np.diff(sorted_values, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.uint32)


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def _seen(table: pa.Table, groups: int) -> pa.Table:
    """Fingerprints of all shingles of a slice, each with its number of documents there."""
    own = int(table.column("slice")[0].as_py())
    row, h = shingles(*X.utf8(table.column("text")))
    pair = np.unique((_fingerprint(h).astype(np.uint64) << np.uint64(32)) | row.astype(np.uint64))
    prints, often = np.unique((pair >> np.uint64(32)).astype(np.uint32), return_counts=True)
    often = np.minimum(often, 255).astype(np.uint8)
    part = (prints.astype(np.uint64) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
    edge = np.searchsorted(part, np.arange(groups + 1))
    rows = [(k, own, _pack(prints[a:b]), often[a:b].tobytes()) for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
    return repeats._table(rows, ["grp", "slice", "prints", "often"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])


def _frequent(table: pa.Table) -> pa.Table:
    """For each slice those of its fingerprints that more than RARE documents have."""
    prints = [_unpack(x.as_py()) for x in table.column("prints")]
    often = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("often")])
    u, inv = np.unique(np.concatenate(prints), return_inverse=True)
    many = (np.bincount(inv, often.astype(np.float64), len(u)) > RARE)[inv]
    rows, at = [], 0
    for own, p in zip(table.column("slice").to_pylist(), prints, strict=True):
        if many[at : at + len(p)].any():
            rows.append((own, _pack(p[many[at : at + len(p)]])))
        at += len(p)
    return repeats._table(rows, ["slice", "often"], [pa.int64(), pa.binary()])


def _often(table: pa.Table) -> np.ndarray:
    """The frequent fingerprints that were sent to a slice, in order."""
    parts = [_unpack(x.as_py()) for x in table.column("often") if x.as_py() is not None]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)


class Sets:
    """Of each document of a piece: the ordered set, its prefix, and what names group and class."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, often: np.ndarray):
        row, h = shingles(buf, off)
        prints = _fingerprint(h)
        late = often[np.minimum(np.searchsorted(often, prints), len(often) - 1)] == prints if len(often) else np.zeros(len(h), bool)
        key = (late.astype(np.uint64) << np.uint64(63)) | (X.mix(h) >> np.uint64(1))
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        self.row, self.key = row[new], key[new]
        n = len(off) - 1
        self.size = np.bincount(self.row, minlength=n)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.prefix = np.where(self.size > 0, self.size - (SIMILAR * self.size + 99) // 100 + 1, 0)
        sums = X.prefix_sums(self.key)
        begin = self.first[:-1]
        self.group = X.mix(X.tree_hash(self.key, begin, begin + self.prefix, sums) + self.size.astype(np.uint64))
        self.whole = X.tree_hash(self.key, begin, self.first[1:], sums)

    def prefixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place and shingle of every prefix shingle."""
        row, place = X.ragged(self.prefix)
        return row, place, self.key[self.first[:-1][row] + place]


_ASK = ["grp", "slice", "names", "often"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]


def _ask(table: pa.Table, often: pa.Table, groups: int) -> pa.Table:
    if not table.num_rows:
        return repeats._table([], *_ASK)
    own = int(table.column("slice")[0].as_py())
    s = Sets(*X.utf8(table.column("text")), _often(often))
    row, _, key = s.prefixes()
    order = np.lexsort((s.whole[row], key))
    key, whole = key[order], s.whole[row][order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    differ = np.zeros(len(key), bool)
    differ[1:] = ~first[1:] & (whole[1:] != whole[:-1])  # sets of one group link too
    names = key[at]
    often = (1 + (np.add.reduceat(differ.astype(np.int64), at) > 0)).astype(np.uint8) if len(at) else np.zeros(0, np.uint8)
    order, cuts = repeats._cuts(repeats._deal(names, groups))
    rows = [(k, own, names[order[a:b]].tobytes(), often[order[a:b]].tobytes()) for k, a, b in cuts]
    return repeats._table(rows, *_ASK)


def _answer(table: pa.Table) -> pa.Table:
    names, sizes = repeats._packed(table.column("names"), np.uint64)
    often, _ = repeats._packed(table.column("often"), np.uint8)
    u, inv = np.unique(names, return_inverse=True)
    yes = (np.bincount(inv, often.astype(np.float64), len(u)) >= 2)[inv]
    rows, at = [], 0
    for own, n in zip(table.column("slice").to_pylist(), sizes.tolist(), strict=True):
        if yes[at : at + n].any():
            rows.append((own, names[at : at + n][yes[at : at + n]].tobytes()))
        at += n
    return repeats._table(rows, ["slice", "names"], [pa.int64(), pa.binary()])


MEMBERS = "doc_id bigint, text_hash bigint, n_shingles bigint, grp bigint, whole bigint, shared array<struct<token:bigint,pos:int>>, cells binary"


def _members(docs: pa.Table, told: pa.Table) -> pa.Table:
    """A row for each document; counts by cell only where it shares a prefix shingle with another, and no equal set of the slice came before."""
    ids = docs.column("doc_id")
    s = Sets(*X.utf8(docs.column("text")), _often(told))
    n = len(s.size)
    names = [np.frombuffer(x.as_py(), np.uint64) for x in told.column("names") if x.as_py() is not None]
    names = np.sort(np.concatenate(names)) if names else np.zeros(0, np.uint64)
    row, place, key = s.prefixes()
    if len(names):
        hit = names[np.minimum(np.searchsorted(names, key), len(names) - 1)] == key
    else:
        hit = np.zeros(len(key), bool)
    _, lead = np.unique(s.whole, return_index=True)
    leads = np.zeros(n, bool)
    leads[lead] = True
    hit &= leads[row] if len(row) else False
    row, place, key = row[hit], place[hit], key[hit]
    counts = np.bincount(row, minlength=n)
    tokens = pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array(place, pa.int32())], ["token", "pos"])
    shared = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), tokens)
    cells = []
    cell = (s.key & np.uint64(CELLS - 1)).astype(np.int64)
    for i in range(n):
        if counts[i]:
            a, b = s.first[i], s.first[i + 1]
            cells.append(np.minimum(np.bincount(cell[a:b], minlength=CELLS), 255).astype(np.uint8).tobytes())
        else:
            cells.append(None)
    return pa.table([ids, docs.column("text_hash"), pa.array(s.size, pa.int64()), pa.array(s.group.view(np.int64)), pa.array(s.whole.view(np.int64)), shared, pa.array(cells, pa.binary())], ["doc_id", "text_hash", "n_shingles", "grp", "whole", "shared", "cells"])


def _enough(a: F.Column, b: F.Column, most: F.Column) -> F.Column:
    """Whether an intersection of ``most`` links sets of sizes a and b: 100 * i >= SIMILAR * (a + b - i)."""
    return (100 + SIMILAR) * most >= SIMILAR * (a + b)


def _bounded(batches):
    """Pairs that the counts by cell leave possible."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int64) for c in ("cells_a", "cells_b"))
        full = (x == 255) & (y == 255)  # the counts end there, the cells may not
        most = np.where(full, 1 << 40, np.minimum(x, y)).sum(1)
        n = np.asarray(batch.column("n_a")) + np.asarray(batch.column("n_b"))
        yield batch.filter(pa.array((100 + SIMILAR) * most >= SIMILAR * n)).select(["a", "b"])


def _verified(batches):
    """Pairs that link, from both sets."""
    for batch in batches:
        out = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("items_a"), batch.column("items_b"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            out[i] = (100 + SIMILAR) * same >= SIMILAR * (len(x) + len(y))
        yield batch.filter(pa.array(out)).select(["a", "b"])


def _sets(batches):
    for batch in batches:
        for piece in X.pieces(batch):
            s = Sets(*X.utf8(piece.column("text")), np.zeros(0, np.uint32))
            items = [s.key[a:b].tobytes() for a, b in zip(s.first[:-1], s.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("cid"), pa.array(items, pa.binary())], ["cid", "items"])


def _side(classes: DataFrame, x: str, *columns: str) -> DataFrame:
    return classes.select(F.col("cid").alias(x), *(F.col(c).alias(f"{'n' if c == 'n_shingles' else c}_{x}") for c in columns))


def _told(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def bounded(pairs: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """The distinct pairs (a, b) of classes that may link, by their counts by cell."""
    near = _told(pairs).join(_side(classes, "a", "n_shingles", "cells"), "a").join(_side(classes, "b", "n_shingles", "cells"), "b")
    near = store.written(near.mapInArrow(_bounded, "a bigint, b bigint"), f"{name}-near")
    store.release(classes.sparkSession)
    return near


def verified(near: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The pairs that link, by their sets; of the others' sets few are shuffled."""
    sets = sifted(sets, near.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), ["cid"], ["cid"])
    both = near.join(_side(sets, "a", "items"), "a").join(_side(sets, "b", "items"), "b").select("a", "b", "items_a", "items_b")
    found = store.written(both.mapInArrow(_verified, "a bigint, b bigint"), f"{name}-links")
    store.release(sets.sparkSession)
    return found


def _fit(n1, n2) -> F.Column:
    return _enough(F.col(n1), F.col(n2), F.least(n1, n2))


def _placed(n1, p1, n2, p2) -> F.Column:
    """Whether enough can follow if this shingle is the first that both have."""
    return _enough(F.col(n1), F.col(n2), F.least(F.col(n1) - F.col(p1), F.col(n2) - F.col(p2)))


def members(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """MEMBERS with cid, the name of its class, written to the shared folder."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    slices, groups = max(1, -(-total // SLICE)), max(1, -(-total // NAMES))
    # By id, text and place in the input, so that neither an id nor a text with many rows fills a slice.
    own = F.pmod(F.xxhash64(F.col(key), F.col(text), F.spark_partition_id()), F.lit(slices))
    rows = docs.select(own.alias("slice"), F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    seen = rows.groupBy("slice").applyInArrow(lambda t: _seen(t, groups), "grp bigint, slice bigint, prints binary, often binary")
    often = seen.groupBy("grp").applyInArrow(_frequent, "slice bigint, often binary")
    asked = rows.groupBy("slice").cogroup(often.groupBy("slice")).applyInArrow(lambda a, b: _ask(a, b, groups), "grp bigint, slice bigint, names binary, often binary")
    answers = asked.groupBy("grp").applyInArrow(_answer, "slice bigint, names binary")
    told = often.withColumn("names", F.lit(None).cast("binary")).unionByName(answers.withColumn("often", F.lit(None).cast("binary")))
    out = rows.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(_members, MEMBERS)
    out = store.written(out.withColumn("cid", F.when(F.col("n_shingles") > 0, F.xxhash64("grp", "whole", "n_shingles"))), "members")
    store.release(docs.sparkSession)
    return out


def _common() -> F.Column:
    """Share of a class's prefix that others have: a copy with few changes has a large one."""
    n = F.col("n_shingles")
    return F.size("shared") / (n - F.ceil(n * SIMILAR / 100) + 1)


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))


def _starred(slots: DataFrame) -> DataFrame:
    """Pairs (a, b) of each b with those leaders of its shingles that it shares most with. slots: also l, the leader's lead, n and pos."""
    stars = slots.select("lead", "n", "pos", F.col("l.lead").alias("a"), F.col("l.n").alias("n_a"), F.col("l.pos").alias("p_a"))
    stars = stars.where(_fit("n", "n_a") & _placed("n", "pos", "n_a", "p_a")).where("a <> lead").groupBy(F.col("lead").alias("b"), "a").agg(F.count("*").alias("n"))
    stars = stars.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "a"))), 1, LEADERS).alias("s"))
    return stars.select(F.explode("s.a").alias("a"), "b")


def _parts(posted: DataFrame, classes: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts of groups by component: (cid, lead) of their classes, and what shingles and groups hold of several components.

    A part is named by its least class, ``lead``. The second table has a row for
    each shingle and part: (token, pos, lead, n, comp), with ``main``, the
    shingle's largest component, and ``share`` of its pairs between components.
    """
    named = store.written(classes.select("grp", "cid", F.col("n_shingles").alias("n"), _common().alias("common")).join(comps.withColumnRenamed("u", "cid"), "cid", "left").select("grp", "cid", "n", "common", F.coalesce("m", "cid").alias("comp")), "named")
    parts = store.written(named.groupBy("grp", "comp").agg(F.min("cid").alias("lead"), F.first("n").alias("n"), F.max("common").alias("common"), F.count("*").alias("k")), "parts")
    by_token = posted.select("token", "pos", "grp").join(parts, "grp").select("token", "pos", "lead", "n", "common", "comp", "k")
    by_group = parts.select(F.xxhash64(F.lit("group"), "grp").alias("token"), F.lit(0).alias("pos"), "lead", "n", "common", "comp", "k")
    slots = by_token.unionByName(by_group)
    k = F.col("k").cast("double")
    per = slots.groupBy("token", "comp").agg(F.sum(k).alias("k"), F.count("*").alias("slots")).groupBy("token")
    per = per.agg(F.max(F.struct("k", "comp"))["comp"].alias("main"), F.count("*").alias("kinds"), ((F.sum("k") * F.sum("k") - F.sum(k * k)) / 2 / F.sum("slots")).alias("share")).where("kinds > 1").drop("kinds")
    slots = store.written(slots.drop("k").join(per, "token"), "slots")
    store.release(classes.sparkSession)
    return named.select("cid", "grp", "comp").join(parts.select("grp", "comp", "lead"), ["grp", "comp"]).select("cid", "lead"), slots


def _rest(slots: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of classes of different components that share a prefix shingle or a group, and fit.

    Pairs of parts are filtered and made distinct before they are expanded. The
    largest component of each shingle is paired with the others, not with itself.
    """
    left = slots.where("comp <> main").select("token", F.col("lead").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("p_a"), F.col("comp").alias("c_a"))
    right = slots.select("token", F.col("lead").alias("b"), "n", "pos", "comp", "main")
    other = (F.col("c_a") < F.col("comp")) | (F.col("comp") == F.col("main")) & (F.col("c_a") != F.col("comp"))
    pairs = _told(left.join(right, "token").where(other & _fit("n", "n_a") & _placed("n", "pos", "n_a", "p_a")))
    first = pairs.join(members.select(F.col("lead").alias("a"), F.col("cid").alias("x")), "a")
    return first.join(members.select(F.col("lead").alias("b"), F.col("cid").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))


def connected(posted: DataFrame, classes: DataFrame, comps: DataFrame, judge) -> tuple[DataFrame, list[DataFrame]]:
    """comps (u, m) with every link between components that ``judge`` finds merged, and the tables of links that it found."""
    found, before = [], None
    while True:
        members, slots = _parts(posted, classes, comps)
        rows, left = slots.agg(F.count("*"), F.sum("share")).first()
        if not rows:
            return comps, found
        last = left <= LITTLE * rows or before is not None and left > before / 2
        if last:
            pairs = _rest(slots, members)
        else:
            # The least of exponential variates whose rates grow with ``common``: a draw that prefers large ones.
            even = (F.pmod(F.xxhash64(F.lit(len(found)), "lead"), F.lit(1 << 30)) + 1) / float(1 << 30)
            turn = F.struct(-F.log(even) / F.pow("common", F.lit(8.0)), "lead")
            leaders = slots.where("comp = main").groupBy("token").agg(F.min_by(F.struct("lead", "n", "pos"), turn).alias("l"))
            pairs = _starred(slots.where("comp <> main").join(leaders, "token"))
        links = judge(pairs)
        some = links.limit(1).count()
        if some:
            found.append(links)
            comps = components.components(comps.select("u", F.col("m").alias("v")).unionByName(_edges(links)))
        if last:
            return comps, found
        before = left


def sifted(rows: DataFrame, wanted: DataFrame, mine: list[str], theirs: list[str]) -> DataFrame:
    """rows without most of those whose columns ``mine`` equal no row's ``theirs`` in wanted; none that do is lost.

    A bit for each hash of wanted goes to all tasks, so that a join that follows
    shuffles few others. Beyond TABLES the bits fill up and more rows pass.
    """
    tables = min(TABLES, max(1, -(-wanted.count() * BITS // TABLE)))
    at = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(tables * TABLE))
    there = wanted.select(at(theirs).alias("at")).groupBy(F.floor(F.col("at") / TABLE).alias("__quire_table")).agg(F.bitmap_construct_agg(F.col("at") % TABLE).alias("__quire_bits"))
    own = rows.withColumn("__quire_at", at(mine)).withColumn("__quire_table", F.floor(F.col("__quire_at") / TABLE))
    own = own.join(F.broadcast(there), "__quire_table").withColumn("__quire_at", F.col("__quire_at") % TABLE)
    byte = F.conv(F.hex(F.substring("__quire_bits", F.floor(F.col("__quire_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return own.where(F.getbit(byte, (F.col("__quire_at") % 8).cast("int")) == 1).select(*(F.col(f"`{c}`") for c in rows.columns))


def links(docs: DataFrame, rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of classes as (u, m), from ``members`` and the documents."""
    shared = rows.where(F.col("cells").isNotNull())
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("lead")
    classes = store.written(shared.groupBy("cid").agg(F.first("grp").alias("grp"), F.first("n_shingles").alias("n_shingles"), F.first("cells").alias("cells"), F.first("shared").alias("shared"), lead), "classes")
    groups = classes.groupBy("grp").agg(F.min("cid").alias("lead"), F.first("n_shingles").alias("n"), F.first(_common()).alias("common"), F.first("shared").alias("shared"))
    posted = groups.select("grp", "lead", "n", "common", F.explode("shared").alias("t")).select(F.col("t.token").alias("token"), F.col("t.pos").alias("pos"), "grp", "lead", "n", "common")
    # Shingles of one group tell no groups apart, and its classes meet by the group: they aren't posted.
    least = posted.groupBy("token").agg(F.max(F.struct("common", "lead", "n", "pos")).alias("l"), F.count("*").alias("k")).where("k > 1").select("token", F.col("l").dropFields("common").alias("l"))
    posted = store.written(posted.join(least, "token"), "postings")
    store.release(docs.sparkSession)
    # Of the leaders of its shingles each group meets those that it shares most with, each class the least of its group.
    inner = classes.select("grp", F.col("cid").alias("b")).join(groups.select("grp", F.col("lead").alias("a")), "grp").select("a", "b")
    first = bounded(_starred(posted).unionByName(inner), classes, "first")
    _, more = connected(posted, classes, components.components(_edges(first)), lambda pairs: bounded(pairs, classes, "more"))
    # What may link between the components of these pairs is among them; sets are made for their classes only.
    near = first
    for m in more:
        near = near.unionByName(m)
    wanted = near.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes.select("cid", "lead"), "cid")
    wanted = store.written(wanted.select("cid", F.col("lead.doc_id").alias("__quire_id"), F.col("lead.text_hash").alias("__quire_hash")), "wanted")
    store.release(docs.sparkSession)
    # One of equal rows, by the columns of the join and none that may be null: both are one shuffle of the texts.
    told = lambda i, h: [F.coalesce(i, F.lit(0)).alias("id"), i.isNull().alias("none"), h.alias("hash")]
    texts = docs.select(*told(F.col(key).cast("long"), F.xxhash64(F.col(text))), F.col(text).alias("text"))
    wanted = wanted.select(*told(F.col("__quire_id"), F.col("__quire_hash")), "cid")
    own = ["id", "none", "hash"]
    texts = sifted(texts, wanted, own, own).dropDuplicates(own).join(wanted, own).select("cid", "text")
    sets = store.written(texts.mapInArrow(_sets, "cid bigint, items binary"), "sets")
    store.release(docs.sparkSession)
    fresh = lambda pairs: _told(pairs).join(near, ["a", "b"], "left_anti")
    judge = lambda pairs: verified(bounded(fresh(pairs), classes, "second"), sets, "second")
    return connected(posted, classes, components.components(_edges(verified(near, sets, "first"))), judge)[0]


def _classes(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``members``, and (cid, comp): the component of every class."""
    rows = members(docs, key, text)
    comps = links(docs, rows, key, text)
    per = rows.where(F.col("cid").isNotNull()).select("cid").distinct()
    return rows, per.join(comps.withColumnRenamed("u", "cid"), "cid", "left").select("cid", F.coalesce("m", "cid").alias("comp"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, cid, component_id) of every row: its class and the least id that is reachable by links."""
    rows, per = _classes(docs, key, text)
    lows = rows.where(F.col("cid").isNotNull()).groupBy("cid").agg(F.min("doc_id").alias("low"))
    per = lows.join(per, "cid")
    per = store.written(per.join(per.groupBy("comp").agg(F.min("low").alias("component_id")), "comp").select("cid", "component_id"), "class-components")
    out = rows.select("doc_id", "n_shingles", "cid").join(per, "cid", "left")
    return out.select("doc_id", "n_shingles", "cid", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without near duplicates: of each component the one with the least id stays.

    Ids may repeat: a row is told by its id and its text, and of rows that agree
    in both one stays. Rows without words are no copies of each other and stay.
    """
    rows, per = _classes(docs, key, text)
    best = rows.where(F.col("cid").isNotNull()).groupBy("cid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("b"))
    stay = best.join(per, "cid").groupBy("comp").agg(F.min("b").alias("b")).select(F.col("b.doc_id").alias("__quire_id"), F.col("b.text_hash").alias("__quire_hash"))
    stay = store.written(stay, "stay")
    store.release(docs.sparkSession)
    has = F.coalesce(F.col(text).rlike("[^ \\t\\n\\x0B\\f\\r]"), F.lit(False))
    told = docs.withColumn("__quire_text", F.xxhash64(F.col(text)))
    kept = told.where(has).join(stay, F.col(key).cast("long").eqNullSafe(F.col("__quire_id")) & (F.col("__quire_text") == F.col("__quire_hash")), "left_semi")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return kept.dropDuplicates([key, "__quire_text"]).select(*names).unionByName(docs.where(~has))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


#: {docs}: the relation that is joined.
COMPONENT_SQL = r"""
words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM {docs}),
sets AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i+4] END AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(len(ws) - 4, 1) END)) AS i FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
meets AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM meets JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * same >= 75 * (x.n + y.n - same)),
both_ways AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
joined AS (SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, r.component_id FROM words w LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id))
"""

OP3_SQL = "WITH RECURSIVE " + COMPONENT_SQL.format(docs="documents") + "SELECT doc_id, n_shingles, component_id FROM joined"
