"""Rules that walk a page from start to end: one page's rows at a time, pages in parallel.

Each takes the rows of one page (a bounded group: page budgets hold before) as
arrays. Rows are dealt by page and sorted, and a task walks its pages one after
the other over Arrow batches, so that a page costs no frame of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import layout as L

# Fixed values of the rules.
DEPTH = 32
FIGURE_GAP, FIGURE_PATHS = 300, 3
UNIT_ONE_IN = 2
SCRIPT_CHARS = 6


def _bands(lo: np.ndarray, hi: np.ndarray, tie: np.ndarray, items: np.ndarray, gap: int, widest: bool) -> list[np.ndarray]:
    """Items cut along one axis at gaps of ``gap`` or more; with ``widest`` only at those that equal the largest."""
    order = items[np.lexsort((tie[items], hi[items], lo[items]))]
    free = lo[order][1:] - np.maximum.accumulate(hi[order])[:-1]
    at = gap
    if widest:
        if not len(free) or free.max() < gap:
            return [items]
        at = free.max()
    return [np.sort(part) for part in np.split(order, np.flatnonzero(free >= at) + 1)]


def _columns(b: dict[str, np.ndarray], parts: list[np.ndarray]) -> bool:
    span = [(b["y0"][p].min(), b["y1"][p].max()) for p in parts]
    if max(s[1] for s in span) <= min(s[0] for s in span):
        return False
    for (lt, lb), (rt, rb) in zip(span, span[1:]):
        over = min(lb, rb) - max(lt, rt)
        if over <= 0 or 2 * over < min(lb - lt, rb - rt):
            return False
    return True


def _starts(table: pa.Table, group: tuple[str, ...]) -> np.ndarray:
    """Rows at which another page begins; nulls are a page of their own, as in groupBy."""
    n = table.num_rows
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = False
        for c in group:
            x = table.column(c).combine_chunks()
            same = pc.fill_null(pc.equal(x[1:], x[:-1]), False)
            both = pc.and_(x[1:].is_null(), x[:-1].is_null())
            new[1:] |= ~pc.or_(same, both).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _walk(df: DataFrame, group: tuple[str, ...], order: str, needs: tuple[str, ...], more: dict[str, pa.DataType], rule: Callable[..., tuple]) -> DataFrame:
    """df with the columns ``more``: ``rule`` gives them for the ``needs`` of each page, whose rows are sorted by ``order``.

    A task holds one batch and the page that it ends in.
    """

    def told(table: pa.Table) -> Iterator[pa.RecordBatch]:
        starts = _starts(table, group)
        ends = np.append(starts[1:], table.num_rows)
        have = [table.column(c).to_numpy() if table.column(c).null_count == 0 else np.array(table.column(c).to_pylist(), object) for c in needs]
        parts = [rule(*(x[a:b] for x in have)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        for k, (name, kind) in enumerate(more.items()):
            whole = [p[k] for p in parts]
            table = table.append_column(name, pa.array(np.concatenate([x for x in whole]), kind, from_pandas=True))
        return table.to_batches()

    def pages(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # A page that goes on over many batches is looked at where it ends only.
            if held and _starts(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch]).select(list(group)), group).size == 1:
                held.append(batch)
                continue
            table = pa.Table.from_batches([*held, batch])
            last = int(_starts(table, group)[-1])
            if last:
                yield from told(table.slice(0, last))
            held = table.slice(last).to_batches()
        if held:
            yield from told(pa.Table.from_batches(held))

    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), *(f"`{n}` bigint" for n in more)])
    return df.repartition(*group).sortWithinPartitions(*group, F.asc_nulls_last(order)).mapInArrow(pages, schema)


def arrange(b: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Reading order of boxes (in the order that they were drawn) and the region of each; regions are 0 where no cut holds.

    Column cuts and cuts at the widest gap alternate. Cuts decide groups and
    the order of groups; within a group the drawn order stands.
    """
    n = len(b["x0"])
    tie = np.arange(n)
    region = np.zeros(n, np.int64)
    out: list[np.ndarray] = []
    opened = 0
    work: list[tuple[np.ndarray, int, bool, int]] = [(tie, 0, True, 0)]
    while work:
        items, depth, across, own = work.pop()
        parts = [items]
        if len(items) > 1 and depth < DEPTH:
            if across:
                parts = _bands(b["x0"], b["x1"], tie, items, L.COLUMN_GUTTER, False)
                if len(parts) > 1 and not _columns(b, parts):
                    parts = [items]
            else:
                parts = _bands(b["y0"], b["y1"], tie, items, L.BLOCK_GUTTER, True)
        if len(parts) < 2:
            region[items] = own
            out.append(items)
        elif across:
            nxt = [(p, depth + 1, False, opened + k + 1) for k, p in enumerate(parts)]
            opened += len(parts)
            work.extend(reversed(nxt))
        else:
            work.extend((p, depth + 1, True, own) for p in reversed(parts))
    order = np.concatenate(out) if out else tie
    _, first = np.unique(region[order], return_index=True)
    rank = {int(region[order][k]): i + 1 for i, k in enumerate(np.sort(first))}
    numbered = np.array([rank[int(r)] for r in region], np.int64) if len(rank) > 1 else np.zeros(n, np.int64)
    return order, numbered


def reading_order(runs: DataFrame, *group: str, order: str = "ord") -> DataFrame:
    """Runs with read (place in the reading order, from 0) and region (null where the page is one)."""

    def page(*box):
        seq, region = arrange({c: x.astype(np.int64) for c, x in zip(("x0", "y0", "x1", "y1"), box, strict=True)})
        return np.argsort(seq, kind="stable"), np.where(region == 0, np.nan, region)

    return _walk(runs, group, order, ("x0", "y0", "x1", "y1"), {"read": pa.int64(), "region": pa.int64()}, page)


def clusters(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, gap: int) -> np.ndarray:
    """Of each box the least index of those it hangs together with, over gaps of ``gap`` at most on both axes."""
    n = len(x0)
    label = np.arange(n)
    order = np.argsort(x0, kind="stable")
    for k, i in enumerate(order):
        reach = order[k + 1 :][: np.searchsorted(x0[order[k + 1 :]], x1[i] + gap, "right")]
        near = reach[(y0[reach] - y1[i] <= gap) & (y0[i] - y1[reach] <= gap)]
        if len(near):
            kin = np.unique(label[np.append(near, i)])
            label[np.isin(label, kin)] = kin[0]
    return label


def touching(boxes: DataFrame, *group: str, gap: int = FIGURE_GAP, item: str = "id") -> DataFrame:
    """Boxes with cluster: the least item of its connected boxes."""

    def page(name, *box):
        return (name[clusters(*(x.astype(np.int64) for x in box), gap)],)

    return _walk(boxes, group, item, (item, "x0", "y0", "x1", "y1"), {"cluster": pa.int64()}, page)


def figures(clustered: DataFrame, *group: str) -> DataFrame:
    """(group.., cluster, box, paths): clusters of three paths or more."""
    per = clustered.groupBy(*group, "cluster").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("paths"))
    return per.where(f"paths >= {FIGURE_PATHS}")


def _units(rows: Iterator[tuple]) -> list[int]:
    """Lines (x0, y0, x1, y1, heading, marker) to units, each compared with the unit's box so far."""
    out, box, level, n = [], None, None, -1
    for x0, y0, x1, y1, heading, marker in rows:
        height = y1 - y0
        joins = False
        if box is not None and level == heading and not marker:
            gap = y0 - box[3]
            overlap = min(box[2], x1) - max(box[0], x0)
            joins = UNIT_ONE_IN * gap <= height and 2 * gap >= -height and 2 * overlap >= min(box[2] - box[0], x1 - x0)
        if joins:
            box = (min(box[0], x0), min(box[1], y0), max(box[2], x1), max(box[3], y1))
        else:
            n, box, level = n + 1, (x0, y0, x1, y1), heading
        out.append(n)
    return out


def units(lines: DataFrame, *group: str, order: str = "ord") -> DataFrame:
    """Lines (box, heading, marker) with unit, numbered from 0 on each page."""

    def page(*lines):
        return (np.array(_units(zip(*(x.tolist() for x in lines), strict=True)), np.int64),)

    return _walk(lines, group, order, ("x0", "y0", "x1", "y1", "heading", "marker"), {"unit": pa.int64()}, page)
