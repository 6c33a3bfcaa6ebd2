"""Reading order of boxes on pages, by cuts through the widest free stretch, all pages and regions of a batch at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least free stretch across and down that cuts a region, how far below a heading its text may begin early, and depth of cuts.
MIN_ACROSS, MIN_DOWN, HEADING_SLACK, DEPTH = 8.0, 6.0, 4.0, 20
_EDGES = ("x0", "y0", "x1", "y1")


def _widest(low: np.ndarray, high: np.ndarray, body: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each region the widest free stretch between the body's intervals and its middle, the first of equal ones; zero without one."""
    order = np.lexsort((high, low, region))
    low, body, region = low[order], body[order], region[order]
    # the reach of the body before a box: places of a region's edges are above those of all regions before it; place 0 is no body
    known, at = np.unique(np.concatenate([[-np.inf], np.where(body, high[order], -np.inf)]), return_inverse=True)
    before = np.concatenate([[-1], np.maximum.accumulate(region * len(known) + at[1:])[:-1]]) - region * len(known)
    reach = np.where(before > 0, known[np.maximum(before, 0)], np.inf)
    free = body & (low > reach)
    gap, middle = np.zeros(len(low)), np.full(len(low), np.inf)
    gap[free], middle[free] = low[free] - reach[free], (low[free] + reach[free]) / 2
    starts = np.flatnonzero(np.diff(region, prepend=-1))
    most = np.maximum.reduceat(gap, starts)
    return most, np.minimum.reduceat(np.where(free & (gap == most[region]), middle, np.inf), starts)


def _below(e: dict[str, np.ndarray], heads: np.ndarray, body: np.ndarray, region: np.ndarray) -> np.ndarray:
    """For each heading the first body box of its region below it that shares some width, by y0 and y1; -1 without one."""
    body = body[np.lexsort((e["y1"][body], e["y0"][body], region[body]))]
    known = np.unique(e["y0"][body])
    key = region[body] * (len(known) + 1) + np.searchsorted(known, e["y0"][body])
    at = np.searchsorted(key, region[heads] * (len(known) + 1) + np.searchsorted(known, e["y1"][heads] - HEADING_SLACK))
    end = np.searchsorted(region[body], region[heads], side="right")
    found, left = np.full(len(heads), -1), np.flatnonzero(at < end)
    while len(left):
        b, h = body[at[left]], heads[left]
        meets = (e["x0"][b] < e["x1"][h]) & (e["x0"][h] < e["x1"][b])
        found[left[meets]] = b[meets]
        left = left[~meets]
        at[left] += 1
        left = left[at[left] < end[left]]
    return found


def _cuts(e: dict[str, np.ndarray], heading: np.ndarray, region: np.ndarray, across: float, down: float) -> tuple[np.ndarray, np.ndarray]:
    """Which boxes are in a region that is cut, and which of them come second; ``region`` is sorted and counts from 0."""
    plain = np.zeros(region[-1] + 1, dtype=bool)
    plain[region[~heading]] = True
    body = ~heading | ~plain[region]
    wide, at_x = _widest(e["x0"], e["x1"], body, region)
    tall, at_y = _widest(e["y0"], e["y1"], body, region)
    # headings alone are never cut downwards
    sideways = (wide > 0) & (wide >= across) & ((wide >= tall) | (tall < down) | ~plain)
    downwards = ~sideways & (tall > 0) & (tall >= down) & plain
    # a heading of a region that is cut downwards goes with the first body box below it
    lower = e["y1"].copy()
    heads = np.flatnonzero(heading & downwards[region])
    if len(heads):
        first = _below(e, heads, np.flatnonzero(~heading & downwards[region]), region)
        heads, first = heads[first >= 0], first[first >= 0]
        # by page and box, so rows that repeat a box go together
        order = np.lexsort((e["y1"][first], e["y0"][first], e["box"][heads]))
        told, at = np.unique(e["box"][heads[order]], return_index=True)
        same = np.isin(e["box"], told)
        lower[same] = e["y1"][first[order[at]]][np.searchsorted(told, e["box"][same])]
    second = np.where(sideways[region], e["x0"] >= at_x[region], lower > at_y[region])
    cut = (sideways | downwards)[region]
    return cut, second & cut


def _placed(e: dict[str, np.ndarray], heading: np.ndarray, page: np.ndarray, across: float, down: float, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the boxes of whole pages and the depth of their regions; pages are sorted, and boxes by y0, x0 and box within. ``e`` has the edges, and a number for each page and box."""
    region, cuts, now = page.copy(), np.zeros(len(page), dtype=np.int32), np.arange(len(page))
    for _ in range(depth + 1):
        now = now[np.argsort(region[now], kind="stable")]
        own = np.cumsum(np.diff(region[now], prepend=region[now[0]]) != 0)
        cut, second = _cuts({k: v[now] for k, v in e.items()}, heading[now], own, across, down)
        cuts[now] += cut
        sides = region * 2
        sides[now] += second
        region, now = np.unique(sides, return_inverse=True)[1], now[cut]
        if not len(now):
            break
    return np.argsort(region, kind="stable"), cuts


def _pages(across: float, down: float, depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def ordered(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        page = t.column(0).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        e = {k: t.column(k).to_numpy() for k in _EDGES}
        e = {k: np.where(np.isnan(v), np.inf, v) for k, v in e.items()}  # beyond all others, as Spark has it
        box = t.column(1).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        e["box"] = page * len(box) + box
        order, cuts = _placed(e, t.column("heading").to_numpy(), page, across, down, depth)
        starts = np.flatnonzero(np.diff(page, prepend=-1))
        place = np.arange(1, len(page) + 1) - starts[page]  # pages keep their place among the rows
        columns = [t.column(0).take(order), t.column(1).take(order), pa.array(place.astype(np.int32)), pa.array(cuts[order])]
        yield from pa.table(columns, names=[*t.column_names[:2], "place", "depth"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # rows of a page whose end has not been seen
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0)
            last = key.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            begins = int(np.searchsorted(last, last[-1]))  # where the batch's last page begins
            same = waiting and waiting[-1].column(0)[0] == key[0]
            if begins or (waiting and not same):
                whole = [*waiting, b.slice(0, begins)]
                yield from ordered(pa.Table.from_batches(whole))
                waiting = []
            waiting.append(b.slice(begins))
        if waiting:
            yield from ordered(pa.Table.from_batches(waiting))

    return run


def reading_order(boxes: DataFrame, page: str, across: float = MIN_ACROSS, down: float = MIN_DOWN, depth: int = DEPTH) -> DataFrame:
    """(page, box, place from 1, depth of its region) of boxes (page, box, x0, y0, x1, y1, heading).

    A region is cut where its body leaves the widest free stretch: left before right, or upper before lower. Headings
    do not count as body, as they span columns; they go by their left edge, or with the text below them. Boxes of an
    uncut region go by y0, x0 and box. Boxes are shuffled once, by page; a task holds the boxes of one page and of one batch.
    A page's boxes are few, pages are many.
    Boxes with a null edge or page are left out; a null heading is none; box identifies a row of a page.
    """
    known = boxes.filter(" and ".join(f"{c} is not null" for c in (page, "box", *_EDGES)))
    rows = known.select(page, "box", *[F.col(c).cast("double").alias(c) for c in _EDGES], F.coalesce("heading", F.lit(False)).alias("heading"))
    out = rows.select(page, "box", F.lit(0).alias("place"), F.lit(0).alias("depth")).schema
    dealt = rows.repartition(page).sortWithinPartitions(page, "y0", "x0", "box")
    return dealt.mapInArrow(_pages(across, down, depth), out)
