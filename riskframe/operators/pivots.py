"""Exact k-nearest neighbours over many columns by a pivot index.

A bounded sample of the locations is cut into leaves of about BLOCK each:
where values leave a wide gap, as between the levels of a one-hot column, else
in the middle of the widest column.  Every location goes down these cuts to its
leaf.  A leaf keeps the least and greatest value of its locations in each
column, and the least and greatest of their distances from each of a few pivots:
a location is at least as far from the leaf's locations as from that box, and,
by the triangle inequality, as its distance from a pivot lies outside the leaf's.
Leaves that follow each other in the cuts' order are one block, a large leaf is
dealt over several; a block never holds much over MOST_BLOCK locations.

A task cuts its block into small leaves in the same way and finds each location's
nearest there, from the nearest leaf outwards.  Their last distance is the
location's bound: it travels, once, to each other block with a leaf that neither
box nor pivots rule out within that bound.  A neighbour within the bound lies in
a block that is asked, so the result is exact.  What is shuffled follows the
blocks that a location's own bound reaches, not leaves and not pairs of blocks.
Equal points are one location that carries its k + 1 smallest ids.

Defined results: rows with a null feature take no part; equal points are
neighbours at distance 0; ties go to the smaller id; fewer than k other points
give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, through_files
from .running import top_k_per_group

SAMPLE = 2048        # locations on the driver, at least: cuts and pivots come from them
MOST_SAMPLE = 1 << 16
PER_LEAF = 24        # locations of the sample for a leaf, as far as MOST_SAMPLE goes
PIVOTS = 8
BLOCK = 2048         # locations of a leaf, about
MOST_BLOCK = 1 << 16  # locations of a block, about: what a task holds
TASKS = 4            # blocks a core, as far as a block holds a leaf
INNER = 512          # locations of a leaf within a block, at most
CHUNK = 1 << 17      # locations that ask a block in one task, about
GAP = 0.25           # of a column's range: a gap this wide is worth a cut
SLACK = 1e-9         # of a distance, for rounding in the bounds
ROUGH = 1 << 21      # pairs compared at a time
PACK = 4096          # locations in a row of asks

FOUND = "q_loc long, p_loc long, distance double"
BLOCKS = "leaf int, locs binary, at binary"
ASKS = "leaf int, q_locs binary, q_at binary, q_bound binary, found_q binary, found_p binary, found_d binary, found_open binary"


def exact_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of each row of x from the same row of y, summed in the columns' order."""
    total = np.zeros(len(x))
    for f in range(x.shape[1]):
        total += (x[:, f] - y[:, f]) ** 2
    return np.sqrt(total)


def rough_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances between rows of x and of y by one product, and far from exact near 0."""
    sq = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
    return np.sqrt(np.maximum(sq, 0.0))


def rounding(x: np.ndarray, y: np.ndarray) -> float:
    """A bound of what ``rough_distances`` may be off by."""
    most = max(float((x * x).sum(1).max(initial=0.0)), float((y * y).sum(1).max(initial=0.0)))
    return float(np.sqrt(most * 4e-16 * (x.shape[1] + 8)))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows far from each other: each next one has the greatest distance from those chosen."""
    chosen, away = [0], rough_distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, rough_distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.column_stack([batch.column(f"f{i}").to_numpy(zero_copy_only=False) for i in range(d)]).astype(np.float64)


def _cut(sample: np.ndarray) -> tuple[int, float] | None:
    """Column and value of a cut in two: in the best balanced wide gap, else in the middle of the widest column."""
    best, top = None, 0.0
    low, high = sample.min(axis=0), sample.max(axis=0)
    for f in np.nonzero(high > low)[0]:
        v = np.sort(sample[:, f])
        gaps = np.diff(v)
        fit = np.nonzero(gaps >= GAP * (v[-1] - v[0]))[0]
        worth = gaps[fit] * np.minimum(fit + 1, len(v) - fit - 1)
        if len(fit) and worth.max() > top:
            at = fit[worth.argmax()]
            best, top = (int(f), float(v[at])), worth.max()
    if best is None and (high > low).any():
        f = int((high - low).argmax())
        middle = np.partition(sample[:, f], (len(sample) - 1) // 2)[(len(sample) - 1) // 2]
        if middle == high[f]:                            # more than half at the greatest value
            middle = sample[sample[:, f] < high[f], f].max()
        best = f, float(middle)
    return best


def grow(sample: np.ndarray, least: int) -> list[tuple[int, float, int, int]]:
    """Cuts (column, value, node at or below it, node above it) until a node holds at most ``least`` of the sample.

    A node below zero is a leaf: -1 is leaf 0, and so on."""
    nodes, leaves, todo = [], 0, [(np.arange(len(sample)), None, 0)]
    while todo:
        rows, parent, side = todo.pop()
        cut = _cut(sample[rows]) if len(rows) > least else None
        if cut is None:
            leaves, me = leaves + 1, -1 - leaves
        else:
            me = len(nodes)
            nodes.append([*cut, None, None])
            below = sample[rows, cut[0]] <= cut[1]
            todo += [(rows[below], me, 2), (rows[~below], me, 3)]
        if parent is not None:
            nodes[parent][side] = me
    return [tuple(n) for n in nodes]


def leaf_of(nodes: list[tuple[int, float, int, int]], x: np.ndarray) -> np.ndarray:
    """The leaf of each row of x."""
    out, todo = np.zeros(len(x), np.int32), [(0 if nodes else -1, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if node < 0:
            out[rows] = -1 - node
            continue
        f, value, low, high = nodes[node]
        below = x[rows, f] <= value
        todo += [(low, rows[below]), (high, rows[~below])]
    return out


def pivot_distances(pivots: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.column_stack([exact_distances(x, np.broadcast_to(p, x.shape)) for p in pivots])


def _place(nodes: list, d: int):
    """The leaf of each location."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(leaf_of(nodes, _matrix(batch, d))), *batch.columns], names=["leaf", *batch.schema.names])
    return run


def _extent(pivots: np.ndarray, d: int):
    """Least and greatest of each column and pivot distance by leaf, of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, d)
            x = np.column_stack([x, pivot_distances(pivots, x)])
            leaf = batch.column("leaf").to_numpy(zero_copy_only=False)
            order = np.argsort(leaf, kind="stable")
            leaf, x = leaf[order], x[order]
            starts = np.nonzero(np.diff(leaf, prepend=-1))[0]
            if len(starts):
                n = np.diff(starts, append=len(leaf))
                low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
                yield pa.RecordBatch.from_arrays([pa.array(leaf[starts]), pa.array(n), *map(pa.array, low.T), *map(pa.array, high.T)],
                                                 names=["leaf", "n", *[f"low{i}" for i in range(low.shape[1])], *[f"high{i}" for i in range(low.shape[1])]])
    return run


def _near_pairs(x: np.ndarray, bound: np.ndarray, y: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of x, row of y and distance of the pairs within ``bound`` that can be among a row's ``want`` nearest."""
    out, step, off = [], max(1, ROUGH // max(1, len(y))), rounding(x, y)
    y_sq = (y * y).sum(1)
    for at in range(0, len(x), step):
        part, most = x[at:at + step], bound[at:at + step]
        sq = (part * part).sum(1)[:, None] + y_sq[None, :] - 2.0 * (part @ y.T)
        hit = sq <= ((most * (1 + SLACK) + 2 * off) ** 2)[:, None]
        many = np.nonzero(hit.sum(axis=1) > 4 * want)[0]
        if len(many):                                    # the want-th of these is a bound as well
            last = np.sqrt(np.maximum(np.partition(sq[many], want - 1, axis=1)[:, want - 1], 0.0)) + off
            hit[many] &= sq[many] <= ((last * (1 + SLACK) + 2 * off) ** 2)[:, None]
        row, col = np.nonzero(hit)
        away = np.zeros(len(row))
        for f in range(x.shape[1]):
            away += (part[row, f] - y[col, f]) ** 2
        out.append((row + at, col, np.sqrt(away)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _keep_nearest(ids: np.ndarray, away: np.ndarray, row: np.ndarray, new_ids: np.ndarray, new_away: np.ndarray) -> None:
    """Add pairs to each row's nearest (``ids``, ``away``; nothing yet: inf), ties by id."""
    want, rows = ids.shape[1], np.unique(row)
    row = np.concatenate([np.repeat(rows, want), row])
    new_ids, new_away = np.concatenate([ids[rows].ravel(), new_ids]), np.concatenate([away[rows].ravel(), new_away])
    order = np.lexsort((new_ids, new_away, row))
    row, new_ids, new_away = row[order], new_ids[order], new_away[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < want
    ids[row[keep], place[keep]], away[row[keep], place[keep]] = new_ids[keep], new_away[keep]


def _gaps(wide: np.ndarray, low: np.ndarray, high: np.ndarray, d: int) -> np.ndarray:
    """How far each row of ``wide`` is from each box at least."""
    total, most = np.zeros((len(wide), len(low))), np.zeros((len(wide), len(low)))
    for f in range(wide.shape[1]):
        off = np.maximum(np.maximum(low[:, f] - wide[:, f, None], wide[:, f, None] - high[:, f]), 0.0)
        if f < d:
            total += off * off
        else:
            np.maximum(most, off, out=most)
    return np.maximum(np.sqrt(total), most)


def _apart(wide: np.ndarray, low: np.ndarray, high: np.ndarray, d: int) -> np.ndarray:
    """How far the box of ``wide`` is from each box at least."""
    off = np.maximum(np.maximum(low - wide.max(axis=0), wide.min(axis=0) - high), 0.0)
    return np.maximum(np.sqrt((off[:, :d] ** 2).sum(axis=1)), off[:, d:].max(axis=1, initial=0.0))


def _runs(leaf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each leaf with its rows, bounded."""
    order = np.argsort(leaf, kind="stable")
    starts = np.nonzero(np.diff(leaf[order], prepend=-1))[0]
    for start, end in zip(starts, [*starts[1:], len(leaf)], strict=True):
        for at in range(start, end, 2 * INNER):
            yield int(leaf[order[at]]), order[at:min(at + 2 * INNER, end)]


class _Block:
    """The locations of a block in small leaves with their boxes."""

    def __init__(self, locs: np.ndarray, x: np.ndarray, pivots: np.ndarray):
        self.pivots, self.d, self.nodes = pivots, x.shape[1], grow(x, INNER)
        leaf = leaf_of(self.nodes, x)
        order = np.lexsort((locs, leaf))
        leaf, self.locs, self.x = leaf[order], locs[order], x[order]
        self.starts = np.nonzero(np.diff(leaf, prepend=-1))[0]
        self.ends = np.append(self.starts[1:], len(leaf))
        wide = self.wide(self.x)
        self.low, self.high = np.minimum.reduceat(wide, self.starts), np.maximum.reduceat(wide, self.starts)

    def wide(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, pivot_distances(self.pivots, x)])

    def search(self, x: np.ndarray, bound: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the ``want`` nearest within ``bound`` of each row of x, ties by id (nothing: inf)."""
        ids, away = np.full((len(x), want), -1, np.int64), np.full((len(x), want), np.inf)
        for leaf, rows in _runs(leaf_of(self.nodes, x)):
            q, wide, most = x[rows], self.wide(x[rows]), bound[rows]
            room = SLACK * max(np.abs(wide).max(), 1.0)
            some_ids, some_away = ids[rows], away[rows]
            apart = _apart(wide, self.low, self.high, self.d)
            apart[leaf] = -1.0                           # the leaf they fall in comes first
            near = np.nonzero(apart <= most.max() * (1 + SLACK) + room)[0]
            near = near[np.argsort(apart[near], kind="stable")]
            gaps = _gaps(wide, self.low[near], self.high[near], self.d)
            for i, other in enumerate(near):
                most = np.minimum(bound[rows], some_away[:, -1])
                asks = np.nonzero(gaps[:, i] <= most * (1 + SLACK) + room)[0]
                if len(asks):
                    here = slice(self.starts[other], self.ends[other])
                    row, col, dist = _near_pairs(q[asks], most[asks], self.x[here], want)
                    if len(row):
                        _keep_nearest(some_ids, some_away, asks[row], self.locs[here][col], dist)
            ids[rows], away[rows] = some_ids, some_away
        return ids, away


def _ask(few: np.ndarray, pivots: np.ndarray, leaves: np.ndarray, low: np.ndarray, high: np.ndarray, want: int, d: int):
    """Per block: what its locations find in it, as FOUND in binary, and who asks which other block.

    ``leaves`` names the block of each box (``low``, ``high``); a block may have many."""
    def of_block(own: int, locs: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        bound = np.full(len(x), np.inf)
        if len(x) < want <= len(few):                    # the sample is of locations too: a first bound
            bound = np.partition(rough_distances(x, few), want - 1, axis=1)[:, want - 1] * (1 + SLACK) + rounding(x, few)
        block = _Block(locs, x, pivots)
        locs, x, bound = block.locs, block.x, bound[np.argsort(locs)][np.searchsorted(np.sort(locs), block.locs)]
        ids, away = block.search(x, bound, want)
        bound = np.minimum(bound, away[:, -1])
        # blocks by their leaves' boxes and a run's, then by each location
        others, asks = np.nonzero(leaves != own)[0], [np.empty((0, 2), np.int64)]
        for _, rows in _runs(leaf_of(block.nodes, x)):
            wide = block.wide(x[rows])
            reach = bound[rows] * (1 + SLACK) + SLACK * max(np.abs(wide).max(), 1.0)
            near = others[_apart(wide, low[others], high[others], d) <= reach.max()]
            row, col = np.nonzero(_gaps(wide, low[near], high[near], d) <= reach[:, None])
            asks.append(np.unique(np.column_stack([leaves[near[col]], rows[row]]), axis=0))
        asks = np.concatenate(asks)
        asks = asks[np.lexsort((asks[:, 1], asks[:, 0]))]
        is_open = np.zeros(len(x), bool)
        is_open[asks[:, 1]] = True
        row, col = np.nonzero(np.isfinite(away))
        found = (locs[row], ids[row, col], away[row, col], is_open[row])
        out = [(None, None, None, None, *(v.astype(t).tobytes() for v, t in zip(found, ("<i8", "<i8", "<f8", "?"), strict=True)))]
        for to in np.unique(asks[:, 0]):
            rows = asks[asks[:, 0] == to, 1]
            for r in np.split(rows, range(PACK, len(rows), PACK)):
                out.append((int(to), locs[r].astype("<i8").tobytes(), x[r].astype("<f8").tobytes(), bound[r].astype("<f8").tobytes(), None, None, None, None))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 7), strict=True)],
                                          names=[c.split()[0] for c in ASKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                leaf, locs, at = (batch.column(c)[i].as_py() for c in ("leaf", "locs", "at"))
                yield of_block(leaf, np.frombuffer(locs, "<i8"), np.frombuffer(at, "<f8").reshape(-1, d))
    return run


def _points(group: pa.Table, loc: str, d: int) -> tuple[np.ndarray, np.ndarray]:
    return group.column(loc).to_numpy(), np.column_stack([group.column(f"f{i}").to_numpy() for i in range(d)])


def _asks_of(ask, d: int):
    """The asks of a block, packed as one row."""
    def run(key: tuple, group: pa.Table) -> pa.Table:
        locs, x = _points(group, "p_loc", d)
        block = pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([locs.astype("<i8").tobytes()], pa.binary()),
                                            pa.array([x.astype("<f8").tobytes()], pa.binary())], names=[c.split()[0] for c in BLOCKS.split(", ")])
        return pa.Table.from_batches(ask(iter([block])))
    return run


def _unpack():
    """FOUND from its binary columns, and whether the location asks further."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, p, away, more = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("found_q", "<i8"), ("found_p", "<i8"), ("found_d", "<f8"), ("found_open", "?")))
                for at in range(0, len(q), ROUGH >> 4):
                    part = slice(at, at + (ROUGH >> 4))
                    yield pa.RecordBatch.from_arrays([pa.array(v[part]) for v in (q, p, away, more)], names=["q_loc", "p_loc", "distance", "open"])
    return run


def _askers(d: int):
    """A row each location that asks a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                locs, at, bound = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("q_locs", "<i8"), ("q_at", "<f8"), ("q_bound", "<f8")))
                block = np.full(len(locs), batch.column("leaf")[i].as_py(), np.int32)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (block, locs, bound)), *(pa.array(c) for c in at.reshape(-1, d).T.copy())],
                                                 names=["block", "q_loc", "q_bound", *[f"f{i}" for i in range(d)]])
    return run


def _compare(pivots: np.ndarray, want: int, d: int):
    """What the locations that ask a block find in it."""
    def run(asks: pa.Table, block: pa.Table) -> pa.Table:
        q_locs, x = _points(asks, "q_loc", d)
        ids, away = np.empty((0, want), np.int64), np.empty((0, want))
        if len(q_locs) and block.num_rows:
            ids, away = _Block(*_points(block, "p_loc", d), pivots).search(x, asks.column("q_bound").to_numpy(), want)
        row, col = np.nonzero(np.isfinite(away))
        return pa.table([pa.array(v) for v in (q_locs[row], ids[row, col], away[row, col])], names=["q_loc", "p_loc", "distance"])
    return run


def into_blocks(sizes: np.ndarray, most: int) -> list[list[int]]:
    """The blocks of each leaf, from the leaves' sizes in their order: one, or several for a leaf beyond ``most``."""
    out, block, held = [], -1, most
    for n in sizes.tolist():
        parts = -(-n // most)
        if parts > 1 or held + n > most:
            block, held = block + 1, 0
        out.append(list(range(block, block + parts)))
        if parts > 1:
            block, held = block + parts - 1, most
        held += n
    return out


def locations(points: DataFrame, feats: list[str], k: int, id_col: str) -> tuple[DataFrame, DataFrame]:
    """The points (id, f0, f1, ...) and their distinct places (p_loc, the k + 1 smallest ids, f0, ...)."""
    at = [f"f{i}" for i in range(len(feats))]
    pts = points.select(F.col(id_col).alias("id"), *[F.col(f"`{f}`").cast("double").alias(c) for c, f in zip(at, feats, strict=True)])
    pts = through_files(pts.dropna(subset=["id", *at]), "knn-points")
    # a location keeps k + 1 ids at most: two rounds, so no task sees all copies of one
    members = top_k_per_group(pts, at, [F.col("id").asc()], k + 1, "id").drop("rank")
    return pts, through_files(members.groupBy(*at).agg(F.min("id").alias("p_loc"), F.sort_array(F.collect_list("id")).alias("ids")), "knn-locations")


def knn(points: DataFrame, feats: list[str], k: int = 5, id_col: str = "id", n_pivots: int = PIVOTS, block: int = BLOCK,
        sample: int = SAMPLE) -> DataFrame:
    """(id, rank, neighbor_id, distance): the k nearest other points, ties by neighbour id."""
    spark, d, at = points.sparkSession, len(feats), [f"f{i}" for i in range(len(feats))]
    pts, locs = locations(points, feats, k, id_col)
    n = locs.count()
    if not n:
        return spark.createDataFrame([], f"{id_col} long, rank int, neighbor_id long, distance double")
    want = min(k + 1, n)                                 # its own location is the first
    # a bounded sample by a digest of the place, the same in every run
    size = min(MOST_SAMPLE, max(sample, PER_LEAF * -(-n // block)))
    few = locs.select("p_loc", *at)
    if n > size:
        few = few.where(F.shiftrightunsigned(F.xxhash64(*at, "p_loc"), 1) < F.lit(int(size / n * 2.0 ** 63)))
    few = few.toPandas().sort_values("p_loc")[at].to_numpy(dtype=np.float64)
    near = few[::max(1, len(few) // sample)][:sample]
    pivots = choose_pivots(near, n_pivots) if len(few) else np.zeros((1, d))
    nodes = grow(few, max(8 if n > size else 1, block * len(few) // n))
    placed = locs.select("p_loc", *at).mapInArrow(_place(nodes, d), "leaf int, p_loc long, " + ", ".join(f"{c} double" for c in at))
    width = d + len(pivots)
    ends = [f"{e}{i}" for e in ("low", "high") for i in range(width)]
    extent = placed.mapInArrow(_extent(pivots, d), "leaf int, n long, " + ", ".join(f"{e} double" for e in ends))
    # a row a leaf: as many as the bounded sample gives at most
    heads = extent.groupBy("leaf").agg(F.sum("n").alias("n"), *[(F.min if e.startswith("low") else F.max)(e).alias(e) for e in ends]).toPandas().sort_values("leaf")
    low, high = heads[ends[:width]].to_numpy(dtype=np.float64), heads[ends[width:]].to_numpy(dtype=np.float64)
    most = min(max(MOST_BLOCK, block), max(block, n // (TASKS * spark.sparkContext.defaultParallelism)))
    blocks = into_blocks(heads["n"].to_numpy(), most)
    boxes = np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
    leaves, low, high = np.concatenate(blocks).astype(np.int32), low[boxes], high[boxes]
    parts = spark.createDataFrame(list(zip(heads["leaf"].tolist(), blocks, strict=True)), "leaf int, blocks array<int>")
    cut = placed.join(F.broadcast(parts), "leaf")
    cut = cut.select(F.get("blocks", F.pmod(F.xxhash64("p_loc"), F.size("blocks")).cast("int")).alias("block"), "p_loc", *at)
    own = through_files(cut.groupBy("block").applyInArrow(_asks_of(_ask(near, pivots, leaves, low, high, want, d), d), ASKS), "knn-asks")
    first = own.where("leaf is null").select("found_q", "found_p", "found_d", "found_open").mapInArrow(_unpack(), FOUND + ", open boolean")
    asks = own.where("leaf is not null").select("leaf", "q_locs", "q_at", "q_bound")
    # a row a block that is asked: many askers are dealt over several tasks, each with the block
    asked = asks.groupBy(F.col("leaf").alias("block")).agg(F.ceil(F.sum(F.length("q_locs") / 8) / CHUNK).cast("int").alias("chunks")).toPandas()
    asked = F.broadcast(spark.createDataFrame([(int(b), int(c)) for b, c in zip(asked["block"], asked["chunks"], strict=True)], "block int, chunks int"))
    asks = asks.mapInArrow(_askers(d), "block int, q_loc long, q_bound double, " + ", ".join(f"{c} double" for c in at)).join(asked, "block")
    asks = asks.select("block", F.pmod(F.xxhash64("q_loc"), "chunks").cast("int").alias("chunk"), "q_loc", "q_bound", *at)
    asked = cut.join(asked, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "p_loc", *at)
    found = asks.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(_compare(pivots, want, d), FOUND)
    w = Window.partitionBy("q_loc").orderBy("distance", "p_loc")
    best = first.where("open").drop("open").unionByName(found).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= want).drop("_r")
    best = first.where("not open").drop("open").unionByName(best)
    return of_points(pts, locs, through_files(best, "knn-found"), at, k, id_col)


def of_points(pts: DataFrame, locs: DataFrame, near: DataFrame, at: list[str], k: int, id_col: str) -> DataFrame:
    """From the nearest locations of each location to the nearest other points of each point."""
    near = near.join(locs.select("p_loc", "ids"), "p_loc").select("q_loc", "distance", F.explode("ids").alias("neighbor_id"))
    w = Window.partitionBy("q_loc").orderBy("distance", "neighbor_id")
    near = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1).drop("_r")
    own = pts.join(locs.select(*at, F.col("p_loc").alias("q_loc")), at).select("id", "q_loc")
    out = own.join(near, "q_loc").where(F.col("id") != F.col("neighbor_id"))
    w = Window.partitionBy("id").orderBy("distance", "neighbor_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("id").alias(id_col), "rank", "neighbor_id", "distance")
