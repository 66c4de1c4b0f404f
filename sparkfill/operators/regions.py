"""Exact nearest and farthest records (C6), each record sent once.

The categories, null columns and ``cl`` of a record are its kind; kinds are few and counted first. Candidates of one
kind make up a region, or several that are cut at medians of a sample. A region goes to one task, which keeps
it as a tree of small leaves, and queries are brought to it: first every query to the region that promises most, and then
only those to others whose own k-th value leaves them within reach. So what is shuffled is each candidate, and each
query about once, whatever the number of pairs; results are one row a query.

Farthest candidates lie on the outside (``knn.farthest_candidates``). They are picked where they are read, so only these are
shuffled, and every query meets those of its kind without a shuffle of its own. The few queries beyond the
candidates' range meet all candidates where these are read.

Both work for numbers without NaN or infinite values and up to ``knn.KINDS`` kinds; :func:`described` tells.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfill.operators import knn
from sparkfill.session import cut_lineage, written

#: Candidates of a region, about, sampled ones of them for the cuts, and queries of a task, about.
REGION, SAMPLE, QUERIES = 100_000, 256, 200_000
#: Candidates of a leaf, queries that go through the leaves together, leaves at a time, queries that are held at once, and pairs that are compared at once.
LEAF, GROUP, AHEAD, HELD, PAIRS = 64, 32, 64, 65_536, 1 << 16
#: Candidates on the outside at most, queries beyond the range at most, and rows that are read before they are picked.
FEW, OUTSIDE, PICK = 200_000, 2_000, 2_048
SLACK = 1e-9


@dataclass
class Layout:
    """Kinds of candidates and of queries, ranges and regions. Categories are numbers, -1 is null."""

    feats: list[str]
    num: list[str]
    k: int
    id_type: str
    value_type: str
    cl: np.ndarray
    nulls: np.ndarray
    cats: np.ndarray
    asked_cl: np.ndarray
    asked_nulls: np.ndarray
    asked_cats: np.ndarray
    asked_n: np.ndarray
    low: np.ndarray
    high: np.ndarray
    kind: np.ndarray
    n: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    memo: dict = field(default_factory=dict)

    @property
    def x(self) -> list[str]:
        """What the numbers are called in the tables of this module."""
        return [f"x{j}" for j in range(len(self.num))]

    def plan(self, a: int) -> list[tuple[bool, int]]:
        """The columns that queries of kind ``a`` have, in order: is it a number, and its place."""
        cat = [f for f in self.feats if f not in self.num]
        return [(f in self.num, (self.num if f in self.num else cat).index(f)) for i, f in enumerate(self.feats) if not int(self.asked_nulls[a]) >> i & 1]

    def meets(self, a: int) -> tuple[np.ndarray, np.ndarray]:
        """The regions that queries of kind ``a`` may meet, and the mismatches of their categories."""
        if a not in self.memo:
            full = (1 << len(self.feats)) - 1
            ok = (self.cl == self.asked_cl[a]) & ((self.nulls & (full ^ int(self.asked_nulls[a]))) == 0)
            own = [i for is_num, i in self.plan(a) if not is_num]
            apart = (self.cats[:, own] != self.asked_cats[a, own]).sum(axis=1)
            regions = np.flatnonzero(ok[self.kind])
            self.memo[a] = regions, apart[self.kind[regions]].astype(float)
        return self.memo[a]

    def widths(self, a: int, x: np.ndarray, j: int) -> np.ndarray:
        return np.fmax(self.high[a, j], x[:, j]) - np.fmin(self.low[a, j], x[:, j])

    def values(self, a: int, x: np.ndarray, y: np.ndarray, apart) -> np.ndarray:
        """Mean of scaled gaps and mismatches (S8) of each query (rows of ``x``) and candidate (columns of ``y``), in the order of the columns."""
        sums = np.zeros((len(x), y.shape[1]))
        plan = self.plan(a)
        for is_num, i in plan:
            if not is_num:
                sums += np.asarray(apart[i], float)
                continue
            r = self.widths(a, x, i)
            some = r > 0
            if some.any():
                t = y[i][None, :] - x[:, i][:, None]
                np.abs(t, out=t)
                t /= np.where(some, r, 1.0)[:, None]
                if not some.all():
                    t[~some] = 0.0
                sums += t
        sums /= max(len(plan), 1)
        return sums

    def paired(self, a: int, x: np.ndarray, y: np.ndarray, apart) -> np.ndarray:
        """As :meth:`values`, of each query and the candidate beside it."""
        sums, plan = np.zeros(len(x)), self.plan(a)
        for is_num, i in plan:
            if not is_num:
                sums += float(apart[i])
                continue
            r = self.widths(a, x, i)
            sums += np.where(r > 0, np.abs(y[i] - x[:, i]) / np.where(r > 0, r, 1.0), 0.0)
        return sums / max(len(plan), 1)

    def inside(self, a: int, x: np.ndarray) -> np.ndarray:
        """Which queries lie within the candidates' range."""
        ok = np.ones(len(x), bool)
        for is_num, j in self.plan(a):
            if is_num:
                ok &= (x[:, j] >= self.low[a, j]) & (x[:, j] <= self.high[a, j])
        return ok

    def least(self, a: int, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, apart) -> np.ndarray:
        """Sums below which no gap between a query and a box is."""
        out = np.zeros((len(x), len(lo))) + apart
        for is_num, j in self.plan(a):
            if is_num:
                r = self.widths(a, x, j)
                gap = np.maximum(np.maximum(lo[:, j][None, :] - x[:, j][:, None], x[:, j][:, None] - hi[:, j][None, :]), 0.0)
                out += gap * np.where(r > 0, 1 / np.where(r > 0, r, 1.0), 0.0)[:, None]
        return out

    def first(self, a: int) -> tuple[np.ndarray, np.ndarray]:
        """The regions among which a query of kind ``a`` starts: with the fewest mismatches that have ``k`` candidates."""
        regions, apart = self.meets(a)
        if not len(regions):
            return regions, apart
        order = np.argsort(apart, kind="stable")
        enough = np.searchsorted(np.cumsum(self.n[regions][order]), self.k)
        here = apart <= apart[order[min(enough, len(order) - 1)]]
        if (here & (self.n[regions] >= self.k)).any():
            here &= self.n[regions] >= self.k
        return regions[here], apart[here]

    def home(self, a: int, x: np.ndarray) -> np.ndarray | None:
        regions, apart = self.first(a)
        if len(regions) < 2:
            return np.full(len(x), regions[0]) if len(regions) else None
        lo, hi, out = self.lo[regions], self.hi[regions], []
        middle = (lo + hi) / 2
        for s in _slices(len(x), len(regions)):
            out.append(np.argmin(self.least(a, x[s], lo, hi, apart) + 1e-6 * self.least(a, x[s], middle, middle, 0.0), axis=1))
        return regions[np.concatenate(out)]

    def todo(self, a: int, x: np.ndarray, limit: np.ndarray, but: int) -> pa.ListArray:
        """The regions that each query may still find something in."""
        regions, apart = self.meets(a)
        reach = limit * max(len(self.plan(a)), 1) * (1 + SLACK) + 1e-12
        keep = (regions != but) & (apart <= reach.max())
        regions, apart = regions[keep], apart[keep]
        rows, found = [], []
        for s in _slices(len(x), len(regions)):
            r, c = np.nonzero(self.least(a, x[s], self.lo[regions], self.hi[regions], apart) * (1 - SLACK) <= reach[s][:, None])
            rows.append(r + s.start)
            found.append(regions[c])
        counts = np.bincount(np.concatenate(rows) if rows else [], minlength=len(x))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(np.concatenate(found) if found else [], pa.int32()))


def _slices(n: int, width: int) -> Iterator[slice]:
    step = max(1, PAIRS // max(width, 1))
    return (slice(s, min(s + step, n)) for s in range(0, n, step))


def _numbers(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    if not columns or not table.num_rows:
        return np.zeros((table.num_rows, len(columns)))
    return np.column_stack([table.column(c).to_numpy().astype(float) for c in columns])


def _first_k(values: np.ndarray, rank: np.ndarray, k: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, places and columns of the ``k`` least values of each row, those of equal value by ``rank``."""
    most = np.full(len(values), np.inf) if limit is None else limit
    if values.shape[1] > k:
        most = np.minimum(most, np.partition(values, k - 1, axis=1)[:, k - 1])
    r, c = np.nonzero(values <= most[:, None])
    order = np.lexsort((rank[c], values[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    keep = place < k
    return r[keep], place[keep], c[keep]


def _ranks(ids) -> np.ndarray:
    order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank


def _lists(found: np.ndarray, ids, values, v: np.ndarray) -> list[pa.Array]:
    """Lists of ids, values and distances; ``found`` has the rows of the candidates, -1 for none."""
    here = found >= 0
    offsets = pa.array(np.concatenate([[0], np.cumsum(here.sum(axis=1))]), pa.int32())
    at = pa.array(found[here])
    return [pa.ListArray.from_arrays(offsets, x) for x in (ids.take(at), values.take(at), pa.array(v[here]))]


class _Region:
    """The candidates of a region in leaves."""

    def __init__(self, layout: Layout, region: int, rows: pa.Table):
        self.layout, self.region, k = layout, region, layout.k
        ids, x = rows.column("id").combine_chunks(), np.nan_to_num(_numbers(rows, layout.x))
        rank = _ranks(ids)
        order = np.lexsort((rank, *x.T))
        new = np.concatenate([[True], (x[order[1:]] != x[order[:-1]]).any(axis=1)]) if len(order) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        keep = np.sort(order[np.arange(len(order)) - start[np.cumsum(new) - 1] < k])  # of equal ones the first k
        x, rank = x[keep], rank[keep]
        spread = np.ptp(x, axis=0) if len(x) else np.zeros(x.shape[1])
        whole = np.nanmax(layout.hi, axis=0, initial=-np.inf) - np.nanmin(layout.lo, axis=0, initial=np.inf)
        scale = np.where((spread > 0) & (whole > 0), 1 / np.where(whole > 0, whole, 1.0), 0.0)
        order, self.nodes = np.arange(len(x)), []
        leaves = -(-len(x) // LEAF)
        stack = [(0, max(leaves, 1), None)]
        while stack:
            a, b, parent = stack.pop()
            node = len(self.nodes)
            self.nodes.append([-1, 0.0, a, a])
            if parent is not None:
                self.nodes[parent[0]][parent[1]] = node
            if b - a < 2:
                continue
            s, e = a * LEAF, min(b * LEAF, len(x))
            own = x[order[s:e]]
            wide = np.ptp(own, axis=0) * scale
            j = int(np.argmax(wide))
            if wide[j] <= 0:
                continue
            mid = (a + b) // 2
            cut = mid * LEAF - s
            by = np.argpartition(own[:, j], cut)
            order[s:e] = order[s:e][by]
            self.nodes[node][:2] = [j, float(own[by[cut], j])]
            stack += [(a, mid, (node, 2)), (mid, b, (node, 3))]
        self.nodes = np.array(self.nodes, float)
        keep = pa.array(keep[order])
        self.ids, self.value = ids.take(keep), rows.column("value").combine_chunks().take(keep)
        self.x, self.y, self.rank = x[order], np.ascontiguousarray(x[order].T), rank[order]
        ends = np.arange(0, len(x), LEAF)
        self.lo = np.minimum.reduceat(self.x, ends, axis=0) if len(x) else np.zeros((0, x.shape[1]))
        self.hi = np.maximum.reduceat(self.x, ends, axis=0) if len(x) else np.zeros((0, x.shape[1]))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            dim = self.nodes[node, 0].astype(int)
            inner = np.flatnonzero(dim >= 0)
            if not len(inner):
                return self.nodes[node, 2].astype(int)
            left = x[inner, dim[inner]] < self.nodes[node[inner], 1]
            node[inner] = np.where(left, self.nodes[node[inner], 2], self.nodes[node[inner], 3]).astype(int)

    def rows_of(self, leaves: np.ndarray) -> np.ndarray:
        rows = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        return rows[rows < len(self.x)]

    def search(self, a: int, x: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and values of the ``k`` nearest candidates of each query of kind ``a`` within its limit, and how many were compared."""
        layout, k = self.layout, self.layout.k
        found, value, met = np.full((len(x), k), -1), np.full((len(x), k), np.inf), np.zeros(len(x), np.int64)
        kind = layout.kind[self.region]
        apart = layout.cats[kind] != layout.asked_cats[a]
        plan = layout.plan(a)
        used, missed = max(len(plan), 1), float(sum(apart[i] for is_num, i in plan if not is_num))
        dims = [j for is_num, j in plan if is_num]
        if len(self.x) <= 4 * LEAF or not dims:
            step = max(1, PAIRS // max(len(self.x), 1))
            for s in range(0, len(x), step):
                e = min(s + step, len(x))
                v = layout.values(a, x[s:e], self.y, apart)
                r, place, c = _first_k(v, self.rank, k, limit[s:e])
                found[s + r, place], value[s + r, place] = c, v[r, c]
                met[s:e] = len(self.x)
            return found, value, met
        leaf = self.leaf_of(np.nan_to_num(x))
        inside = layout.inside(a, x)
        order = np.lexsort((leaf, inside))
        # small floats tell which candidates may be among the nearest; these are computed plainly
        slack = 1e-7 * len(dims) * max(len(dims), 2)
        low, wide = layout.low[a, dims], layout.high[a, dims] - layout.low[a, dims]
        wide = np.where(wide > 0, wide, 1.0)
        y = ((self.y[dims] - low[:, None]) / wide[:, None]).astype(np.float32)
        x32 = ((x[:, dims] - low) / wide).astype(np.float32)

        def sums(q, rows):
            if not inside[q].all():
                return layout.values(a, x[q], self.y[:, rows], apart) * used - missed
            own, there = x32[q], y[:, rows]
            out = np.abs(there[0][None, :] - own[:, 0][:, None])
            for j in range(1, len(dims)):
                t = there[j][None, :] - own[:, j][:, None]
                np.abs(t, out=t)
                out += t
            return out

        def nearer(most, v):
            return np.minimum(most, np.partition(v, k - 1, axis=1)[:, k - 1] + 2 * slack) if v.shape[1] >= k else most

        for s in range(0, len(x), GROUP):
            q = order[s : s + GROUP]
            own, most = x[q], limit[q] * used * (1 + SLACK) - missed + 2 * slack
            width = np.column_stack([layout.widths(a, own, j) for j in dims])
            by = np.where(width.max(axis=0) > 0, 1 / np.where(width.max(axis=0) > 0, width.max(axis=0), 1.0), 0.0)
            gap = np.maximum(np.maximum(self.lo[:, dims] - own[:, dims].max(axis=0), own[:, dims].min(axis=0) - self.hi[:, dims]), 0.0) @ by * (1 - SLACK)
            near = np.unique(leaf[q])
            if len(near) * LEAF < 2 * k + LEAF:
                near = np.union1d(near, np.argpartition(gap, min(4, len(gap) - 1))[:4])
            rows = self.rows_of(near)
            v = sums(q, rows)
            most = nearer(most, v)
            more = gap <= most.max()
            more[near] = False
            more = np.flatnonzero(more)
            more = more[np.argsort(gap[more])]
            for at in range(0, len(more), AHEAD):
                part = more[at : at + AHEAD]
                if gap[part[0]] > most.max():
                    break
                part = part[(layout.least(a, own, self.lo[part], self.hi[part], 0.0) * (1 - SLACK) <= most[:, None]).any(axis=0)]
                if not len(part):
                    continue
                new = self.rows_of(part)
                w = sums(q, new)
                good = (w <= most[:, None]).any(axis=0)
                met[q] += len(new)
                rows, v = np.concatenate([rows, new[good]]), np.concatenate([v, w[:, good]], axis=1)
                most = nearer(most, v)
            met[q] += len(near) * LEAF
            r, c = np.nonzero(v <= most[:, None])
            sure = layout.paired(a, own[r], self.y[:, rows[c]], apart)
            keep = sure <= limit[q][r]
            r, c, sure = r[keep], rows[c[keep]], sure[keep]
            by = np.lexsort((self.rank[c], sure, r))
            r, c, sure = r[by], c[by], sure[by]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            keep = place < k
            found[q[r[keep]], place[keep]], value[q[r[keep]], place[keep]] = c[keep], sure[keep]
        return found, value, met



# --------------------------------------------------------------------------- kinds, regions

def _code(values: Sequence, codes: dict) -> list[int]:
    return [-1 if v is None else codes.setdefault(v, len(codes)) for v in values]


def described(q: DataFrame, cand: DataFrame, feats: list[str], num: list[str], k: int, id_type: str, value_type: str) -> tuple[Layout, DataFrame, DataFrame] | None:
    """``(layout, queries, candidates)`` with the kinds' numbers in ``kind``; None if there are too many kinds, values that are not finite, or no numbers.

    Both sides have ``cl, id, nulls`` and the columns, candidates also ``value``; a region for each kind as yet."""
    cat = [f for f in feats if f not in num]
    if not num:
        return None
    ranges = [f(c).alias(f"{p}_{c}") for c in num for p, f in (("lo", F.min), ("hi", F.max))]
    sides = []
    for side in (cand, q):
        rows = side.groupBy("cl", "nulls", *cat).agg(F.count(F.lit(1)).alias("n"), *ranges).limit(knn.KINDS + 1).collect()
        box = {p: np.array([[np.nan if r[f"{p}_{c}"] is None else r[f"{p}_{c}"] for c in num] for r in rows], float).reshape(len(rows), len(num)) for p in ("lo", "hi")}
        absent = np.array([[int(r.nulls) >> feats.index(c) & 1 for c in num] for r in rows], bool).reshape(len(rows), len(num))
        if not rows or len(rows) > knn.KINDS or not all(np.isfinite(b[~absent]).all() and (np.abs(b[~absent]) < 1e150).all() for b in box.values()):
            return None
        sides.append((rows, box))
    (rows, box), (asked, _) = sides
    cls, codes = {}, [{} for _ in cat]
    cl, nulls = np.array(_code([r.cl for r in rows], cls)), np.array([r.nulls for r in rows], np.int64)
    asked_cl, asked_nulls = np.array(_code([r.cl for r in asked], cls)), np.array([r.nulls for r in asked], np.int64)
    cats, asked_cats = (np.column_stack([np.zeros((len(side), 0), int), *[_code([r[c] for r in side], codes[i]) for i, c in enumerate(cat)]]) for side in (rows, asked))
    full = (1 << len(feats)) - 1
    low, high = (np.full((len(asked), len(num)), np.nan) for _ in range(2))
    for a in range(len(asked)):
        ok = (cl == asked_cl[a]) & ((nulls & (full ^ int(asked_nulls[a]))) == 0)
        for j in range(len(num)):
            for out, side, best in ((low, box["lo"], np.min), (high, box["hi"], np.max)):
                there = side[ok, j][~np.isnan(side[ok, j])]
                out[a, j] = best(there) if len(there) else np.nan
    layout = Layout(feats, num, k, id_type, value_type, cl, nulls, cats, asked_cl, asked_nulls, asked_cats, np.array([r.n for r in asked]), low, high,
                    np.arange(len(rows)), np.array([r.n for r in rows]), box["lo"], box["hi"])
    numbered = []
    for side, own in ((q, asked), (cand, rows)):
        names = ["cl", "nulls", *cat]
        table = side.sparkSession.createDataFrame([(*[r[c] for c in names], i) for i, r in enumerate(own)],
                                                  ", ".join(f"`__{c}` {t}" for c, t in side.select(*names).dtypes) + ", kind int")
        on = functools.reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names))
        numbered.append(side.join(F.broadcast(table), on).select("kind", "id", *(c for c in ("value",) if side is cand), *(F.col(c).alias(x) for c, x in zip(num, layout.x, strict=True))))
    return layout, *numbered


def _cuts(x: np.ndarray, parts: int, scale: np.ndarray) -> tuple | int:
    """A tree of medians with ``parts`` ends: (column, cut, left, right), or the number of ends."""
    wide = np.ptp(x, axis=0) * scale if len(x) > 1 else np.zeros(x.shape[1])
    j = int(np.argmax(wide))
    if parts < 2 or wide[j] <= 0:
        return 1
    left = parts // 2
    cut = float(np.quantile(x[:, j], left / parts))
    below = x[:, j] < cut
    if not below.any():
        cut, below = float(np.min(x[x[:, j] > cut, j])), x[:, j] <= cut
        below = x[:, j] < cut
    return j, cut, _cuts(x[below], left, scale), _cuts(x[~below], parts - left, scale)


def _ends(tree) -> int:
    return tree if isinstance(tree, int) else _ends(tree[2]) + _ends(tree[3])


def _place(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, int):
        return np.zeros(len(x), int)
    below = x[:, tree[0]] < tree[1]
    out = np.empty(len(x), int)
    out[below], out[~below] = _place(tree[2], x[below]), _ends(tree[2]) + _place(tree[3], x[~below])
    return out


def _in_regions(layout: Layout, cand: DataFrame) -> DataFrame:
    """Candidates with their ``region``; kinds above ``REGION`` are cut, and the layout gets the regions."""
    large = np.flatnonzero(layout.n > REGION)
    if not len(large):
        return cand.withColumnRenamed("kind", "region")
    sample = cand.where(F.col("kind").isin([int(x) for x in large]) & (F.pmod(F.xxhash64("id", *layout.x), F.lit(max(1, REGION // SAMPLE))) == 0)).select("kind", *layout.x).toArrow()
    whole = np.nanmax(layout.hi, axis=0, initial=-np.inf) - np.nanmin(layout.lo, axis=0, initial=np.inf)
    scale = np.where(whole > 0, 1 / np.where(whole > 0, whole, 1.0), 0.0)
    trees, base, at = {}, {}, 0
    for kind in range(len(layout.n)):
        own = np.nan_to_num(_numbers(sample.filter(pc.equal(sample.column("kind"), kind)), layout.x)) if layout.n[kind] > REGION else None
        trees[kind] = _cuts(own, -(-int(layout.n[kind]) // REGION), scale) if own is not None else 1
        base[kind], at = at, at + _ends(trees[kind])
    num = layout.x

    def place(batches):
        for batch in batches:
            kinds, x = np.asarray(batch.column("kind")), np.nan_to_num(_numbers(pa.Table.from_batches([batch]), num))
            out = np.empty(len(kinds), np.int32)
            for kind in np.unique(kinds):
                own = np.flatnonzero(kinds == kind)
                out[own] = base[int(kind)] + _place(trees[int(kind)], x[own])
            yield pa.RecordBatch.from_arrays([pa.array(out), *batch.columns[1:]], names=["region", *batch.schema.names[1:]])

    out = cand.mapInArrow(place, ", ".join(["region int", *[f"`{c}` {t}" for c, t in cand.dtypes[1:]]]))
    got = out.groupBy("region").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{p}_{c}") for c in num for p, f in (("lo", F.min), ("hi", F.max))]).collect()
    layout.kind = np.repeat(np.arange(len(layout.n)), [_ends(trees[i]) for i in range(len(layout.n))])
    layout.n, layout.lo, layout.hi = np.zeros(at, np.int64), np.full((at, len(num)), np.nan), np.full((at, len(num)), np.nan)
    for r in got:
        layout.n[r.region] = r.n
        for j, c in enumerate(num):
            layout.lo[r.region, j], layout.hi[r.region, j] = (np.nan if r[f"{p}_{c}"] is None else r[f"{p}_{c}"] for p in ("lo", "hi"))
    layout.memo = {}
    return out


def _shares(layout: Layout) -> np.ndarray:
    """Tasks of each region, by the queries that start in it."""
    asked = np.zeros(len(layout.n))
    for a, n in enumerate(layout.asked_n):
        regions, _ = layout.first(a)
        if len(regions):
            asked[regions] += n * layout.n[regions] / max(layout.n[regions].sum(), 1)
    return np.maximum(1, np.ceil(asked / QUERIES)).astype(int)


# --------------------------------------------------------------------------- nearest

def _packed_ddl(layout: Layout) -> str:
    return f"id {layout.id_type}, n int, total {_total_type(layout)}, cands array<{layout.id_type}>, vals array<{layout.value_type}>, vs array<double>"


def _total_type(layout: Layout) -> str:
    return "bigint" if layout.value_type in ("int", "bigint") else "double"


def _totals(layout: Layout, found: np.ndarray, value) -> pa.Array:
    if layout.value_type in ("string", "date"):
        return pa.nulls(len(found), pa.float64())
    whole = _total_type(layout) == "bigint"
    v = value.to_numpy(zero_copy_only=False)
    sums = np.where(found >= 0, v[np.maximum(found, 0)] if len(v) else np.zeros(found.shape), 0).astype(np.int64 if whole else float).sum(axis=1)
    return pa.array(sums, pa.int64() if whole else pa.float64())


def _compare(layout: Layout, kept: tuple[bool, bool, bool], last: bool):
    """Task of a region: its candidates, then the queries that were brought to it. ``kept``: lists that are wanted of queries that are done."""
    num = layout.x
    types = [knn._ARROW[layout.id_type], pa.int32(), pa.int64() if _total_type(layout) == "bigint" else pa.float64(),
             pa.list_(knn._ARROW[layout.id_type]), pa.list_(knn._ARROW[layout.value_type]), pa.list_(pa.float64())]

    def answer(region: _Region, held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(held).combine_chunks()
        kinds = rows.column("kind").to_numpy()
        for a in np.unique(kinds):
            own = rows.take(pa.array(np.flatnonzero(kinds == a)))
            x, limit = _numbers(own, num), own.column("reach").to_numpy()
            found, v, met = region.search(int(a), x, limit)
            lists = _lists(found, region.ids, region.value, v)
            n = (found >= 0).sum(axis=1)
            out = [own.column("id").combine_chunks(), pa.array(n, pa.int32()), _totals(layout, found, region.value), *lists]
            if last:
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(out, types, strict=True)] + [pa.array(met)], names=["id", "n", "total", "cands", "vals", "vs", "met"])
                continue
            kth = np.where(n >= layout.k, v[:, -1], np.inf)
            todo = layout.todo(int(a), x, kth, region.region)
            done = pc.equal(pc.list_value_length(todo), 0)
            for i, wanted in enumerate(kept):
                if not wanted:
                    out[3 + i] = pc.if_else(done, pa.nulls(len(n), lists[i].type), lists[i])
            more = [pc.if_else(done, pa.scalar(None, pa.float64()), pa.array(x[:, j], from_pandas=True)) for j in range(len(num))]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(out, types, strict=True)] + [pa.array(met), todo, pa.array(np.full(len(n), a), pa.int32()), pa.array(kth), *more],
                                             names=["id", "n", "total", "cands", "vals", "vs", "met", "todo", "kind", "reach", *num])

    def run(batches):
        own, region, cands, held, size = None, None, [], [], 0
        for key, part in knn._runs(batches, ("region", "share", "asks")):
            if key[:2] != own:
                if held:
                    yield from answer(region, held)
                own, region, cands, held, size = key[:2], None, [], [], 0
            if not key[2]:
                cands.append(part)
                continue
            if region is None:
                if not cands:
                    continue  # nobody is here
                region, cands = _Region(layout, key[0], pa.concat_tables(cands).combine_chunks()), []
            held.append(part)
            size += part.num_rows
            if size >= HELD:
                yield from answer(region, held)
                held, size = [], 0
        if held:
            yield from answer(region, held)

    return run


def _brought(layout: Layout, cand: DataFrame, asks: DataFrame, shares: np.ndarray, kept: tuple, last: bool) -> DataFrame:
    num = layout.x
    if (shares > 1).any():
        table = cand.sparkSession.createDataFrame([(i, int(s)) for i, s in enumerate(shares)], "__r int, __s int")
        cand = cand.join(F.broadcast(table), F.col("region") == F.col("__r"))
        share = F.explode(F.sequence(F.lit(0), F.col("__s") - 1))
    else:
        share = F.lit(0)
    cs = cand.select("region", share.alias("share"), F.lit(False).alias("asks"), "id", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("double").alias("reach"), "value", *num)
    qs = asks.select("region", "share", F.lit(True).alias("asks"), "id", "kind", "reach", F.lit(None).cast(layout.value_type).alias("value"), *num)
    both = cs.unionByName(qs).repartition("region", "share").sortWithinPartitions("region", "share", "asks")
    ddl = _packed_ddl(layout) + ", met bigint" + ("" if last else ", todo array<int>, kind int, reach double, " + ", ".join(f"`{c}` double" for c in num))
    return both.mapInArrow(_compare(layout, kept, last), ddl)


def _unique(q: DataFrame) -> bool:
    return not q.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()


def _merged(parts: DataFrame, layout: Layout) -> DataFrame:
    """One row for each id with the ``k`` least of its lists."""
    pairs = F.transform(F.arrays_zip("vs", "cands", "vals"), lambda x: F.struct(x["vs"].alias("v"), x["cands"].alias("cand"), x["vals"].alias("val")))
    best = F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, layout.k)
    out = parts.groupBy("id").agg(best.alias("b"))
    zero = F.lit(0).cast(_total_type(layout))
    total = F.aggregate("b", zero, lambda s, x: s + x["val"].cast(_total_type(layout)))
    return out.select("id", F.size("b").alias("n"), total.alias("total"), F.col("b.cand").alias("cands"), F.col("b.val").alias("vals"), F.col("b.v").alias("vs"))


def nearest(layout: Layout, q: DataFrame, cand: DataFrame, kept: tuple[bool, bool, bool], counts: dict | None = None) -> DataFrame:
    """``id, n, total, cands, vals, vs``: the ``k`` nearest of each query, nearest first. ``kept``: which of the lists are wanted."""
    alone = _unique(q)
    kept = kept if alone else (True, True, True)
    cand = _in_regions(layout, cand)
    shares = _shares(layout)
    num = layout.x

    def home(batches):
        for batch in batches:
            kinds, x = np.asarray(batch.column("kind")), _numbers(pa.Table.from_batches([batch]), num)
            region = np.full(len(kinds), -1, np.int32)
            for a in np.unique(kinds):
                own = np.flatnonzero(kinds == a)
                at = layout.home(int(a), x[own])
                if at is not None:
                    region[own] = at
            there = pa.array(np.flatnonzero(region >= 0))
            share = (np.arange(len(region)) % shares[region]).astype(np.int32)
            cols = [pa.array(region), pa.array(share), pa.array(np.full(len(region), np.inf)), *batch.columns]
            yield pa.RecordBatch.from_arrays([c.take(there) for c in cols], names=["region", "share", "reach", *batch.schema.names])

    asks = q.mapInArrow(home, "region int, share int, reach double, " + ", ".join(f"`{c}` {t}" for c, t in q.dtypes))
    first = written(_brought(layout, cand, asks, shares, kept, False), "near")
    open_ = first.where(F.size("todo") > 0)
    wanted = [r.region for r in open_.select(F.explode("todo").alias("region")).distinct().collect()]
    if counts is not None:
        counts["compared"] = first.agg(F.coalesce(F.sum("met"), F.lit(0)).alias("n")).first().n
    cols = ["id", "n", "total", "cands", "vals", "vs"]
    if not wanted:
        return first.select(*cols) if alone else _merged(first, layout)
    again = open_.select(F.explode("todo").alias("region"), F.lit(0).alias("share"), "reach", "kind", "id", *num)
    rest = _brought(layout, cand.where(F.col("region").isin(wanted)), again, np.ones(len(layout.n), int), (True, True, True), True)
    if counts is not None:
        rest = written(rest, "near")
        counts["compared"] += rest.agg(F.coalesce(F.sum("met"), F.lit(0)).alias("n")).first().n
    if not alone:
        return _merged(first.select(*cols).unionByName(rest.select(*cols)), layout)
    return first.where(F.size("todo") == 0).select(*cols).unionByName(_merged(open_.select(*cols).unionByName(rest.select(*cols)), layout))


# --------------------------------------------------------------------------- farthest

def _group(layout: Layout) -> tuple[dict, dict, list]:
    """Candidates as a query pattern sees them: ``(pattern of each kind of query, group of each pattern and kind, groups)``, where the
    members of a group agree in the categories that the pattern has."""
    patterns, of_kind, groups, group_of = {}, {}, [], {}
    for a in range(len(layout.asked_n)):
        of_kind[a] = patterns.setdefault((int(layout.asked_cl[a]), int(layout.asked_nulls[a])), a)
    for a in patterns.values():
        cats = [i for is_num, i in layout.plan(a) if not is_num]
        for kind in layout.meets(a)[0]:
            key = (a, tuple(layout.cats[kind, cats]))
            if key not in group_of:
                group_of[key] = len(groups)
                groups.append((a, kind))
            group_of[a, int(kind)] = group_of[key]
    return of_kind, group_of, groups


def _scaled(layout: Layout, a: int, x: np.ndarray) -> np.ndarray:
    """Numbers as shares of the candidates' range; 0 in columns that the queries lack or that have no spread."""
    out = np.zeros(x.shape)
    for is_num, j in layout.plan(a):
        if is_num and layout.high[a, j] > layout.low[a, j]:
            out[:, j] = (x[:, j] - layout.low[a, j]) / (layout.high[a, j] - layout.low[a, j])
    return out


def _outermost(layout: Layout, a: int, x: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Rows among the ``k`` first in some direction, of candidates that agree in their categories."""
    places, k = _scaled(layout, a, x), layout.k
    order = np.lexsort((rank, *places.T))
    new = np.concatenate([[True], (places[order[1:]] != places[order[:-1]]).any(axis=1)]) if len(order) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    rows = np.sort(order[np.arange(len(order)) - start[np.cumsum(new) - 1] < k])  # of equal ones the first k
    keep = np.zeros(len(rows), bool)
    for score in knn._directions(places[rows]):
        keep |= score >= (np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else -np.inf) - knn.CLOSE
    return rows[keep]


def _opposite(layout: Layout, a: int, x: np.ndarray, cats: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Candidates among the ``k`` first in some direction, mismatches with the categories ``mine`` added."""
    apart = (cats != mine).sum(axis=1).astype(float)
    keep = np.zeros(len(x), bool)
    for score in knn._directions(_scaled(layout, a, x)):
        score = score + apart
        keep |= score >= (np.partition(score, len(score) - layout.k)[len(score) - layout.k] if len(score) > layout.k else -np.inf) - knn.CLOSE
    return np.flatnonzero(keep)


def _picked(layout: Layout, group_of: dict, groups: list, numbered: bool):
    """Task that keeps of the candidates it reads those on the outside of their group (``grp``). ``numbered``: they have it already."""
    num = layout.x
    kinds_of: dict[int, list[int]] = {}
    for key, g in group_of.items():
        if not isinstance(key[1], tuple):
            kinds_of.setdefault(key[1], []).append(g)

    def thin(g: int, parts: list[pa.Table]) -> pa.Table:
        rows = pa.concat_tables(parts).combine_chunks()
        return rows.take(pa.array(_outermost(layout, groups[g][0], _numbers(rows, num), _ranks(rows.column("id").combine_chunks()))))

    def run(batches):
        held: dict[int, list] = {}
        size: dict[int, int] = {}
        limit: dict[int, int] = {}
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            by = rows.column("grp" if numbered else "kind").to_numpy()
            order = np.argsort(by, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(by[order])) + 1).tolist(), len(order)] if len(order) else [0]
            for s, e in itertools.pairwise(cuts):
                part = rows.take(pa.array(order[s:e])).select(["id", "value", *num])
                for g in [int(by[order[s]])] if numbered else kinds_of.get(int(by[order[s]]), []):
                    held.setdefault(g, []).append(part)
                    size[g] = size.get(g, 0) + part.num_rows
                    if size[g] > limit.get(g, PICK):
                        held[g] = [thin(g, held[g])]
                        size[g] = held[g][0].num_rows
                        limit[g] = max(PICK, 2 * size[g])
        for g, parts in held.items():
            out = thin(g, parts).combine_chunks()
            yield from out.add_column(0, "grp", pa.array(np.full(out.num_rows, g), pa.int32())).to_batches()

    return run


def farthest(layout: Layout, q: DataFrame, cand: DataFrame, kept: tuple[bool, bool, bool], counts: dict | None = None) -> DataFrame | None:
    """As :func:`nearest`, the ``k`` farthest (``vs`` below 0); None if too many candidates are on the outside or queries beyond the range."""
    num, k = layout.x, layout.k
    if len(num) > knn.DIRECTIONS:
        return None
    of_kind, group_of, groups = _group(layout)
    beyond = _beyond(layout, q)
    outside = beyond.limit(OUTSIDE + 1).collect() if beyond is not None else []
    if len(outside) > OUTSIDE or not groups:
        return None
    types = dict(cand.dtypes)
    ddl = f"grp int, id {types['id']}, value {types['value']}, " + ", ".join(f"`{c}` double" for c in num)
    cores = max(cand.sparkSession.sparkContext.defaultParallelism, -(-int(layout.n.sum()) // 2_000_000))
    outer = cand.coalesce(cores).mapInArrow(_picked(layout, group_of, groups, False), ddl)
    outer = outer.repartition(cores, "grp").mapInArrow(_picked(layout, group_of, groups, True), ddl)
    outer = cut_lineage(outer)
    if not outer.limit(FEW + 1).count() <= FEW:
        return None
    few = outer.toArrow()
    by, x = few.column("grp").to_numpy(), _numbers(few, num)
    pattern = np.array([g[0] for g in groups])[by] if few.num_rows else np.zeros(0, int)
    cats = layout.cats[np.array([g[1] for g in groups])[by]] if few.num_rows else np.zeros((0, layout.cats.shape[1]), int)
    ids, values = few.column("id").combine_chunks(), few.column("value").combine_chunks()
    rank = _ranks(ids)

    def opposite(batches):
        for batch in batches:
            for a in batch.column("id").to_pylist():
                own = np.flatnonzero(pattern == of_kind[a])
                there = [i for is_num, i in layout.plan(a) if not is_num]
                rows = own[_opposite(layout, a, x[own], cats[own][:, there], layout.asked_cats[a, there])] if len(own) else own
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([rows], pa.list_(pa.int32()))], names=["a", "rows"])

    chosen = {r.a: np.array(r.rows, int) for r in cand.sparkSession.range(0, len(layout.asked_n), 1, cores).mapInArrow(opposite, "a int, rows array<int>").collect()}
    types_out = [knn._ARROW[layout.id_type], pa.int32(), pa.int64() if _total_type(layout) == "bigint" else pa.float64(),
                 pa.list_(knn._ARROW[layout.id_type]), pa.list_(knn._ARROW[layout.value_type]), pa.list_(pa.float64())]
    alone = _unique(q)
    lists_wanted = kept if alone else (True, True, True)

    def compare(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            kinds, all_x = rows.column("kind").to_numpy(), _numbers(rows, num)
            for a in np.unique(kinds):
                at = np.flatnonzero(kinds == a)
                at = at[layout.inside(int(a), all_x[at])]
                own = chosen[int(a)]
                if not len(own) or not len(at):
                    continue
                y, apart = np.ascontiguousarray(x[own].T), (cats[own] != layout.asked_cats[a]).T
                for s in _slices(len(at), len(own)):
                    part = at[s]
                    v = -layout.values(int(a), all_x[part], y, apart)
                    found, value = np.full((len(part), k), -1), np.full((len(part), k), np.inf)
                    r, place, c = _first_k(v, rank[own], k)
                    found[r, place], value[r, place] = own[c], v[r, c]
                    lists = _lists(found, ids, values, value)
                    lists = [m if wanted else pa.nulls(len(part), m.type) for m, wanted in zip(lists, lists_wanted, strict=True)]
                    out = [rows.column("id").take(pa.array(part)).combine_chunks(), pa.array((found >= 0).sum(axis=1), pa.int32()), _totals(layout, found, values), *lists]
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(out, types_out, strict=True)] + [pa.array(np.full(len(part), len(own)), pa.int64())],
                                                     names=["id", "n", "total", "cands", "vals", "vs", "met"])

    ddl = _packed_ddl(layout) + ", met bigint"
    found = q.mapInArrow(compare, ddl)
    cols = ["id", "n", "total", "cands", "vals", "vs"]
    far = None
    if outside:
        asks = [(r.kind, np.array([np.nan if r[c] is None else r[c] for c in num], float)) for r in outside]
        names = pa.array([r.id for r in outside], knn._ARROW[layout.id_type])

        def pass_by(batches):
            best: dict[int, tuple] = {}
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                kinds, there = rows.column("kind").to_numpy(), _numbers(rows, num)
                for i, (a, one) in enumerate(asks):
                    at = np.flatnonzero(np.isin(kinds, layout.meets(a)[0]))
                    if not len(at):
                        continue
                    apart = (layout.cats[kinds[at]] != layout.asked_cats[a]).T
                    v = -layout.values(a, one[None, :], np.ascontiguousarray(there[at].T), apart)
                    part = rows.take(pa.array(at)).select(["id", "value"])
                    if i in best:
                        part, v = pa.concat_tables([best[i][0], part]), np.concatenate([best[i][1], v], axis=1)
                    part = part.combine_chunks()
                    _, _, c = _first_k(v, _ranks(part.column("id").combine_chunks()), k)
                    best[i] = part.take(pa.array(c)).combine_chunks(), v[:, c]
            for i, (part, v) in best.items():
                found = np.arange(part.num_rows)[None, :]
                own, value = (part.column(c).combine_chunks() for c in ("id", "value"))
                out = [names.take(pa.array([i])), pa.array([part.num_rows], pa.int32()), _totals(layout, found, value), *_lists(found, own, value, v)]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(out, types_out, strict=True)] + [pa.array([0], pa.int64())], names=["id", "n", "total", "cands", "vals", "vs", "met"])

        far = cand.mapInArrow(pass_by, ddl)
    if counts is not None:
        found = written(found, "far")
        counts["compared"] = found.agg(F.coalesce(F.sum("met"), F.lit(0)).alias("n")).first().n + len(outside) * int(layout.n.sum())
    if not alone:
        return _merged(found.select(*cols) if far is None else found.select(*cols).unionByName(far.select(*cols)), layout)
    found = found.select(*cols)
    return found if far is None else found.unionByName(_merged(far.select(*cols), layout))


def _beyond(layout: Layout, q: DataFrame) -> DataFrame | None:
    """Queries with a number outside the range of the candidates."""
    rows = [(a, *[None if np.isnan(x) else float(x) for x in (*layout.low[a], *layout.high[a])]) for a in range(len(layout.asked_n)) if len(layout.meets(a)[0])]
    if not rows:
        return None
    n = len(layout.num)
    table = q.sparkSession.createDataFrame(rows, "__a int, " + ", ".join([f"__l{j} double" for j in range(n)] + [f"__h{j} double" for j in range(n)]))
    out: Column = F.lit(False)
    for j, c in enumerate(layout.x):
        out = out | F.coalesce((F.col(c) < F.col(f"__l{j}")) | (F.col(c) > F.col(f"__h{j}")), F.lit(False))
    return q.join(F.broadcast(table), F.col("kind") == F.col("__a")).where(out).select(*q.columns)
