"""Exact top-k inner products by best-first search in M-trees.

Vectors become integers, ``floor(256 * x)``. With one more coordinate,
``sqrt(R^2 - |x|^2)`` for the largest norm R of a tree, the inner product with
a query (0 there) falls as the Euclidean distance grows, so a metric tree finds
the largest products.

The vectors are dealt to trees of about ``TREE`` rows by the nearest of a few
pivots, crowded pivots to several trees. A tree is pages of ``PAGE`` entries:
objects in leaves, routing objects with covering radius above, each with its
distance to the page's own routing object and the smallest id below. A search
takes leaves by their best possible product; before any distance to an entry is
computed, the triangle inequality on the stored parent distance is tried.
Bounds carry a slack over rounding, products are exact integers, and equal
products go by the smaller id, which also prunes pages of equal vectors.

Many queries search a tree at once: each has its own bounds, order of leaves and
floor, and those that are at the same leaf share one matrix product, in single
precision where that is exact.

Scale: trees are built and searched one at a time in tasks. Each query first
searches the tree that holds it, and its scores there prune the other trees.
For these, trees are in at most ``GROUPS`` groups and queries (a stated set) in
chunks that fit a task's memory; a task takes the trees of one group, one after
the other, to the queries of one chunk, whose scores it carries along. So a
query is copied once a group, a tree once a chunk, and at most ``k`` rows per
query and group are shuffled to the final ranking.

Defined results: vectors that are null or hold null or non-finite components,
and rows without id, take no part; shorter vectors count as padded by zeros;
repeated ids are candidates each, but never of their own id; a query with fewer
than k candidates gets them all; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import release, ship_package, shuffle_partitions, staged
from furrow.sources.tables import load

TREE = 16384
PAGE = 512
PIVOTS = 256
GROUPS = 32
#: Trees that one task builds, about.
BUILT = 16
#: Bytes of the queries in a task, components of those in one search, rows of
#: one matrix product.
QUERY_BYTES = 1 << 26
STRIP = 1 << 21
ROWS = 2048
#: Copies of the trees that are made for more tasks.
COPIES = 3
TOP = 5
SCALE = 256.0

_NONE = np.iinfo(np.int64).min


class Best:
    """The k best (score, id) of each query, best first. ``kind`` tells places
    not filled (0), pairs it began with (1) and found ones (2)."""

    def __init__(self, n: int, k: int):
        self.scores = np.zeros((n, k), dtype=np.int64)
        self.ids = np.zeros((n, k), dtype=np.int64)
        self.kind = np.zeros((n, k), dtype=np.int8)
        # Score and id that a pair has to beat, the score also as a float.
        self.floor = np.full(n, _NONE, dtype=np.int64)
        self.bound = np.full(n, -np.inf)
        self.late = np.full(n, np.iinfo(np.int64).max, dtype=np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, kind: int = 2) -> None:
        if not len(rows):
            return
        at, row = np.unique(rows, return_inverse=True)
        k = self.scores.shape[1]
        held = self.kind[at] > 0
        row = np.concatenate([np.nonzero(held)[0], row])
        scores = np.concatenate([self.scores[at][held], scores])
        ids = np.concatenate([self.ids[at][held], ids])
        kinds = np.concatenate([self.kind[at][held], np.full(len(rows), kind, dtype=np.int8)])
        order = np.lexsort((ids, ~scores, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(at)))[row]
        on = place < k
        row, place, order = at[row[on]], place[on], order[on]
        self.scores[row, place], self.ids[row, place], self.kind[row, place] = scores[order], ids[order], kinds[order]
        full = at[self.kind[at, -1] > 0]
        self.floor[full], self.bound[full], self.late[full] = self.scores[full, -1], self.scores[full, -1], self.ids[full, -1]


class MTree:
    """Pages as arrays. Page p owns entries ``first[p]:first[p + 1]``; an
    entry's ``child`` is a page, or -1 for a stored vector. The entries of a
    leaf stand by their distance to its routing object."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE):
        self.page = page
        self.ids, self.vectors = ids, vectors
        self._lift()
        self._rng = np.random.default_rng(len(ids))
        self.pages: list[list[np.ndarray]] = []
        every = np.lexsort((np.arange(len(ids)), ids))
        self.root_object = int(every[0]) if len(every) else -1
        self._split(every, self._distance(every, self.root_object))
        self.first = np.concatenate([[0], np.cumsum([len(p[0]) for p in self.pages])])
        self.object, self.radius, self.parent, self.child, self.least = (np.concatenate(x) for x in zip(*self.pages))
        self.root_radius = float((self.parent + self.radius).max()) if len(ids) else 0.0
        del self.pages, self._rng

    def _lift(self) -> None:
        whole = self.vectors.astype(np.float64)
        norms = np.einsum("ij,ij->i", whole, whole)
        self.reach = float(norms.max()) if len(norms) else 0.0  # R squared
        self.points = np.column_stack([whole, np.sqrt(np.maximum(self.reach - norms, 0.0))])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "points"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._lift()

    def _distance(self, rows: np.ndarray, to: int) -> np.ndarray:
        if not len(rows):
            return np.empty(0)
        d = self.points[rows] - self.points[to]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _split(self, rows: np.ndarray, away: np.ndarray) -> int:
        """Make the page of ``rows``, which are ``away`` from its routing
        object; returns its number."""
        number = len(self.pages)
        self.pages.append([])
        if len(rows) <= self.page:
            near = np.argsort(away, kind="stable")
            self.pages[number] = [rows[near], np.zeros(len(rows)), away[near], np.full(len(rows), -1), self.ids[rows[near]]]
            return number
        fan = min(self.page, -(-len(rows) // self.page))
        seeds = np.sort(self._rng.choice(len(rows), fan, replace=False))
        # All points are equally long: the largest product is the least distance.
        owner = (self.points[rows] @ self.points[rows[seeds]].T).argmax(axis=1)
        if np.bincount(owner, minlength=fan).max() > 0.9 * len(rows):
            owner = np.arange(len(rows)) * fan // len(rows)  # (nearly) equal vectors: cut by id
            seeds = np.searchsorted(owner, np.arange(fan))
        entries = []
        for i, s in enumerate(seeds):
            part = rows[owner == i]
            if len(part):
                reach = self._distance(part, rows[s])
                entries.append((rows[s], reach.max(), away[s], self._split(part, reach), self.ids[part].min()))
        self.pages[number] = [np.array(x, dtype=t) for x, t in zip(zip(*entries), ("i8", "f8", "f8", "i8", "i8"))]
        return number

    def search(self, query: np.ndarray, own_id: int, k: int, floor: tuple[int, int] | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), or those better than ``floor`` (score, id)."""
        best = Best(1, k)
        if floor:
            best.add(np.zeros(k, dtype=np.int64), np.full(k, floor[0]), np.full(k, floor[1]), kind=1)
        self.search_all(query[None], np.array([own_id]), best)
        on = best.kind[0] == 2
        return list(zip(best.scores[0, on].tolist(), best.ids[0, on].tolist()))

    def search_all(self, queries: np.ndarray, own_ids: np.ndarray, best: Best, rows: np.ndarray | None = None) -> None:
        """Put what the tree has for ``queries`` (or some ``rows`` of them) into
        ``best``."""
        if not len(self.ids) or not len(queries):
            return
        rows = np.arange(len(queries)) if rows is None else rows
        pages = np.arange(len(self.first) - 1)
        leaves = pages[self.child[self.first[:-1]] < 0]
        number = np.zeros(len(pages), dtype=np.int64)
        number[leaves] = np.arange(len(leaves))
        strip = max(128, STRIP // max(64, queries.shape[1], len(leaves) // 2))
        for a in range(0, len(rows), strip):
            part = rows[a:a + strip]
            _Search(self, queries[part], own_ids[part], best, part).run(leaves, number)


class _Search:
    """One search of some queries in one tree."""

    def __init__(self, tree: MTree, queries: np.ndarray, own_ids: np.ndarray, best: Best, rows: np.ndarray):
        self.tree, self.own, self.best, self.rows = tree, own_ids, best, rows
        whole = queries.astype(np.float64)
        self.qq = np.einsum("ij,ij->i", whole, whole)
        most = float(self.qq.max()) * tree.reach
        # Sums of whole numbers below 2 ** 24 or 2 ** 52 are exact.
        self.kind = np.float32 if most < 2.0 ** 48 else np.float64 if most < 2.0 ** 104 else np.int64
        self.q = queries.astype(self.kind)
        self.sum = self.qq + tree.reach
        self.slack = 1e-9 * self.sum + 1e-3

    def product(self, at: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Largest inner product of queries ``at`` at a distance of at least this."""
        shape = (-1,) + (1,) * (distance.ndim - 1)
        d = np.maximum(distance, 0.0)
        return np.floor((self.sum[at].reshape(shape) - d * d) / 2 + self.slack[at].reshape(shape))

    def hopeful(self, at: np.ndarray, products: np.ndarray, least) -> np.ndarray:
        """False where no entry below can enter the result."""
        shape = (-1,) + (1,) * (products.ndim - 1)
        worst, late = self.best.bound[self.rows[at]].reshape(shape), self.best.late[self.rows[at]].reshape(shape)
        return (products > worst) | ((products == worst) & (least < late))

    def vectors(self, objects: np.ndarray) -> np.ndarray:
        return self.tree.vectors[objects].astype(np.int64) if self.kind is np.int64 else self.tree.points[objects][:, :-1].astype(self.kind)

    def distances(self, at: np.ndarray, objects: np.ndarray) -> np.ndarray:
        if self.kind is not np.int64:  # exact products
            return np.sqrt(np.maximum(self.sum[at][:, None] - 2.0 * (self.q[at] @ self.vectors(objects).T), 0.0))
        out = np.empty((len(at), len(objects)))
        for i, p in enumerate(self.tree.points[objects]):
            d = self.q[at].astype(np.float64) - p[:-1]
            out[:, i] = np.sqrt(np.einsum("ij,ij->i", d, d) + p[-1] ** 2)
        return out

    def run(self, leaves: np.ndarray, number: np.ndarray) -> None:
        t = self.tree
        bounds = np.full((len(self.rows), len(leaves)), -np.inf)
        away = np.zeros((len(self.rows), len(leaves)))
        at = np.arange(len(self.rows))
        to_root = self.distances(at, np.array([t.root_object]))[:, 0]
        reach = self.product(at, to_root - t.root_radius)
        on = self.hopeful(at, reach, t.ids.min())
        inner = [(0, at[on], to_root[on], reach[on])]
        while inner:  # bounds of all leaves that can hold a result
            page, at, distance, reach = inner.pop()
            if t.child[t.first[page]] < 0:
                bounds[at, number[page]], away[at, number[page]] = reach, distance
                continue
            e = np.arange(t.first[page], t.first[page + 1])
            # Stored parent distances bound an entry's distance for free.
            on = self.hopeful(at, self.product(at, np.abs(distance[:, None] - t.parent[e]) - t.radius[e]), t.least[e])
            some = on.any(axis=0)
            e, on = e[some], on[:, some]
            if not len(e):
                continue
            d = self.distances(at, t.object[e])
            reach = self.product(at, d - t.radius[e])
            on &= self.hopeful(at, reach, t.least[e])
            for i, child in enumerate(t.child[e].tolist()):
                if (x := on[:, i]).any():
                    inner.append((child, at[x], d[x, i], reach[x, i]))

        least = np.array([t.least[t.first[p]:t.first[p + 1]].min() for p in leaves.tolist()])
        order = np.argsort(-bounds, axis=1)
        at, done, width = np.arange(len(self.rows)), 0, 1
        while done < len(leaves):  # best leaf first; after the second, twice as many in each step
            ahead = order[at, done]
            at = at[(bounds[at, ahead] >= self.best.bound[self.rows[at]]) & (bounds[at, ahead] > -np.inf)]
            if not len(at):
                break
            next_ = order[at, done:done + width]
            row, leaf = np.repeat(at, next_.shape[1]), next_.ravel()
            on = (bounds[row, leaf] > -np.inf) & self.hopeful(row, bounds[row, leaf], least[leaf])
            row, leaf = row[on], leaf[on]
            by = np.argsort(leaf.astype(np.int16 if len(leaves) < 1 << 15 else np.int64), kind="stable")
            row, leaf = row[by], leaf[by]
            cuts = np.flatnonzero(np.diff(leaf, prepend=-1, append=-1)) if len(leaf) else []
            found, held = [], 0
            for a, b in zip(cuts[:-1], cuts[1:]):
                for c in range(a, b, ROWS):
                    x = row[c:min(b, c + ROWS)]
                    new = self.leaf(int(leaves[leaf[a]]), least[leaf[a]], x, away[x, leaf[a]])
                    if new is not None:
                        found.append(new)
                        held += len(new[0])
                    if held > 1 << 18:
                        self.take(found)
                        found, held = [], 0
            self.take(found)
            done, width = done + width, done + width

    def take(self, found: list[tuple]) -> None:
        if found:
            self.best.add(*(np.concatenate(x) for x in zip(*found)))

    def leaf(self, page: int, least: int, at: np.ndarray, distance: np.ndarray):
        """(row, score, id) of the entries that beat the floors of queries ``at``."""
        t = self.tree
        rows = self.rows[at]
        # Only entries at such parent distances can have the floor's product.
        far = np.sqrt(np.maximum(self.sum[at] + 2 * self.slack[at] - 2 * self.best.bound[rows], -1.0) + 0j).real             if False else np.sqrt(np.maximum(self.sum[at] + 2 * self.slack[at] - 2 * self.best.bound[rows], 0.0))
        parent = t.parent[t.first[page]:t.first[page + 1]]
        low, high = np.searchsorted(parent, distance - far, "left"), np.searchsorted(parent, distance + far, "right")
        on = low < high
        if not on.all():
            at, rows, low, high = at[on], rows[on], low[on], high[on]
            if not len(at):
                return None
        objects = t.object[t.first[page] + low.min():t.first[page] + high.max()]
        scores = self.q[at] @ self.vectors(objects).T
        need = self.best.floor[rows] + ((self.best.late[rows] <= least) & (self.best.bound[rows] > -np.inf))
        # Few do: they are found eight at a time.
        beats = np.zeros((len(at), -(-len(objects) // 8) * 8), dtype=bool)
        np.greater_equal(scores, need.astype(self.kind)[:, None], out=beats[:, :len(objects)])
        some = np.flatnonzero(beats.view(np.uint64) != 0)
        if not len(some):
            return None
        eight, one = np.nonzero(beats.reshape(-1, 8)[some])
        row, column = np.divmod(some[eight] * 8 + one, beats.shape[1])
        score, ids = scores[row, column].astype(np.int64), t.ids[objects[column]]
        on = (ids != self.own[at[row]]) & ((score > self.best.floor[rows[row]]) | (ids < self.best.late[rows[row]]))
        return rows[row[on]], score[on], ids[on]


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): rows that take part, components as floor(256 * x)."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return (vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
            .select(F.col(id_col).cast("bigint").alias("vec_id"),
                    F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint")).alias("v")))


def _matrix(column, width: int, kind=np.int64) -> np.ndarray:
    """Rows of lists, padded by zeros."""
    out = np.zeros((len(column), width), dtype=kind)
    out[np.arange(width) < column.value_lengths().to_numpy()[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _packed(matrix: np.ndarray) -> pa.Array:
    """Rows as binary values."""
    n, size = len(matrix), matrix.shape[1] * matrix.itemsize
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix).tobytes())])


def _unpacked(column, width: int, kind) -> np.ndarray:
    out = np.frombuffer(b"".join(x.as_buffer() for x in column), dtype=kind)
    return out.reshape(len(column), width)


def _nearest(pivots: np.ndarray, kind):
    def run(batches):
        p = pivots.astype(np.float64)
        pp = np.einsum("ij,ij->i", p, p)
        for b in batches:
            m = _matrix(b["v"], pivots.shape[1], kind)
            cell = (pp - 2 * (m.astype(np.float64) @ p.T)).argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["asked"], _packed(m), pa.array(cell)],
                                             names=["vec_id", "asked", "v", "cell"])
    return run


def _build_trees(width: int, kind):
    """Rows sorted by tree; of a tree, its rows that are queries go along."""
    def tree_row(tree, parts):
        ids, asked, vectors = (np.concatenate(x) for x in zip(*parts))
        payload = pickle.dumps((MTree(ids, vectors), np.flatnonzero(asked)), protocol=pickle.HIGHEST_PROTOCOL)
        return pa.RecordBatch.from_arrays([pa.array([tree], pa.int64()), pa.array([payload], pa.binary())], names=["tree", "payload"])

    def run(batches):
        tree, parts = None, []
        for b in batches:
            if not len(b):
                continue
            trees, vectors = b["tree"].to_numpy(), _unpacked(b["v"], width, kind)
            ids, asked = b["vec_id"].to_numpy(), b["asked"].to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(trees)) + 1).tolist(), len(trees)]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if trees[x] != tree:
                    if parts:
                        yield tree_row(tree, parts)
                    tree, parts = int(trees[x]), []
                parts.append((ids[x:y].copy(), asked[x:y].copy(), vectors[x:y].copy()))
        if parts:
            yield tree_row(tree, parts)
    return run


_ASKED = "tree bigint, query bigint, vec_id bigint, v binary, scores array<bigint>, ids array<bigint>"


def _lists(values: np.ndarray, on: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(on.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[on]))


def _search_home(k: int):
    """Queries of each tree, each (id, vector) once, with their best there."""
    def run(batches):
        for b in batches:
            for tree, payload in zip(b["tree"].to_pylist(), b["payload"]):
                built, asked = pickle.loads(payload.as_buffer())
                once = {(int(built.ids[i]), built.vectors[i].tobytes()): i for i in asked[::-1].tolist()}
                at = np.sort(np.fromiter(once.values(), dtype=np.int64, count=len(once)))
                if not len(at):
                    continue
                best = Best(len(at), k)
                built.search_all(built.vectors[at], built.ids[at], best)
                on = best.kind > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), tree)), pa.array((np.int64(tree) << 32) + at), pa.array(built.ids[at]), _packed(built.vectors[at]),
                     _lists(best.scores, on), _lists(best.ids, on)], names=["tree", "query", "vec_id", "v", "scores", "ids"])
    return run


_FOUND = "query bigint, query_id bigint, vec_id bigint, score bigint"


def _search_trees(width: int, kind, k: int):
    """Rows sorted by slot, its queries first, then its trees."""
    def begin(parts):
        home, query, own, vectors, rows, scores, ids = (np.concatenate(x) for x in zip(*parts))
        best = Best(len(query), k)
        best.add(rows, scores, ids, kind=1)
        return home, query, own, vectors, best

    def found(query, own, best):
        row, place = np.nonzero(best.kind == 2)
        for a in range(0, len(row), 1 << 16):
            r, p = row[a:a + (1 << 16)], place[a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (query[r], own[r], best.ids[r, p], best.scores[r, p])],
                                             names=["query", "query_id", "vec_id", "score"])

    def run(batches):
        slot, parts, n, asked = None, [], 0, None
        for b in batches:
            if not len(b):
                continue
            slots, is_tree = b["slot"].to_numpy(), b["payload"].is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(slots) != 0) | is_tree[1:] | is_tree[:-1]) + 1).tolist(), len(slots)]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if slots[x] != slot:
                    if asked:
                        yield from found(asked[1], asked[2], asked[4])
                    slot, parts, n, asked = slots[x], [], 0, None
                rows = b.slice(x, y - x)
                if not is_tree[x]:
                    counts = rows["ids"].value_lengths().to_numpy()
                    parts.append((rows["tree"].to_numpy().copy(), rows["query"].to_numpy().copy(), rows["vec_id"].to_numpy().copy(),
                                  _unpacked(rows["v"], width, kind).copy(), np.repeat(np.arange(n, n + len(rows)), counts),
                                  rows["scores"].flatten().to_numpy().copy(), rows["ids"].flatten().to_numpy().copy()))
                    n += len(rows)
                    continue
                if parts:
                    asked, parts = begin(parts), []
                if asked:
                    home, _, own, vectors, best = asked
                    built, _ = pickle.loads(rows["payload"][0].as_buffer())
                    built.search_all(vectors, own, best, np.flatnonzero(home != rows["tree"][0].as_py()))
        if asked:
            yield from found(asked[1], asked[2], asked[4])
    return run


def top_products(vectors: DataFrame, query_ids, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows whose id meets
    ``query_ids`` (a function of the id column), the k largest products."""
    ship_package(vectors.sparkSession)
    parts = shuffle_partitions(vectors)
    points = staged(quantised(vectors, id_col, vector_col).withColumn("asked", F.coalesce(query_ids(F.col("vec_id")), F.lit(False))), "mtree-points")
    n, width, low, high = points.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.min(F.array_min("v")), F.lit(0)),
                                     F.coalesce(F.max(F.array_max("v")), F.lit(0))).first()
    kind = next(x for x in (np.int16, np.int32, np.int64) if np.iinfo(x).min <= low and high <= np.iinfo(x).max)
    few = max(1, min(PIVOTS, -(-n // TREE)))
    chosen = points.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(few).select("v").collect()  # at most PIVOTS
    pivots = np.zeros((max(1, len(chosen)), width), dtype=np.int64)
    for i, r in enumerate(chosen):
        pivots[i, :len(r["v"])] = r["v"]
    dealt = staged(points.mapInArrow(_nearest(pivots, kind), "vec_id bigint, asked boolean, v binary, cell int"), "mtree-cells")
    release(points)
    # Trees of a cell have consecutive numbers; at most PIVOTS cells.
    trees_of = [0] * len(pivots)
    for r in dealt.groupBy("cell").count().collect():
        trees_of[r["cell"]] = -(-r["count"] // TREE)
    total = sum(trees_of)
    first_of = [sum(trees_of[:i]) for i in range(len(trees_of))]
    number = F.get(F.lit(first_of), "cell") + F.pmod(F.xxhash64("vec_id"), F.get(F.lit(trees_of), "cell"))
    tasks = max(1, min(total, max(parts, -(-total // BUILT))))
    trees = staged(dealt.select(number.cast("bigint").alias("tree"), "vec_id", "asked", "v")
                   .repartitionById(tasks, F.pmod("tree", F.lit(tasks)).cast("int")).sortWithinPartitions("tree")
                   .mapInArrow(_build_trees(width, kind), "tree bigint, payload binary"), "mtree-trees")
    release(dealt)

    asked = staged(trees.mapInArrow(_search_home(k), _ASKED), "mtree-home")
    first = asked.select("query", F.col("vec_id").alias("query_id"), F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))))
    groups = max(1, min(total, GROUPS))
    queries = asked.count()
    # Chunks fit a task's memory; with few trees there are some more, for the
    # sake of tasks. All trees are copied to each.
    size = width * np.dtype(kind).itemsize + 24 * k
    chunks = max(1, -(-queries * size // QUERY_BYTES), min(COPIES, -(-parts // groups), -(-queries // ROWS)))
    slots = groups * chunks
    # Every chunk goes to every group of trees: the stated query set against
    # all rows.
    to_groups = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn(
        "slot", (F.col("group") * chunks + F.pmod(F.xxhash64("query"), F.lit(chunks))).cast("int")).drop("group")
    to_chunks = trees.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn(
        "slot", (F.pmod("tree", F.lit(groups)) * chunks + F.col("chunk")).cast("int")).drop("chunk")
    rest = (to_groups.unionByName(to_chunks, allowMissingColumns=True).repartitionById(slots, F.col("slot"))
            .sortWithinPartitions("slot", F.col("payload").isNotNull()).mapInArrow(_search_trees(width, kind, k), _FOUND))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return (first.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op6_mtree_topk(spark, sf_dir: str) -> DataFrame:
    return top_products(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"),
                        lambda i: F.pmod(i, F.lit(50)) == 0)


QUERIES = {"op6_mtree_topk": op6_mtree_topk}
ORACLES = {"op6_mtree_topk": """
WITH p AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM p q JOIN p c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5"""}
