"""N-gram Jaccard join over count-vector R-trees.

A document's set holds its distinct word n-grams as 64-bit hashes. Two sets are
linked when ``den * |A & B| >= num * |A | B|``.

1. *Classes.* Documents with equal sets are one class (a *node*).
2. *Blocks.* For a pair of linked sets at most ``d`` hashes are in one set only
   (``d`` follows from the sizes). Hashes are dealt to more than ``d`` groups,
   so a linked pair has groups with equal, non-empty content; the digest of a
   group's content is a block key. Sizes are cut into bands, each with its own
   number of groups; a set near a band's upper end joins the next one too.
   Sets with so many empty groups that this guarantee fails also use the keys
   of a prefix filter among themselves, so no pair is lost.
3. *First links.* Each set is compared with the block hub that it meets most
   often; links form first components. A group of copies costs one comparison
   per copy, not one per pair.
4. *R-trees.* In blocks that still hold several components (blocks with the
   same members once), the sets' group counts (``COORDS`` coordinates) are
   points of an R-tree. The overlap of a set with a page is at most the sum of
   the smaller coordinate, against the page's upper corner; pages and points
   below the overlap that a link needs are skipped. First only a spanning
   forest of the surviving pairs, largest bounds first, is verified and joins
   components; then all surviving pairs that still lie between components.
5. *Verify.* Sets are intersected exactly; components are joined.

Scale: about a quarter of a set's size in rows (key, node) is shuffled, and the
texts once, of which only members of shared blocks go on. A block is streamed,
never gathered: its hub is the first of its sorted rows. Blocks with several
components are split into chunks of ``CHUNK`` nodes when large; hubs with many
partners are salted. Nothing but counts reaches the driver.

Defined results: a null text is an empty one; empty sets link with nothing and
are their own component; rows without id can be linked, their component is the
smallest id reached, or null; repeated rows and repeated ids stay (equal sets
are linked); an empty table gives an empty result; other columns are ignored.
Two different n-grams with one 64-bit hash would count as equal; two different
sets with one 64-bit node are detected and refused.
"""

from __future__ import annotations

from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import documents, release, ship_package, shuffle_partitions, staged, text_or_empty
from furrow.llm.components import components

COORDS = 256
PAGE = 64
FANOUT = 16
CHUNK = 4096
HUB_SPLIT = 4096
SPARE = 3  # empty groups that a set may have without fallback keys
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sets of word n-gram hashes; words are hashed once per task."""

    def __init__(self, k: int):
        self.k, self.words = k, {}

    def set_of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        known = self.words
        if len(known) > 2_000_000:
            known.clear()
        try:
            h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        k = min(self.k, len(words))
        n = len(words) - k + 1
        out = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            out = mix(out * _A + h[j:n + j])
        return np.unique(out)


@lru_cache(maxsize=16)
def bands(num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower ends of the size bands, and most differing hashes of a pair whose
    larger set lies in the band."""
    lows = [1]
    while lows[-1] < 1 << 40:
        lows.append(lows[-1] * den ** 3 // num ** 3 + 1)
    lows = np.array(lows, dtype=np.int64)
    return lows, 2 * (lows[1:] - 1) * (den - num) // (den + num)


def block_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Block keys of a set (sorted distinct uint64 hashes)."""
    n = len(s)
    if not n:
        return np.empty(0, dtype=np.int64)
    lows, differ = bands(num, den)
    own = int(np.searchsorted(lows, n, side="right")) - 1
    out, mixed = [], mix(s ^ _A)
    low, high = (mixed & np.uint64(0xFFFFFFFF)).astype(np.float64), (mixed >> np.uint64(32)).astype(np.float64)
    for band in (own, own + 1):
        if band == own + 1 and n * den < num * int(lows[band]):
            break
        d = int(differ[band])
        if d == 0:
            continue  # only equal sets, which are one class
        groups = d + 1 + SPARE
        g = (mix(s + np.uint64((band + 1) * int(_A) % (1 << 64))) % np.uint64(groups)).astype(np.int64)
        filled = np.bincount(g, minlength=groups) > 0
        digest = (np.bincount(g, weights=high, minlength=groups).astype(np.uint64) << np.uint64(32)) \
            + np.bincount(g, weights=low, minlength=groups).astype(np.uint64)
        number = np.arange(groups, dtype=np.uint64) + np.uint64(band << 34)
        out.append(mix(digest[filled] + mix(number[filled] * _A)))
        # Equal groups: at least groups - most, of which some may be empty.
        partner = min(n * den // num, int(lows[band + 1]) - 1)
        most = (n + max(n, partner)) * (den - num) // (den + num)
        if groups - int(filled.sum()) >= groups - most:
            prefix = s[:n - (num * n + den - 1) // den + 1]
            out.append(mix(prefix ^ mix(np.uint64([(band << 34) + (1 << 33)]))))
    if not out:
        return np.empty(0, dtype=np.int64)
    return np.concatenate(out).view(np.int64)


def _node(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set; the first one names its class."""
    data = s.tobytes()
    h = xxhash.xxh128_intdigest(data)
    a, b = h & (1 << 64) - 1, h >> 64
    return (a - (1 << 64) if a >> 63 else a), (b - (1 << 64) if b >> 63 else b)


_INFO = "doc_id bigint, rk bigint, n bigint, node bigint, other bigint"


def pack_counts(s: np.ndarray) -> bytes:
    """Group counts of a set, two bytes each, or four where that is too few."""
    c = np.bincount((s & np.uint64(COORDS - 1)).astype(np.int64), minlength=COORDS)
    return c.astype("<u2" if not len(s) or c.max() < 1 << 16 else "<u4").tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if len(data) == 2 * COORDS else "<u4").astype(np.int32)


def _describe(k: int):
    def run(batches):
        shingler = Shingler(k)
        for b in batches:
            sets = [shingler.set_of(t) for t in b["text"].to_pylist()]
            nodes = [_node(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["rk"], pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([x for x, _ in nodes], pa.int64()), pa.array([x for _, x in nodes], pa.int64())],
                names=["doc_id", "rk", "n", "node", "other"])
    return run


def _emit_keys(k: int, num: int, den: int):
    def run(batches):
        shingler, sent = Shingler(k), set()
        for b in batches:
            keys, nodes = [], []
            for t in b["text"].to_pylist():
                s = shingler.set_of(t)
                node = _node(s)[0]
                if node in sent:  # equal texts of a task speak once
                    continue
                sent.add(node)
                x = block_keys(s, num, den)
                keys.append(x)
                nodes.append(np.full(len(x), node, dtype=np.int64))
            if keys:
                key, node = np.concatenate(keys), np.concatenate(nodes)
                for i in range(0, len(key), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(key[i:i + (1 << 18)]), pa.array(node[i:i + (1 << 18)])],
                                                     names=["key", "node"])
    return run


def _shared_blocks(batches):
    """Sorted (key, node) rows -> (key, node, hub) of blocks with two nodes or
    more; the hub is a block's first node. Holds one batch and one open row."""
    open_key = hub = last = None
    alone = False  # the open block has one node so far, not yet given out
    for b in batches:
        key, node = b["key"].to_numpy(), b["node"].to_numpy()
        if not len(key):
            continue
        prev_key = np.concatenate([[0 if open_key is None else open_key], key[:-1]])
        prev_node = np.concatenate([[0 if last is None else last], node[:-1]])
        same = key == prev_key
        if open_key is None:
            same[0] = False
        fresh = ~(same & (node == prev_node))  # without repeated (key, node)
        k, v, cont = key[fresh], node[fresh], same[fresh]
        if not len(k):
            continue
        starts = np.flatnonzero(~cont)
        run = np.cumsum(~cont) - 1  # -1: still the block that was open
        hubs = np.where(run >= 0, v[starts[np.maximum(run, 0)]] if len(starts) else 0, 0 if hub is None else hub)
        follows = np.concatenate([cont[1:], [False]])
        give = cont | follows
        out = [(k[give], v[give], hubs[give])]
        if alone and cont[0]:
            out.insert(0, (k[:1], np.array([hub]), np.array([hub])))
        if len(starts):
            alone = bool(starts[-1] == len(k) - 1)
            hub = int(v[starts[-1]])
        elif len(k):
            alone = False
        open_key, last = int(k[-1]), int(v[-1])
        rows = [np.concatenate([o[i] for o in out]).astype(np.int64) for i in range(3)]
        if len(rows[0]):
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["key", "node", "hub"])


def needed(a, b, num: int, den: int):
    """Least overlap of linked sets of sizes a and b."""
    return (num * (a + b) + num + den - 1) // (num + den)


class RTree:
    """Packed R-tree over group counts, ordered by size; nodes keep their upper
    corner and the smallest and largest size below them."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, num: int, den: int):
        self.order = np.lexsort((counts[:, 0], sizes))
        self.sizes, self.counts = sizes[self.order], counts[self.order]
        self.num, self.den, self.levels = num, den, []
        step, n = PAGE, len(sizes)
        high, low, top = self.counts, self.sizes, self.sizes
        width = PAGE
        while True:
            at = np.arange(0, len(low), width)
            high, low, top = (np.maximum.reduceat(high, at), np.minimum.reduceat(low, at), np.maximum.reduceat(top, at))
            self.levels.append((step, high, low, top))
            if len(at) == 1:
                break
            width, step = FANOUT, step * FANOUT
        self.n = n

    def search(self, sizes: np.ndarray, counts: np.ndarray):
        """Yield (query positions, point positions, bound above the needed
        overlap) of surviving pairs."""
        stack = [(len(self.levels) - 1, 0, np.arange(len(sizes)))]
        while stack:
            level, i, q = stack.pop()
            step, high, low, top = self.levels[level]
            s = sizes[q]
            least = np.maximum(low[i], (self.num * s + self.den - 1) // self.den)
            bound = np.minimum(counts[q], high[i]).sum(axis=1)
            q = q[(bound >= needed(s, least, self.num, self.den)) & (self.num * int(low[i]) <= self.den * s)
                  & (self.num * s <= self.den * int(top[i]))]
            if not len(q):
                continue
            if level:
                below = len(self.levels[level - 1][1])
                stack += [(level - 1, c, q) for c in range(i * FANOUT, min((i + 1) * FANOUT, below))]
                continue
            p = np.arange(i * step, min((i + 1) * step, self.n))
            for part in np.array_split(q, max(1, len(q) // 64)):
                overlap = np.minimum(counts[part][:, None, :], self.counts[p][None, :, :]).sum(axis=2)
                spare = overlap - needed(sizes[part][:, None], self.sizes[p][None, :], self.num, self.den)
                a, b = np.nonzero(spare >= 0)
                yield part[a], self.order[p[b]], spare[a, b]


def spanning_forest(roots_a: np.ndarray, roots_b: np.ndarray, spare: np.ndarray) -> list[int]:
    """Positions of pairs that join the given components, largest first."""
    above: dict[int, int] = {}

    def top(x):
        while x in above:
            if above[x] in above:
                above[x] = above[above[x]]
            x = above[x]
        return x

    out = []
    order = np.argsort(-spare, kind="stable")
    for i, x, y in zip(order.tolist(), roots_a[order].tolist(), roots_b[order].tolist()):
        x, y = top(x), top(y)
        if x != y:
            above[max(x, y)] = min(x, y)
            out.append(i)
    return out


def _tree_pairs(num: int, den: int, forest: bool):
    """Rows of chunk pairs (cell, side, node, root, n, counts) -> node pairs of
    different components that pass the R-tree's bounds: all of them, or a
    spanning forest over the components."""
    def pairs(rows):
        nodes, roots, sizes, side = (np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 2, 3, 0))
        counts = np.stack([unpack_counts(r[4]) for r in rows])
        here, there = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(here) or not len(there):
            return
        tree = RTree(sizes[there], counts[there], num, den)
        found = []
        for q, p, spare in tree.search(sizes[here], counts[here]):
            a, b = here[q], there[p]
            keep = (roots[a] != roots[b]) & ((nodes[a] > nodes[b]) | (side[a] != 2))
            a, b, spare = a[keep], b[keep], spare[keep]
            if forest:
                at = spanning_forest(roots[a], roots[b], spare)
                found.append((a[at], b[at], spare[at]))
            elif len(a):
                yield _pair_rows(nodes[a], nodes[b])
        if found:
            a, b, spare = (np.concatenate([f[i] for f in found]) for i in range(3))
            at = spanning_forest(roots[a], roots[b], spare)
            if at:
                yield _pair_rows(nodes[a[at]], nodes[b[at]])

    def run(batches):
        cell, rows = None, []
        for b in batches:
            for c, *row in zip(*(b[x].to_pylist() for x in ("cell", "side", "node", "root", "n", "counts"))):
                if c != cell:
                    if rows:
                        yield from pairs(rows)
                    cell, rows = c, []
                rows.append(row)
        if rows:
            yield from pairs(rows)
    return run


def _pair_rows(a: np.ndarray, b: np.ndarray):
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])


def _distinct_blocks(blocks: DataFrame) -> DataFrame:
    """(key, node): of blocks with the same members, one."""
    per = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("a"),
                                    F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("b"))
    keep = per.groupBy("m", "a", "b").agg(F.min("key").alias("key")).select("key")
    return blocks.select("key", "node").join(keep, "key", "left_semi")


def _residual_pairs(blocks: DataFrame, sets: DataFrame, roots: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """Pairs inside blocks whose nodes are not yet in one component."""
    parts = shuffle_partitions(blocks)
    named = blocks.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_blocks = (named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m"))
                   .filter("lo <> hi").select("key", F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks")))
    members = named.join(open_blocks, "key").join(sets.select("node", "n", "counts").hint("merge"), "node")
    # Chunks i <= j of a block meet in the cell (key, i, j): rows of chunk i on
    # side 0, of j on side 1; a chunk with itself on side 2 (both).
    i = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    cells = (members.withColumn("i", i).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select(F.concat_ws("/", "key", F.least("i", "j"), F.greatest("i", "j")).alias("cell"),
                     F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1).alias("side"),
                     "node", "root", "n", "counts"))
    found = cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_tree_pairs(num, den, forest), "u bigint, v bigint")
    return found.distinct()


def _to_sets(k: int):
    def run(batches):
        shingler, sent = Shingler(k), set()
        for b in batches:
            fresh = [i for i, node in enumerate(b["node"].to_pylist()) if not (node in sent or sent.add(node))]
            b = b.take(pa.array(fresh, pa.int64()))  # repeated rows have one node
            sets = [shingler.set_of(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["node"], pa.array([len(s) for s in sets], pa.int64()), pa.array([pack_counts(s) for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "n", "counts", "hashes"])
    return run


def _verify(num: int, den: int):
    """Rows (hub, cell, first, node, hashes), a hub's own set first -> links."""
    def run(batches):
        cell, own = None, None
        for b in batches:
            u, v = [], []
            for c, first, hub, node, data in zip(*(b[x].to_pylist() for x in ("cell", "first", "hub", "node", "hashes"))):
                if first:
                    cell, own = c, np.frombuffer(data, dtype=np.uint64)
                    continue
                if c != cell:
                    raise ValueError("a hub's set is missing")
                s = np.frombuffer(data, dtype=np.uint64)
                both = np.concatenate([own, s])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                if den * same >= num * (len(both) - same):
                    u.append(node)
                    v.append(hub)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
    return run


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (u, v), v the hub, whose sets are linked."""
    parts = shuffle_partitions(pairs)
    many = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / HUB_SPLIT).cast("int").alias("salts"))
    partners = pairs.join(many, "v").select(
        F.lit(False).alias("first"), F.col("v").alias("hub"), F.col("u").alias("node"),
        F.pmod(F.xxhash64("u"), F.col("salts")).cast("int").alias("salt"))
    hubs = many.select(F.lit(True).alias("first"), F.col("v").alias("hub"), F.col("v").alias("node"),
                       F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = partners.unionByName(hubs).join(sets.select("node", "hashes").hint("merge"), "node").withColumn("cell", F.concat_ws("/", "hub", "salt"))
    return (rows.select("cell", "first", "hub", "node", "hashes").repartition(parts, "cell")
            .sortWithinPartitions("cell", F.col("first").desc()).mapInArrow(_verify(num, den), "u bigint, v bigint"))


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: doc_id, rk (hash of id and text), n (set
    size), node, root (smallest node of its component) and component_id."""
    ship_package(docs.sparkSession)
    num, den = num // gcd(num, den), den // gcd(num, den)
    parts = shuffle_partitions(docs)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                        F.xxhash64("doc_id", text_or_empty()).alias("rk"), text_or_empty().alias("text"))
    info = staged(texts.mapInArrow(_describe(k), _INFO), "join-info")
    classes = staged(info.filter("n > 0").groupBy("node").agg(
        F.min("rk").alias("rk"), (F.min("other") == F.max("other")).alias("one")), "join-classes")
    if classes.filter("not one").limit(1).count():
        raise ValueError("two sets share a 64-bit digest")
    keyed = texts.select("text").mapInArrow(_emit_keys(k, num, den), "key bigint, node bigint")
    every = staged(keyed.repartition(parts, "key").sortWithinPartitions("key", "node")
                   .mapInArrow(_shared_blocks, "key bigint, node bigint, hub bigint"), "join-blocks")

    met = every.filter("node <> hub").groupBy("node", "hub").count()
    first = staged(met.groupBy("node").agg(F.max_by("hub", F.struct("count", -F.col("hub") / 2)).alias("v")), "join-first")
    members = every.select("node").distinct().join(classes.select("node", "rk"), "node")
    # merge: nothing joined here has a size bound, so no plan depends on size
    sets = staged(members.hint("merge").join(texts.select("rk", "text"), "rk").select("node", "text")
                  .mapInArrow(_to_sets(k), "node bigint, n bigint, counts binary, hashes binary"), "join-sets")
    blocks = staged(_distinct_blocks(every), "join-distinct")
    release(every, classes)
    written = [staged(_linked(first.select(F.col("node").alias("u"), "v"), sets, num, den).distinct(), "join-links")]
    release(first)
    links = written[0]
    for forest in (True, False):
        roots = components(links)
        pairs = staged(_residual_pairs(blocks, sets, roots, num, den, forest), "join-pairs")
        written.append(staged(_linked(pairs, sets, num, den), "join-links"))
        links = links.unionByName(written[-1])
        release(roots, pairs)
    release(sets, blocks)
    roots = components(links)
    release(*written)

    named = info.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "root", "left").select(
        "doc_id", "rk", "n", "node", "root",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of each component stays (the smallest id, ids before null);
    rows without words stay all. All columns are kept."""
    found = jaccard_components(docs, k, num, den)
    best = found.filter("n > 0").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", "rk")).alias("b")).select("b.rk")
    keep = best.withColumnRenamed("rk", "_rk")
    is_empty = F.trim(text_or_empty(), F.lit(" \t\n\x0b\x0c\r")) == ""
    # Rows that are equal in id and text are one document, unless empty.
    rows = docs.filter(~is_empty).select(F.struct(*docs.columns).alias("_row"), F.xxhash64("doc_id", text_or_empty()).alias("_rk"))
    # inner, as a semi-join would run before the aggregate; keep has each once
    kept = rows.groupBy("_rk").agg(F.first("_row").alias("_row")).join(keep, "_rk")
    return kept.select("_row.*").unionByName(docs.filter(is_empty))


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), 4, 85, 100).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")


QUERIES = {"op8_ngram_jaccard": op8_ngram_jaccard}
ORACLES = {"op8_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' ' || len(w)] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 85 * (x.n + y.n - same)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b),
c AS (SELECT a, least(a, min(b)) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id"""}
