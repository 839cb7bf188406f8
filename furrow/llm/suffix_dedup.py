"""Repeated passages: suffix arrays by two-stage sorting, over anchored spans.

A byte is removed when it lies in a string of ``WINDOW`` bytes that also starts
anywhere else in the corpus. Windows, not documents, decide, on the input.

1. *Anchors.* Of the ``GRAM``-byte hashes inside a window the smallest (the
   rightmost of equals) is its anchor. Equal windows have equal anchors at the
   same place, so only windows that share an anchor hash can be equal. The
   windows of one anchor are neighbours: their *span* is the text they cover.
2. *Equal spans.* Spans are shuffled by anchor hash as digests. An anchor seen
   once is dropped; windows of spans that occur twice are repeated. A task that
   has sent a span twice knows that its windows are repeated: further
   occurrences go past the anchors, spread evenly, so a line that a third of
   all texts hold does not fill one task.
3. *Suffix arrays.* Anchors with different spans (the edges of a repeated
   passage) send one copy of each span. The spans of an anchor are
   concatenated and their suffixes sorted in two stages: only the suffixes
   smaller than their successors are sorted directly, the others are induced
   by one scan of the buckets. Neighbours with a common prefix of ``WINDOW``
   bytes are repeated windows.
4. *Removal.* Repeated windows are joined to intervals and cut out.

Equal texts are one text for 1 to 3 (a task sends it once); a text that two
rows hold is repeated as a whole.

Scale: one row per about ``(WINDOW - GRAM) / 2`` bytes is shuffled, and the
texts twice (to fetch spans, and to remove). An anchor's rows are streamed, two
rows of state, however many there are. Spans are sorted in batches of
``BATCH_BYTES``; an anchor with more spans than that is cut by the windows'
own digests, which needs no sorting at all. Nothing is collected.

Defined results: a null text is empty; texts shorter than a window keep
everything; repeated rows are occurrences of their own; null ids stay; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import documents, ship_package, shuffle_partitions, staged, text_or_empty

WINDOW = 200
GRAM = 40
BATCH_BYTES = 4_000_000
SLOTS = 1 << 20
_BASE = 0x2545F4914F6CDD1D
_powers: list[np.ndarray] = []


def _power_tables(n: int):
    if not _powers or len(_powers[0]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        _powers[:] = [np.cumprod(np.full(size, b, dtype=np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-byte strings, as differences of a prefix sum."""
    up, down = _power_tables(len(data))
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=prefix[1:])
    h = (prefix[k:] - prefix[:-k]) * down[:len(data) - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(hash, first window, last window, place) of each anchor of a text, the
    place counted from the first window's start."""
    n = len(data) - window + 1
    if n <= 0:
        return None
    h = gram_hashes(data, gram)
    m = len(h)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m - 1, -1, -1, dtype=np.uint64)
    w, span = window - gram + 1, 1
    while span * 2 <= w:
        low = np.minimum(low[:len(low) - span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[:len(low) - (w - span)], low[w - span:])
    at = m - 1 - (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    place = at[first]
    return h[place].view(np.int64), first, last, place - first


# A row's windows: 40 bits of start, 12 bits of count - 1, 12 bits of place.
def _pack(first, last, place):
    return (first << 24) | ((last - first) << 12) | place


def _unpack(packed):
    return packed >> 24, (packed >> 12) & 0xFFF


class SentTwice:
    """Which (anchor, span) pairs this task has sent twice. One slot per hash:
    a pair that another one pushes out is sent twice again, which is harmless."""

    def __init__(self, slots: int = SLOTS):
        self.slots = np.uint64(slots - 1)
        self.h, self.span = np.zeros(slots, dtype=np.int64), np.zeros(slots, dtype=np.int64)
        self.times = np.zeros(slots, dtype=np.int8)

    def add(self, h: np.ndarray, span: np.ndarray) -> np.ndarray:
        """True for the pairs that need not be sent."""
        at = ((h.view(np.uint64) ^ span.view(np.uint64)) & self.slots).astype(np.int64)
        known = (self.h[at] == h) & (self.span[at] == span)
        times = np.where(known, self.times[at], 0)
        new = np.flatnonzero(times < 2)
        _, one = np.unique(at[new], return_index=True)  # one pair for each slot
        new = new[one]
        self.h[at[new]], self.span[at[new]], self.times[at[new]] = h[new], span[new], times[new] + 1
        return times >= 2


def _send_anchors(window: int, gram: int):
    """Rows (deal, past, h, span, node, packed): dealt by anchor, or (past) by
    text where the span is known to be repeated."""
    def run(batches):
        sent, twice = set(), SentTwice()
        for b in batches:
            out = [[], [], [], []]
            for text, node in zip(b["text"].to_pylist(), b["node"].to_pylist()):
                if node in sent:
                    continue
                sent.add(node)
                raw = text.encode("utf-8", "surrogatepass")
                found = anchors(np.frombuffer(raw, dtype=np.uint8), window, gram)
                if found is None:
                    continue
                h, first, last, place = found
                digests = [xxhash.xxh3_64_intdigest(raw[i:j + window], p) for i, j, p in
                           zip(first.tolist(), last.tolist(), place.tolist())]
                out[0].append(h)
                out[1].append(np.array(digests, dtype=np.uint64).view(np.int64))
                out[2].append(np.full(len(h), node, dtype=np.int64))
                out[3].append(_pack(first, last, place))
            if out[0]:
                h, span, node, packed = (np.concatenate(x) for x in out)
                past = np.concatenate([twice.add(x, y) for x, y in zip(out[0], out[1])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (np.where(past, node, h), past, h, span, node, packed)],
                    names=["deal", "past", "h", "span", "node", "packed"])
    return run


def _compare_spans(batches):
    """Sorted anchor rows -> (open, h, node, packed): rows of repeated spans
    (open 0), and one row of each span of an anchor with several (open 1)."""
    before = None  # the last row
    waiting = None  # the last row, while its span has occurred once
    lead = None  # first row of the last span, while it is its anchor's only one
    for b in batches:
        past = b.filter(b["past"])
        if past.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(past.num_rows, dtype=np.int32)), past["h"], past["node"], past["packed"]],
                                             names=["open", "h", "node", "packed"])
            b = b.filter(pc.invert(b["past"]))
        if not b.num_rows:
            continue
        rows = np.stack([b[c].to_numpy() for c in ("h", "span", "node", "packed")])
        prev = np.concatenate([(rows[:, :1] + 1 if before is None else before), rows[:, :-1]], axis=1)
        rows = rows[:, (rows != prev).any(axis=0)]  # a text that two tasks sent
        if not rows.shape[1]:
            continue
        prev = np.concatenate([(rows[:, :1] + 1 if before is None else before), rows[:, :-1]], axis=1)
        same_h = rows[0] == prev[0]
        same_span = same_h & (rows[1] == prev[1])
        give, several = [], []
        if waiting is not None and same_span[0]:
            give.append(waiting)
        after = np.concatenate([same_span[1:], [False]])
        give.append(rows[:, same_span | after])
        waiting = None if same_span[-1] else rows[:, -1:]
        starts = np.flatnonzero(~same_span)
        if len(starts):
            if lead is not None and same_h[starts[0]]:
                several.append(lead)
            more = same_h[starts] | np.concatenate([same_h[starts[1:]], [False]])
            several.append(rows[:, starts[more]])
            lead = None if more[-1] else rows[:, starts[-1:]]
        before = rows[:, -1:]
        for flag, part in ((0, give), (1, several)):
            r = np.concatenate(part, axis=1) if part else rows[:, :0]
            if r.shape[1]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(r.shape[1], flag, dtype=np.int32)), pa.array(r[0]), pa.array(r[2]), pa.array(r[3])],
                    names=["open", "h", "node", "packed"])


def _fetch_spans(window: int):
    """Rows (text, node, [(h, packed)]) -> one row per span with its bytes."""
    def run(batches):
        for b in batches:
            out = []
            for text, node, wanted in zip(b["text"].to_pylist(), b["node"].to_pylist(), b["wanted"].to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    first, count = _unpack(w["packed"])
                    out.append((w["h"], node, w["packed"], raw[first:first + count + window]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    names=["h", "node", "packed", "bytes"])
    return run


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor (the empty suffix at
    the end is the smallest of all)."""
    n = len(t)
    rises = np.zeros(n, dtype=np.int8)
    rises[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1])
    rises[-1] = -1
    # equal neighbours take the next differing step's sign
    at = np.where(rises != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return rises[at] > 0


def _words(t: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each position on as one number."""
    padded = np.concatenate([t, np.zeros(depth + 16, dtype=np.uint8)])
    w = np.zeros(len(t) + depth + 8, dtype=np.uint64)
    for i in range(8):
        w = (w << np.uint64(8)) | padded[i:i + len(w)]
    return w


def direct_sort(words: np.ndarray, which: np.ndarray, depth: int) -> np.ndarray:
    """Sort the suffixes ``which`` by their first ``depth`` bytes: eight bytes
    at a time, each time only those that are still tied."""
    order = which[np.argsort(words[which], kind="stable")]
    key = words[order]
    tied = np.zeros(len(order), dtype=bool)
    same = key[1:] == key[:-1]
    tied[1:] |= same
    tied[:-1] |= same
    group = np.cumsum(np.concatenate([[True], ~same])) if len(order) else np.empty(0, np.int64)
    for d in range(8, depth, 8):
        at = np.flatnonzero(tied)
        if not len(at):
            break
        g, key = group[at], words[order[at] + d]
        by = np.lexsort((key, g))
        order[at] = order[at][by]
        key = key[by]
        g2 = g[by]
        same = (key[1:] == key[:-1]) & (g2[1:] == g2[:-1])
        group[at] = np.cumsum(np.concatenate([[True], ~same]))
        still = np.zeros(len(at), dtype=bool)
        still[1:] |= same
        still[:-1] |= same
        tied[at] = still
    return order


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of at least their first ``depth`` bytes.

    Stage one sorts the suffixes smaller than their successors. Stage two scans
    the buckets (by first byte) from the smallest on: a suffix whose successor
    has its place, and is smaller, goes to the next free place at its bucket's
    front. A bucket is finished when the scan reaches it, but for runs of its
    own byte, which are added wave by wave.
    """
    n = len(t)
    if not n:
        return np.empty(0, dtype=np.int64)
    small = suffix_types(t)
    words = _words(t, depth + 8)
    sorted_small = direct_sort(words, np.flatnonzero(small), depth + 8)
    small_by = np.searchsorted(t[sorted_small], np.arange(257)) if len(sorted_small) else np.zeros(257, dtype=np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[n - 1]].append(np.array([n - 1], dtype=np.int64))  # its successor is the empty suffix
    out = []
    for c in np.flatnonzero(np.bincount(t, minlength=256)):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, dtype=np.int64)
        induced = []
        while len(wave):
            induced.append(wave)
            p = wave[wave > 0] - 1
            wave = p[(t[p] == c) & ~small[p]]
        bucket = np.concatenate([*induced, sorted_small[small_by[c]:small_by[c + 1]]])
        out.append(bucket)
        p = bucket[bucket > 0] - 1
        p = p[t[p] > c]  # larger first byte: larger than their successors
        first = t[p]
        by = np.argsort(first, kind="stable")
        first, p = first[by], p[by]
        cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(p) else []
        for i, j in zip(cuts, [*cuts[1:], len(p)]):
            waiting[first[i]].append(p[i:j])
    return np.concatenate(out)


def repeated_starts(spans: list[bytes], counts: list[int], window: int) -> list[np.ndarray]:
    """For each span, which of its first ``counts`` positions start a window
    that also starts at such a position elsewhere."""
    t = np.frombuffer(b"".join(spans), dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
    starts = np.zeros(len(t), dtype=bool)
    for i, n in enumerate(counts):
        starts[begin[i]:begin[i] + n] = True
    order = suffix_array(t, window)
    order = order[starts[order]]
    words = _words(t, window + 8)
    a, b = order[:-1], order[1:]
    alive = np.arange(len(a))
    for d in [*range(0, window - 7, 8), window - 8]:  # common prefix of neighbours
        alive = alive[words[a[alive] + d] == words[b[alive] + d]]
    hit = np.zeros(len(t), dtype=bool)
    hit[a[alive]] = True
    hit[b[alive]] = True
    return [np.flatnonzero(hit[begin[i]:begin[i] + n]) for i, n in enumerate(counts)]


def _sort_spans(window: int, batch_bytes: int):
    def intervals(rows):
        counts = [_unpack(packed)[1] + 1 for _, packed, _ in rows]
        nodes, starts, ends = [], [], []
        for (node, packed, _), at in zip(rows, repeated_starts([r[2] for r in rows], counts, window)):
            if not len(at):
                continue
            first = _unpack(packed)[0]
            cut = np.flatnonzero(np.diff(at) > 1)
            for i, j in zip(np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(at) - 1]])):
                nodes.append(node)
                starts.append(first + int(at[i]))
                ends.append(first + int(at[j]) + window)
        return _interval_rows(nodes, starts, ends)

    def run(batches):
        rows, size, last = [], 0, None
        for b in batches:
            for h, node, packed, data in zip(*(b[c].to_pylist() for c in ("h", "node", "packed", "bytes"))):
                if h != last:
                    if size >= batch_bytes:
                        yield intervals(rows)
                        rows, size = [], 0
                    last = h
                rows.append((node, packed, data))
                size += len(data)
        if rows:
            yield intervals(rows)
    return run


def _interval_rows(nodes, starts, ends):
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                                      names=["node", "start", "end"])


def _window_digests(window: int):
    """Spans of a crowded anchor -> one row per window."""
    def run(batches):
        for b in batches:
            out = [[], [], []]
            for node, packed, data in zip(*(b[c].to_pylist() for c in ("node", "packed", "bytes"))):
                first, count = _unpack(packed)
                for i in range(count + 1):
                    out[0].append(hashlib.blake2b(data[i:i + window], digest_size=16).digest())
                    out[1].append(node)
                    out[2].append(first + i)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())],
                                             names=["digest", "node", "start"])
    return run


def _cut(window: int):
    """Rows (doc_id, text, whole, intervals) -> kept bytes and figures."""
    def run(batches):
        for b in batches:
            out = []
            for doc_id, text, whole, spans in zip(*(b[c].to_pylist() for c in ("doc_id", "text", "whole", "intervals"))):
                raw = text.encode("utf-8", "surrogatepass")
                if whole:
                    spans = [(0, len(raw))]
                merged: list[list[int]] = []
                for s, e in sorted((x if whole else (x["start"], x["end"])) for x in spans or []):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                kept, at = [], 0
                for s, e in merged:
                    kept.append(raw[at:s])
                    at = e
                kept.append(raw[at:])
                out.append((doc_id, len(raw), sum(e - s for s, e in merged), len(merged), b"".join(kept)))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs) and ``kept`` (the remaining bytes)."""
    ship_package(docs.sparkSession)
    parts = shuffle_partitions(docs)
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("node"),
                       F.xxhash64("doc_id", text).alias("rk"))
    info = staged(rows.select("node", "rk", F.octet_length("text").alias("n"), F.xxhash64(F.lit(1), "text").alias("other"))
                  .filter(F.col("n") >= window), "repeat-info")
    texts = staged(info.groupBy("node").agg(F.count(F.lit(1)).alias("rows"), F.min("rk").alias("rk"),
                                            (F.min("other") == F.max("other")).alias("one")), "repeat-texts")
    if texts.filter("not one").limit(1).count():
        raise ValueError("two texts share a 64-bit digest")
    sent = rows.select("text", "node").mapInArrow(_send_anchors(window, gram), "deal bigint, past boolean, h bigint, span bigint, node bigint, packed bigint")
    found = staged(sent.repartition(parts, "deal").sortWithinPartitions("past", "h", "span", "node", "packed")
                   .mapInArrow(_compare_spans, "open int, h bigint, node bigint, packed bigint"), "repeat-anchors")

    edges = found.filter("open = 1").select("h", "node", "packed")
    wanted = (edges.join(texts.select("node", "rk"), "node").groupBy("rk", "node")
              .agg(F.collect_list(F.struct("h", "packed")).alias("wanted")))
    spans = staged(wanted.join(rows.select("rk", "text"), "rk")
                   .select("text", "node", "wanted")
                   .mapInArrow(_fetch_spans(window), "h bigint, node bigint, packed bigint, bytes binary"), "repeat-spans")
    crowded = spans.groupBy("h").agg(F.sum(F.octet_length("bytes")).alias("size")).filter(F.col("size") > batch_bytes).select("h")
    few = spans.join(crowded, "h", "left_anti")
    sorted_out = few.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(
        _sort_spans(window, batch_bytes), "node bigint, start bigint, end bigint")
    windows = spans.join(crowded, "h", "left_semi").mapInArrow(
        _window_digests(window), "digest binary, node bigint, start bigint")
    twice = windows.groupBy("digest").agg(F.min(F.struct("node", "start")).alias("a"), F.max(F.struct("node", "start")).alias("b")) \
        .filter("a <> b").select("digest")
    apart = windows.join(twice, "digest", "left_semi").select("node", "start", (F.col("start") + window).alias("end"))
    start = F.shiftright("packed", 24)
    equal = found.filter("open = 0").select(
        "node", start.alias("start"), (start + F.shiftright("packed", 12).bitwiseAND(0xFFF) + window).alias("end"))
    intervals = equal.unionByName(sorted_out).unionByName(apart).groupBy("node").agg(
        F.collect_list(F.struct("start", "end")).alias("intervals"))

    # Texts of one row take their intervals; those of several rows go whole.
    alone = texts.filter("rows = 1").select("node", "rk").join(intervals, "node").select("rk", "intervals")
    whole = info.join(texts.filter("rows > 1").select("node"), "node", "left_semi").select("rk").distinct()
    decided = alone.withColumn("whole", F.lit(False)).unionByName(
        whole.withColumn("whole", F.lit(True)), allowMissingColumns=True)
    return (rows.join(decided, "rk", "left")
            .select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "intervals")
            .mapInArrow(_cut(window), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"))


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
