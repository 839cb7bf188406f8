"""Document fingerprints by winnowing.

Every k-gram of code points is hashed with a rolling hash; of every window of
``WINDOW`` consecutive hashes the smallest is kept, the rightmost of equal
ones, with its position. Two texts that share a passage of at least
``GRAM + WINDOW - 1`` = 15 code points share a kept hash (the match guarantee),
so a text of 30 code points of which half is kept has a likeness above 0. A
text shorter than a k-gram is one gram; one with fewer grams than a window is
one window.

Scale: ``fingerprint_texts`` is narrow. The query also needs each document's
next one by descending id: ids are cut into ranges by quantiles of the ids
alone, the first document of each range is sent to the range before it as
well, and each range is streamed in order by one task - one shuffle of the
texts, no window over whole tables.

Defined results: a null text is an empty one; an empty text has the empty
fingerprint, which is like itself (1.0) and unlike any other (0.0); a null id
sorts after all others; rows with the same id are ordered by two hashes of
their texts; repeated rows stay; a single document is its own next;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import documents, ship_package, shuffle_partitions, text_or_empty

GRAM = 8
WINDOW = 8
CHUNK = 512  # rows of a result batch
_BASE = 0x5851F42D4C957F2D | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, at least ``n``."""
    if not _powers or len(_powers[0][0]) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        up = np.cumprod(np.full(size, _BASE, dtype=np.uint64))
        down = np.cumprod(np.full(size, _INVERSE, dtype=np.uint64))
        _powers[0] = (up, down)
    return _powers[0]


def gram_hashes(cp: np.ndarray, k: int = GRAM) -> np.ndarray:
    """32-bit hashes of all k-grams: differences of one prefix sum."""
    k = min(k, len(cp))
    up, down = _power_table(len(cp))
    prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((cp + np.uint64(1)) * up[:len(cp)])])
    h = (prefix[k:] - prefix[:-k]) * down[:len(cp) - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(32)).astype(np.uint32)


def winnow(cp: np.ndarray, k: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) kept for a text given as code points."""
    if not len(cp):
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    h = gram_hashes(cp, k)
    n = len(h)
    # Smaller hash first, then the larger position: the minimum of these keys
    # is the rightmost of the smallest hashes.
    key = (h.astype(np.uint64) << np.uint64(32)) | np.arange(n - 1, -1, -1, dtype=np.uint64)
    w = min(window, n)
    span, low = 1, key
    while span * 2 <= w:
        low = np.minimum(low[:len(low) - span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[:len(low) - (w - span)], low[w - span:])
    kept = low[np.concatenate([[True], low[1:] != low[:-1]])]
    pos = (n - 1 - (kept & np.uint64(0xFFFFFFFF)).astype(np.int64)).astype(np.uint32)
    return h[pos], pos


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def encode(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Hexadecimal (hash, position) pairs, 16 digits each."""
    return np.stack([hashes, positions], axis=1).astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of kept hashes."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same)


def fingerprint_texts(docs: DataFrame, k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add ``fingerprint`` (in place of a column of that name) to any frame
    with a ``text`` column."""
    docs = docs.drop("fingerprint")
    ship_package(docs.sparkSession)
    schema = docs.select("*", F.lit("").alias("fingerprint")).schema

    def run(batches):
        for b in (b.slice(i, CHUNK) for b in batches for i in range(0, b.num_rows, CHUNK)):
            prints = [encode(*winnow(code_points(t or ""), k, window)) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints, pa.string())],
                                             names=[*b.schema.names, "fingerprint"])

    return docs.mapInArrow(run, schema)


def _place(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are not below ``value``: those of whole
    stretches first, then those of the one stretch in which it lies."""
    step = max(1, int(len(cuts) ** 0.5))
    stretches = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    if not stretches:
        return F.lit(0)
    ends = F.array(*[F.lit(x[-1]).cast("bigint") for x in stretches])
    whole = F.array(*[F.array(*[F.lit(c).cast("bigint") for c in x]) for x in stretches])
    below = F.size(F.filter(ends, lambda e: e < value))  # stretches wholly below
    inside = F.coalesce(F.size(F.filter(F.get(whole, below), lambda c: c < value)), F.lit(0))
    return F.lit(len(cuts)) - below * step - F.when(below < len(stretches), inside).otherwise(
        F.lit(len(cuts) - step * len(stretches)))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, extra, doc_id, text): ranges of descending ids, each with
    the first row after it (``extra``), one range to a task, sorted."""
    parts = shuffle_partitions(docs)
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    shares = [i / parts for i in range(1, parts)]
    cuts = (rows.agg(F.percentile_approx("doc_id", shares, 10000)).first()[0] or []) if shares else []
    cuts = sorted(set(cuts))
    # parts run by descending id
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(_place(F.col("doc_id"), cuts))
    rows = rows.select("doc_id", "text", part.cast("int").alias("part"), F.struct(
        F.col("doc_id").isNull().alias("n"), F.bitwise_not("doc_id").alias("d"), F.xxhash64("text").alias("a"),
        F.xxhash64(F.lit(1), "text").alias("b")).alias("rank"))
    # One row per part, at most parts + 1: the row that each part begins with.
    found = {r["part"]: r["rank"] for r in rows.groupBy("part").agg(F.min("rank").alias("rank")).collect()}
    if not found:
        return rows.select("part", F.lit(0).alias("extra"), "doc_id", "text")
    order = sorted(found)
    before = {p: order[i - 1] for i, p in enumerate(order)}  # the first's goes to the last

    def of_part(values: dict, kind: str) -> Column:
        return F.get(F.array(*[F.lit(values.get(p)).cast(kind) for p in range(order[-1] + 1)]), F.col("part"))

    is_head = F.lit(True)
    for field in ("d", "a", "b"):
        is_head = is_head & F.col(f"rank.{field}").eqNullSafe(of_part({p: r[field] for p, r in found.items()}, "bigint"))
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("extra"))
    targets = F.when(is_head, F.array(own, F.struct(of_part(before, "int").alias("part"), F.lit(1).alias("extra")))).otherwise(F.array(own))
    sent = rows.withColumn("t", F.explode(targets)).select("t.part", "t.extra", "doc_id", "text")
    return sent.repartitionById(parts, F.pmod("part", F.lit(parts))).sortWithinPartitions(
        "part", "extra", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))


def edited_with_next(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of the next text's start."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _pairs(batches):
    last = None  # (part, doc_id, text, print) waiting for its next
    out = []

    def finish(follow_text, follow_print):
        _, doc_id, text, own = last
        edited = edited_with_next(text, follow_text)
        changed = winnow(code_points(edited))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                    encode(*own), encode(*changed), likeness(own[0], changed[0]), likeness(own[0], follow_print[0])))

    closed = None
    for b in (b.slice(i, CHUNK) for b in batches for i in range(0, b.num_rows, CHUNK)):
        for part, extra, doc_id, text in zip(*(b[c].to_pylist() for c in ("part", "extra", "doc_id", "text"))):
            if closed == part:
                continue  # equal heads were sent once each; one is enough
            own = last[3] if last and last[2] == text else winnow(code_points(text))
            if last is not None:
                finish(text, own)
            last, closed = (None, part) if extra else ((part, doc_id, text, own), None)
        if out:
            yield _result(out)
            out.clear()
    if out:
        yield _result(out)


_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _result(out):
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every text, its edited text and its next document."""
    ship_package(docs.sparkSession)
    return with_next(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).select(
        "part", "extra", "doc_id", "text").mapInArrow(_pairs, _SCHEMA)


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(documents(spark, sf_dir))


QUERIES = {"op5_fingerprints": op5_fingerprints}
