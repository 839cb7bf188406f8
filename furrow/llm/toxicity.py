"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

Features are the distinct character n-grams of a text (lower case, white space
runs as one space), hashed to ``2 ** BITS`` buckets. Over *all* labelled
training documents the toxic and other documents per bucket are counted; the
log-count ratio of a bucket scales its feature. Buckets of fewer than
``MIN_DOCS`` labelled documents, or with a ratio below ``MIN_RATIO`` either
way, tell the classes no better than chance and are left out. A logistic
regression on the scaled features is fitted on a bounded sample of labelled
documents (at most ``sample_per_class`` of each class, those with the smallest
hash of the id, and of them as many, in the order of a hash, as hold
``SAMPLE_BYTES`` of features; weighted back to the classes' true shares), and
every whole text is scored.

Scale: one join of labels and documents; each task adds up its counts in one
array and ships it as ``SLICES`` compressed slices, which are summed per slice
(by as many tasks as there are shuffle partitions, or slices). What is
collected is bounded by parameters: the ratios (2 ** BITS numbers) and the
sample. Scoring is one narrow pass; the weights (2 ** BITS floats) are
broadcast. There is no grouping by a data key.

Defined results: a null text is an empty one and scores by the intercept;
null labels or ids are not learnt from (a null id is scored and not held out);
repeated label rows count repeatedly; without any label, or with labels of one
class only, every text scores that share (0.0 without labels); other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import documents, ship_package, shuffle_partitions, staged
from furrow.sources.tables import load

BITS = 20
ORDERS = (4, 5, 6)
MIN_DOCS = 6
MIN_RATIO = 1.5
SLICES = 256
SAMPLE_PER_CLASS = 6000
SAMPLE_BYTES = 48_000_000
THRESHOLD = 0.3
L2 = 1.0
ITERATIONS = 30
_SPACE = re.compile(r"\s+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str | None, bits: int = BITS, scratch: list | None = None) -> np.ndarray:
    """Distinct hash buckets of a text's character n-grams."""
    t = " " + _SPACE.sub(" ", (text or "").lower()).strip() + " "
    cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    found = []
    for n in ORDERS:
        if len(cp) >= n:
            h = np.full(len(cp) - n + 1, n, dtype=np.uint64)
            for j in range(n):
                h = (h ^ cp[j:len(cp) - n + 1 + j]) * _MIX
                h ^= h >> np.uint64(29)
            found.append((h >> np.uint64(64 - bits)).astype(np.int32))
    if not found:
        return np.empty(0, dtype=np.int32)
    h = np.concatenate(found)
    # Distinct without sorting: of equal buckets the last one written remains.
    if scratch is None:
        scratch = [np.empty(1 << bits, dtype=np.int32)]
    order = np.arange(len(h), dtype=np.int32)
    scratch[0][h] = order
    return h[scratch[0][h] == order]


def _count_and_sample(batches):
    """Per task: counts by class as compressed slices, and the sampled texts.
    Rows (slice, payload, label); slice -1 marks a sampled text."""
    counts = np.zeros((2, 1 << BITS), dtype=np.int64)
    scratch, seen = [np.empty(1 << BITS, dtype=np.int32)], False
    for b in batches:
        out = []
        for text, toxic, sampled in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), b["sampled"].to_pylist()):
            g, seen = grams(text, scratch=scratch), True
            counts[toxic][g] += 1
            if sampled:
                out.append((-1, zlib.compress((text or "").encode("utf-8", "surrogatepass"), 1), toxic))
        if out:
            yield _rows(out)
    if seen:
        for i, part in enumerate(np.split(counts, SLICES, axis=1)):
            yield _rows([(i, zlib.compress(part.astype("<i8").tobytes(), 1), None)])


def _rows(out):
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary()),
         pa.array([r[2] for r in out], pa.int32())], names=["slice", "payload", "label"])


def _add_slices(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, payload in zip(b["slice"].to_pylist(), b["payload"].to_pylist()):
            part = np.frombuffer(zlib.decompress(payload), dtype="<i8")
            total[i] = total[i] + part if i in total else part
    for i, part in total.items():
        yield _rows([(i, zlib.compress(part.tobytes(), 1), None)])


def _telling_grams(shared):
    """Sampled texts -> their buckets that the ratios keep."""
    def run(batches):
        keep, scratch = shared.value != 0, [np.empty(1 << BITS, dtype=np.int32)]
        for b in batches:
            out = []
            for payload, label in zip(b["payload"].to_pylist(), b["label"].to_pylist()):
                g = grams(zlib.decompress(payload).decode("utf-8", "surrogatepass"), scratch=scratch)
                out.append((-1, g[keep[g]].astype("<i4").tobytes(), label))
            yield _rows(out)
    return run


def log_count_ratios(other: np.ndarray, toxic: np.ndarray, class_rows: tuple[int, int]) -> np.ndarray:
    """Naive Bayes log-count ratios of documents, 0 where they tell nothing."""
    r = np.log((toxic + 0.5) / (class_rows[1] + 1)) - np.log((other + 0.5) / (class_rows[0] + 1))
    return np.where((other + toxic >= MIN_DOCS) & (np.abs(r) >= MIN_RATIO), r, 0.0).astype(np.float32)


def minimise(fun, x: np.ndarray, iterations: int, memory: int = 7) -> np.ndarray:
    """Limited-memory BFGS with a backtracking line search."""
    f, g = fun(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(iterations):
        q, alphas = g.copy(), []
        for s, y, rho in reversed(steps):
            a = rho * (s @ q)
            alphas.append(a)
            q -= a * y
        if steps:
            s, y, _ = steps[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(q)))
        for (s, y, rho), a in zip(steps, reversed(alphas)):
            q += (a - rho * (y @ q)) * s
        slope, step = -(g @ q), 1.0
        if slope >= -1e-10:
            break
        while step > 1e-6:
            fx, gx = fun(x - step * q)
            if fx <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * q, gx - g
        if s @ y > 1e-12:
            steps = [*steps[-memory + 1:], (s, y, 1.0 / (s @ y))]
        done = f - fx < 1e-7 * max(1.0, abs(f))
        x, f, g = x + s, fx, gx
        if done:
            break
    return x


def fit_weights(ratio: np.ndarray, sample: list[tuple[np.ndarray, int]], class_rows: tuple[int, int]):
    """Logistic regression on ratio-scaled binary features -> (weights per
    bucket, already scaled, as float32; intercept)."""
    n = class_rows[0] + class_rows[1]
    if n == 0 or not class_rows[0] or not class_rows[1]:
        share = class_rows[1] / n if n else 0.0
        return np.zeros(len(ratio), dtype=np.float32), math.log((share + 1e-12) / (1 - share + 1e-12))
    if not sum(len(g) for g, _ in sample):
        return np.zeros(len(ratio), dtype=np.float32), math.log(class_rows[1] / class_rows[0])
    sample = [(g, t) for g, t in sample if len(g)] + [(np.array([-1], dtype=np.int32), t) for g, t in sample if not len(g)]
    index = np.concatenate([g for g, _ in sample])
    ends = np.cumsum([len(g) for g, _ in sample])
    starts = ends - [len(g) for g, _ in sample]
    y = np.array([t for _, t in sample], dtype=np.float64)
    # Only buckets of the sample have a gradient: number them densely.
    used, index = np.unique(index, return_inverse=True)
    index = index.astype(np.int32)
    r = np.where(used < 0, 0.0, ratio[used]).astype(np.float64)  # -1: a text without features
    taken = np.array([(y == 0).sum(), (y == 1).sum()])
    weight = np.where(y == 1, class_rows[1] / taken[1], class_rows[0] / taken[0])
    weight *= len(y) / weight.sum()
    doc = np.repeat(np.arange(len(sample), dtype=np.int32), ends - starts)

    def objective(x):
        w, b = x[:-1], x[-1]
        z = np.add.reduceat((w * r)[index], starts) + b
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        loss = (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * L2 * (w @ w)
        d = weight * (p - y)
        gw = np.bincount(index, weights=d[doc], minlength=len(used)) * r + L2 * w
        return loss, np.append(gw, d.sum())

    x = minimise(objective, np.zeros(len(used) + 1), ITERATIONS)
    out = np.zeros(len(ratio), dtype=np.float32)
    out[used[used >= 0]] = (x[:-1] * r)[used >= 0]
    return out, float(x[-1])


def train(labelled: DataFrame, docs: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS):
    """Fit on ``labelled`` (doc_id, toxic) joined with the texts of ``docs``."""
    ship_package(docs.sparkSession)
    rows = labelled.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    chance = F.xxhash64(F.lit(7), "doc_id")
    picked = None
    for label in (0, 1):
        some = rows.filter(F.col("toxic") == label).select("doc_id").orderBy(chance, "doc_id").limit(sample_per_class)
        picked = some if picked is None else picked.union(some)
    # at most 2 * sample_per_class ids: a documented bound
    rows = rows.join(F.broadcast(picked.distinct().withColumn("sampled", F.lit(True))), "doc_id", "left")
    # Labels have no size bound, so the plan is the same for few as for many.
    joined = rows.hint("merge").join(docs.select("doc_id", "text"), "doc_id").select(
        "text", "toxic", F.coalesce("sampled", F.lit(False)).alias("sampled"))
    counted = staged(joined.mapInArrow(_count_and_sample, "slice int, payload binary, label int"), "tox-counts")
    sums = (counted.filter("slice >= 0").repartition(min(SLICES, shuffle_partitions(docs)), "slice")
            .mapInArrow(_add_slices, "slice int, payload binary, label int"))
    total = np.zeros((SLICES, 2, (1 << BITS) // SLICES), dtype=np.int64)
    for row in sums.collect():  # 2 ** BITS counts, whatever the corpus
        part = np.frombuffer(zlib.decompress(bytes(row["payload"])), dtype="<i8")
        total[row["slice"]] += part.reshape(2, -1)
    other, toxic = total.transpose(1, 0, 2).reshape(2, -1)
    class_rows = _class_rows(rows, docs)
    ratio = log_count_ratios(other, toxic, class_rows)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # 2 ** BITS floats
    picked_grams = staged(counted.filter("slice = -1").mapInArrow(_telling_grams(shared), "slice int, payload binary, label int"),
                          "tox-sample")
    sample = [(np.frombuffer(bytes(r["payload"]), dtype="<i4"), r["label"])
              for r in _within(picked_grams, SAMPLE_BYTES).collect()]  # bounded by rows and by bytes
    sample.sort(key=lambda x: (x[1], len(x[0]), x[0].tolist()))
    return fit_weights(ratio, sample, class_rows)


def _within(sample: DataFrame, most: int) -> DataFrame:
    """Of each class's sampled rows, in the order of a hash, those that together
    hold at most ``most`` bytes. What is ordered is a few numbers a row, of at
    most ``sample_per_class`` rows."""
    keyed = sample.withColumn("k", F.xxhash64("payload"))
    sizes = keyed.groupBy("label", "k").agg(F.sum(F.octet_length("payload")).alias("size"))
    running = F.sum("size").over(Window.partitionBy("label").orderBy("k"))
    kept = sizes.withColumn("upto", running).filter(F.col("upto") <= most).select("label", "k")
    return keyed.join(kept, ["label", "k"], "left_semi").select("payload", "label")


def _class_rows(rows: DataFrame, docs: DataFrame) -> tuple[int, int]:
    known = rows.join(docs.select("doc_id"), "doc_id", "left_semi")
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    return n.get(0, 0), n.get(1, 0)


def score(docs: DataFrame, model) -> DataFrame:
    """``docs`` plus ``score`` (in place of a column of that name); every whole
    text is read."""
    docs = docs.drop("score")
    ship_package(docs.sparkSession)
    weights, intercept = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2 ** BITS floats
    schema = docs.select("*", F.lit(0.0).alias("score")).schema

    def run(batches):
        scratch, w = [np.empty(1 << BITS, dtype=np.int32)], shared.value
        for b in batches:
            z = [intercept + float(w[grams(t, scratch=scratch)].sum(dtype=np.float64)) for t in b["text"].to_pylist()]
            s = 1 / (1 + np.exp(-np.clip(np.array(z, dtype=np.float64), -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def held_out(col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = load(spark, sf_dir, "labels").filter(~held_out())
    scored = score(docs, train(labels, docs))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
