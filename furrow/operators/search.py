"""Ranked text search and facets.

Tokens: lower-cased text split on runs of anything that is not a letter or a
digit (the whole text, never a prefix).

BM25 (k1 = 1.2, b = 0.75, idf = ln(1 + (N - df + 0.5) / (df + 0.5))): for a
query of a few terms the per-document term frequencies are array functions on
the row's token array, so scoring is a narrow projection. Corpus statistics
(N, average length, document frequency per query term) come from one
aggregation pass over a checkpointed per-document table (one tokenisation
pass over the text); the top ``k`` is Spark's TakeOrderedAndProject (``k`` rows
per partition, then a merge) - no full sort, no per-document shuffle.

``term_index`` builds the general inverted index (term, doc, tf) for workloads
with many queries; it is a grouped count keyed by (term, doc) with partial
aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.session import ensure_checkpoint_dir

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Array of non-empty lower-case tokens."""
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: t != F.lit(""))


def term_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return (docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("term"))
            .groupBy("term", id_col).agg(F.count(F.lit(1)).alias("tf")))


def _tf(toks: Column, term: str) -> Column:
    return F.size(F.filter(toks, lambda t: t == F.lit(term)))


def bm25(docs: DataFrame, terms: list[str], k: int = 20, id_col: str = "doc_id",
         text_col: str = "text", k1: float = K1, b: float = B, digits: int = 6) -> DataFrame:
    """Top ``k`` documents for the query terms: ``doc_id, score`` (ties by id)."""
    terms = sorted({t.lower() for t in terms})
    scored = (docs.select(id_col, tokens(F.col(text_col)).alias("_t")))
    # Tokenise once: the per-document (length, tf...) table is tiny next to
    # the text, and a reliable checkpoint lets both passes below reuse it.
    scored = scored.select(id_col, F.size("_t").alias("_dl"),
                           *[_tf(F.col("_t"), t).alias(f"_tf{i}") for i, t in enumerate(terms)])
    ensure_checkpoint_dir(docs.sparkSession)
    scored = scored.checkpoint(eager=True)
    stats = scored.agg(F.count(F.lit(1)).alias("n"), F.avg("_dl").alias("avgdl"),
                       *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    n, avgdl = stats["n"], stats["avgdl"] or 0.0
    if n == 0:
        return scored.select(id_col, F.lit(0.0).alias("score")).limit(0)
    total = F.lit(0.0)
    for i in range(len(terms)):
        df_t = stats[f"df{i}"]
        idf = float(math.log(1 + (n - df_t + 0.5) / (df_t + 0.5)))
        tf = F.col(f"_tf{i}")
        norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("_dl") / F.lit(avgdl))
        total = total + F.lit(idf) * tf * F.lit(k1 + 1) / (tf + norm)
    hits = F.lit(False)
    for i in range(len(terms)):
        hits = hits | (F.col(f"_tf{i}") > 0)
    return (scored.where(hits).select(id_col, F.round(total, digits).alias("score"))
            .orderBy(F.desc("score"), F.asc(id_col)).limit(k))


def boolean_match(docs: DataFrame, must: list[str] = (), must_not: list[str] = (),
                  should: list[str] = (), text_col: str = "text") -> DataFrame:
    """Documents with every ``must`` term, no ``must_not`` term and (if given)
    at least one ``should`` term. A narrow filter on the token array."""
    def matches(toks: Column) -> Column:
        cond = F.lit(True)
        for t in must:
            cond = cond & F.array_contains(toks, t.lower())
        for t in must_not:
            cond = cond & ~F.array_contains(toks, t.lower())
        if should:
            cond = cond & F.arrays_overlap(toks, F.array(*[F.lit(t.lower()) for t in should]))
        return cond

    # Inside a lambda the tokens are a variable: each text is split once.
    return docs.where(F.get(F.transform(F.array(tokens(F.col(text_col))), matches), F.lit(0)))


def facets(df: DataFrame, fields: list[str]) -> DataFrame:
    """Terms facets for several fields in one aggregation pass (grouping sets):
    ``facet, value, count``."""
    g = df.groupingSets([[F.col(f)] for f in fields], *[F.col(f) for f in fields]).agg(
        F.count(F.lit(1)).alias("count"), F.grouping_id().alias("_gid"))
    n = len(fields)
    facet, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, f in enumerate(fields):
        hit = F.col("_gid") == (1 << n) - 1 - (1 << (n - 1 - i))
        facet = F.when(hit, F.lit(f)).otherwise(facet)
        value = F.when(hit, F.col(f).cast("string")).otherwise(value)
    return g.select(facet.alias("facet"), value.alias("value"), "count")
