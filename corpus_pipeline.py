"""The corpus pipeline: from ``documents`` to token ids.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is
written as Parquet and read again as the next stage's ``docs``. All stages but
the last return the columns of ``documents``.

Defined results, in every stage: a null text is an empty one and stays null
where the stage keeps its row; empty texts are no near duplicates of one
another, hold no entities, have size 0 in the mix (where each stays once) and
no tokens; rows equal in id and text are one document to the near-duplicate
stage and rows of their own to all others; a null id is carried along (and
comes last where ids decide); other columns, whatever their names, are carried
along by all stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import bpe, mixing, ngram_join, pii, toxicity
from furrow.llm.common import documents, release, staged
from furrow.sources.tables import load


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above go."""
    labels = load(spark, sf_dir, "labels").filter(~toxicity.held_out())
    model = toxicity.train(labels, docs)
    scored = toxicity.score(docs.select("text", F.struct(*docs.columns).alias("_row")), model)
    return scored.filter(F.col("score") < toxicity.THRESHOLD).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 stays."""
    return ngram_join.deduplicate(docs, 5, 4, 5)


def replace_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities get surrogates; ``n_chars`` follows the new text."""
    out = pii.replace_entities(docs, pii.DEMO_KEY)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or drop out, as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every text, and the digest
    of what they decode to."""
    done = bpe.encode_decode(docs, bpe.default_tokenizer())
    return done.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("private_data", replace_private_data),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: SQL cannot express the classifier or the encoder; tests compare the stages
#: with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, done = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(*done)
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
