"""A pipeline from raw documents to sampled token sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it
kept; between stages the table is written as Parquet and read again. Tables that a
stage writes on its way are deleted as soon as it is decided.

1. toxicity: documents that the severity model rejects go.
2. exact dedup: of equal texts the one of least id stays.
3. n-gram Jaccard join: of each group of near copies (five words, 0.8) the
   document of least id stays.
4. mixing: a document comes as often as the mix takes its words, to the nearest
   whole number; documents without words come once.
5. SentencePiece: two sampled segmentations of each document, others for each
   repeat of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.exact_dedup import keep_first_copies
from loomgraph.llm.mixing import repeat_by_mix
from loomgraph.llm.ngram_join import keep_component_heads
from loomgraph.llm.pieces import encode_samples
from loomgraph.llm.queries import piece_model
from loomgraph.llm.toxicity import keep_civil
from loomgraph.storage import discard, materialise

#: The severity model and the token samples have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones, does not reject; an empty or null text stays."""
    return keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text; of null and empty texts one in all."""
    return keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each component of near copies; texts without words link with nothing and stay."""
    return keep_component_heads(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights of their sources, null being a source of its own; some are repeated, some go."""
    return repeat_by_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each row; one without pieces of an empty or null text."""
    return encode_samples(docs, piece_model(), repeats=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("source mix", mix),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token samples of ``documents`` in ``sf_dir``: columns of ``encode_samples``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
