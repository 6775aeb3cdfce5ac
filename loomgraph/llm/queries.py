"""The thin queries over the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import exact_dedup as _exact
from loomgraph.llm import lattice_dedup as _lattice
from loomgraph.llm import mixing as _mixing
from loomgraph.llm import ngram_join as _ngrams
from loomgraph.llm import pieces as _pieces
from loomgraph.llm import pii as _pii
from loomgraph.llm import secrets as _secrets
from loomgraph.llm import substring_dedup as _substring
from loomgraph.llm import suffix_dedup as _suffix
from loomgraph.llm import toxicity as _toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ngrams.ngram_components(_documents(spark, sf_dir))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pii.scan_personal(_documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _secrets.scan_secrets(_documents(spark, sf_dir))


def op4_lattice_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lattice.lattice_near_dups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _toxicity.severity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _substring.substring_dedup(_documents(spark, sf_dir), with_text=False)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = _mixing.mix_sources(_documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def piece_model() -> str:
    """Where this machine, and each executor, keeps the public SentencePiece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = _pieces.encode_samples(_documents(spark, sf_dir), piece_model())
    digest = [F.size("pieces").cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash")]
    return encoded.select("doc_id", "sample", *digest, "log_prob", "perturbed", "log_inclusion", "exact")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(_documents(spark, sf_dir), digest="text_sha256")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suffix.suffix_dedup(_documents(spark, sf_dir)).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_personal_data": op2_personal_data,
    "op3_secret_scan": op3_secret_scan,
    "op4_lattice_near_dups": op4_lattice_near_dups,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_mix_sources": op7_mix_sources,
    "op8_piece_sampling": op8_piece_sampling,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
}
