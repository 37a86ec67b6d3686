"""The registered queries of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoquill.llm import bpe, collocations, embeddings, jaccard, languages, minhash, mixing, oracles, phrase_index, resampling, search, secrets, sharding, toxicity
from cytoquill.llm.registry import ORACLES, QUERIES, query
from cytoquill.llm.tables import table

__all__ = ["ORACLES", "QUERIES"]


@query("op1_source_mix")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix with weights 5, 2, 1 takes from every document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


@query("op2_document_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash fingerprints of every text and its edited text."""
    return minhash.fingerprint_in_order(table(spark, sf_dir, "documents"))


@query("op3_balanced_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal bytes."""
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op4_importance_resampling")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all documents, sampled in proportion to how much likelier they are as good text."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from the labels of the training part."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op6_ngram_jaccard_join", oracles.JACCARD)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


@query("op7_language_mixture")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the training part."""
    docs = table(spark, sf_dir, "documents")
    return languages.identify(docs, *languages.learn(docs))


@query("op8_embedding_multi_index", oracles.EMBEDDINGS)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between vectors of a label with a cosine of 0.98 or more."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op9_secret_ownership", oracles.SECRETS)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text, and which of them a single owner holds."""
    return secrets.digest_columns(secrets.find_secrets(table(spark, sf_dir, "documents")))


@query("op10_bpe_transducer")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text under the 50k byte-level vocabulary, and their decoding."""
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op11_shared_search", oracles.SEARCH)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_collocations", oracles.COLLOCATIONS)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of 2 to 4 words of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_phrase_contamination", oracles.CONTAMINATION)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in ten-word windows of benchmark items."""
    index = phrase_index.build(table(spark, sf_dir, "documents"))
    return phrase_index.digest_columns(phrase_index.contamination(index, table(spark, sf_dir, "benchmark")))
