"""The registered queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ball_trees,
    best_fit_packing,
    chat_rotation,
    disguised_pii,
    filter_audit,
    hilbert_neighbours,
    image_copies,
    license_scan,
    lm_scores,
    media_scenes,
    quality_crf,
    sentencepiece_codec,
    simhash_dedup,
    suffix_array_dedup,
)
from .common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document once strings of 100 bytes that start earlier are removed."""
    runs = suffix_array_dedup.removed_runs(table(spark, sf_dir, "documents"), 100)
    return runs.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        (F.octet_length("removed") / 8).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint over three-word shingles and near-duplicate class of every document."""
    classes = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, tau=3)
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copy class of the picture of every embedding; every eighth is an edited view of the one before."""
    return image_copies.copy_classes(media_scenes.pictures(table(spark, sf_dir, "embeddings")))


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = quality_crf.train(docs, table(spark, sf_dir, "labels"))
    return quality_crf.score_documents(docs, model).select(
        "doc_id",
        quality_crf.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality_crf.THRESHOLD).cast("int").alias("predicted"),
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as counts and digests."""
    coded = sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 tokens."""
    return best_fit_packing.pack(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), 2048)


def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation as each participant sees it."""
    return chat_rotation.rotate(table(spark, sf_dir, "conversations"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under the counts of all words and pairs of all documents."""
    scores = lm_scores.score_documents(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of all documents with family, probability and template similarity."""
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.train(docs))


def op10_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest other vectors of every vector whose id is divisible by 100."""
    return hilbert_neighbours.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10, length=64)


def op11_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after five exact rounds over 40 centroids."""
    return ball_trees.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5)


def op12_disguised_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of plain matches, and all spans with the disguised ones."""
    found = disguised_pii.find(table(spark, sf_dir, "documents"))
    plain = F.filter("spans", lambda s: s["base"])
    counts = [F.size(disguised_pii.of_kind(plain, k)).cast("long").alias(f"n_{k}") for k in disguised_pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(disguised_pii.listed(plain), 256).alias("base_sha256"), disguised_pii.listed(F.col("spans")).alias("spans"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of each order, by source."""
    steps = filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return steps.filter("not whole").drop("whole", "filter")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_image_copies": op3_image_copies,
    "op4_quality_crf": op4_quality_crf,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_chat_rotation": op7_chat_rotation,
    "op8_lm_scores": op8_lm_scores,
    "op9_license_scan": op9_license_scan,
    "op10_hilbert_neighbours": op10_hilbert_neighbours,
    "op11_ball_tree_clusters": op11_ball_tree_clusters,
    "op12_disguised_pii": op12_disguised_pii,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {"op7_chat_rotation": chat_rotation.ORACLE, "op8_lm_scores": lm_scores.ORACLE, "op11_ball_tree_clusters": ball_trees.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
