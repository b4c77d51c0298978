"""Queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fusion, incremental, knn, lines, mixing, residue, spans, split, tokens
from ..runtime import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Places of the lines that their source repeats over its articles."""
    return lines.repeated_lines(table(spark, d, "articles")).select(F.col("id").alias("article_id"), "line_no")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every article's body without its source's repeated lines."""
    return lines.without_repeated_lines(table(spark, d, "articles")).withColumnRenamed("id", "article_id")


def p2_templates(spark: SparkSession, d: str) -> DataFrame:
    """The removed lines of every source as templates with wildcard slots."""
    return lines.template_report(table(spark, d, "articles"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of frames of which one is among the most similar ones of the other."""
    return knn.similar_pairs(table(spark, d, "frame_embeddings"))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Every frame's most similar frames with their cosines."""
    return knn.frame_neighbours(table(spark, d, "frame_embeddings"))


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the index against brute force, by the frames of every hundredth article."""
    return knn.recall(table(spark, d, "frame_embeddings"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks over 700 signs, each of which the cutting operator turned into pieces."""
    chunks = table(spark, d, "article_chunks")
    return split.cut_rows(chunks, "id", "chunk_text").where("piece_no = 0").select(F.col("id").alias("chunk_id")).distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of the oversized chunks with their places in chunk and article."""
    return split.cut_chunks(table(spark, d, "article_chunks"), table(spark, d, "articles"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Incoming rows that repeat a held or earlier accepted one, with the smallest such."""
    return incremental.repeats(table(spark, d, "articles"), table(spark, d, "incoming_articles"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Articles and chunks that hold template residue, filler, errors or script notices."""
    return residue.residue_rows(table(spark, d, "articles"), table(spark, d, "article_chunks"))


def p6_validation(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of the classifier on hosts it has not seen."""
    return residue.validation(table(spark, d, "articles"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The member of every group whose value survives, field by field, under the rule of trust."""
    return fusion.trusted_values(table(spark, d, "articles"), table(spark, d, "article_duplicates"), table(spark, d, "source_profiles"))


def p7_fused(spark: SparkSession, d: str) -> DataFrame:
    """One record per group with the values of greatest posterior."""
    return fusion.fused_records(table(spark, d, "articles"), table(spark, d, "article_duplicates"), table(spark, d, "source_profiles"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every document's ids by byte_bpe_50k."""
    return tokens.encode_documents(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text, decoded from its ids: the round trip of p8_ids."""
    return tokens.decode_documents(tokens.encode_documents(table(spark, d, "documents")))


def p8_totals(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and documents of every source."""
    return tokens.token_totals(table(spark, d, "documents"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used in the mixture."""
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and reached share of every listed source."""
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that share a long span."""
    return spans.sharing_pairs(table(spark, d, "documents"))


def p10_parts(spark: SparkSession, d: str) -> DataFrame:
    """What part of every document stands in another one too."""
    return spans.shared_parts(table(spark, d, "documents"))


QUERIES = {
    "p2_found": p2_found, "p2_clean": p2_clean, "p2_templates": p2_templates, "p4_found": p4_found, "p4_pieces": p4_pieces,
    "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p3_recall": p3_recall, "p5_found": p5_found, "p6_found": p6_found, "p6_validation": p6_validation, "p7_found": p7_found, "p7_fused": p7_fused,
    "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_parts": p10_parts,
    "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p8_totals": p8_totals,
}
