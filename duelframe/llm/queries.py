"""The registered queries of the dealt operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm import byte_pairs, centroids, language, media, mixing, near_dedup, neighbours, passages, quotes, repair, sentence_pieces, token_counts, toxicity
from duelframe.llm.common import table


def op9_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")



def op4_transducer_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = token_counts.token_counts(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))



def op6_piece_transducer(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentence_pieces.encode_documents(docs, model or public_tokenizers.path("piece_bpe_32k.model"))



def op7_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return media.document_media(docs).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )



def op3_family_svm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")



def op8_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))



def op10_cross_polytope_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))



def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))



def op1_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)



def op5_paragraph_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.without_repeats(table(spark, sf_dir, "documents"))



def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.sort_means(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")



def op12_bucketed_byte_pairs(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    return byte_pairs.round_trips(table(spark, sf_dir, "documents"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"))



def op13_tensor_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op5_paragraph_banding": op5_paragraph_banding,
    "op1_setsketch_near_dedup": op1_setsketch_near_dedup,
    "op2_quotation_linking": op2_quotation_linking,
    "op10_cross_polytope_neighbours": op10_cross_polytope_neighbours,
    "op8_noisy_or_toxicity": op8_noisy_or_toxicity,
    "op3_family_svm_language": op3_family_svm_language,
    "op7_interleaved_media": op7_interleaved_media,
    "op6_piece_transducer": op6_piece_transducer,
    "op4_transducer_token_counts": op4_transducer_token_counts,
    "op9_sainte_lague_mix": op9_sainte_lague_mix,
    "op11_sort_means": op11_sort_means,
    "op12_bucketed_byte_pairs": op12_bucketed_byte_pairs,
    "op13_tensor_repair": op13_tensor_repair,
}
ORACLES: dict[str, str] = {
    "op1_setsketch_near_dedup": near_dedup.ORACLE_SQL,
    "op2_quotation_linking": quotes.ORACLE_SQL,
    "op11_sort_means": centroids.ORACLE_SQL,
    "op13_tensor_repair": repair.ORACLE_SQL,
}
