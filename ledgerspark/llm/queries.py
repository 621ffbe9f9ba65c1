"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, hmm, licences, lines, media, mixing, oracles, packing, pairing, quality, simhash, spelling, suffixes, wavelet
from .shared import read

BYTE_BPE, WORD_BPE = (public_tokenizers.path(f"{x}.json") for x in ("byte_bpe_50k", "word_bpe_49k"))
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), BYTE_BPE, "byte", keep_ids=False)


def op2_similar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.matches(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"), "n_links")


def op3_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.copies(media.page_images(read(spark, sf_dir, "pages")))
    return found.withColumnRenamed("image_id", "page_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), n_words=3, bits=2, n_segments=2)
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", *quality.BASE, "base_failed", F.round("score", 6).alias("score"), "kept")


def op7_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return hmm.score(read(spark, sf_dir, "documents"), held_out)


def op8_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_files(read(spark, sf_dir, "documents"), WORD_BPE, "word", end_id=2, keep_ids=False)


def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, sf_dir, "documents"), length=50, keep_text=False)


def op11_pack_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.pack_matched(read(spark, sf_dir, "documents"), BYTE_BPE, "byte", end_id=2, keep_ids=False)


def op12_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE, keep_groups=False)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pack_best_fit, op2_similar_lines, op3_image_copies, op4_simhash, op5_mix_sources, op6_quality_rules, op7_hmm_scores, op8_license_digests, op9_token_files, op10_repeated_strings,
        op11_pack_matched, op12_align_tokens, op13_spelling_variants,
    )
}

ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
