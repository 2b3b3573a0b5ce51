"""The registered queries of the corpus operators, with their production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemigrate.llm import bitslice, bottom_k, bpe, chaining, hpylm, line_dedup, merkle, packing, periodic_runs, quality, secret_scan, simhash, warc_zip
from sitemigrate.llm.common import read_table


def vocabulary() -> str:
    """The place of the word-end BPE vocabulary; imported late, as only the tokenizing queries need it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score_documents(spark, read_table(spark, sf_dir, "documents"))


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read_table(spark, sf_dir, "documents"), vocabulary())


def op6_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, read_table(spark, sf_dir, "documents"), vocabulary()).drop("ids")


def op1_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(spark, read_table(spark, sf_dir, "documents"))


def op2_boosted_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op3_line_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(spark, docs).select("doc_id", "n_lines", "n_removed", "text")


def op7_simhash_meet_in_the_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, read_table(spark, sf_dir, "documents")).drop("group_fp", "text_hash")


def op8_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return bitslice.top_k(spark, vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op9_markov_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_markov")


def op10_zip_packaged_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc_zip.write_archives(spark, read_table(spark, sf_dir, "pages"))
    return warc_zip.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op11_bottom_k_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bottom_k.near_duplicates(spark, read_table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_recompression_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_runs(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic_runs.digests(periodic_runs.periodic_runs(docs))


def op13_butterfly_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.audit(spark, read_table(spark, sf_dir, "documents"), merkle.tampered_third())
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_collinear_chaining, op2_boosted_quality_rules, op3_line_window_dedup, op4_pitman_yor_scores, op5_bpe_automaton, op6_exact_complement_packing, op7_simhash_meet_in_the_middle, op8_bit_sliced_top_k, op9_markov_secret_scan, op10_zip_packaged_warc, op11_bottom_k_near_duplicates, op12_recompression_runs, op13_butterfly_merkle_manifest)
}

ORACLES: dict[str, str] = {"op3_line_window_dedup": line_dedup.ORACLE_SQL, "op8_bit_sliced_top_k": bitslice.ORACLE_SQL, "op10_zip_packaged_warc": warc_zip.ORACLE_SQL, "op12_recompression_runs": periodic_runs.ORACLE_SQL, "op13_butterfly_merkle_manifest": merkle.ORACLE_SQL}
