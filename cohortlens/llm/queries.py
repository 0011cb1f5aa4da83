"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .bestfit_packing import pack_documents
from .byte_bpe import encode_documents
from .graph_search import build_index, search_index
from .html_extract import extract_main_text
from .jaccard_join import ngram_jaccard_join
from .quality_rules import ablations, apply_policy, rule_ledger
from .run_detection import crc_repeated, longest, periodic_runs
from .scratch import Scratch
from .secrets import scan_secrets, train as train_network
from .shard_sort import histogram_sort_shards
from .simhash import near_counts, simhash_documents

from .toxicity import toxicity_scores, train
from .warc_derivatives import derivatives, responses


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_read(spark, sf_dir, "documents"))


def op2_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = toxicity_scores(docs, train(docs, _read(spark, sf_dir, "labels")), keep=["doc_id"])
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = apply_policy(rule_ledger(_read(spark, sf_dir, "documents"), keep=["doc_id"]))
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy rejects, alone or with others: from operator 4's ledger only."""
    return ablations(rule_ledger(_read(spark, sf_dir, "documents"), keep=["doc_id"]))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = scan_secrets(docs, train_network(docs), keep=["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_network", "n_confirmed")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_near``: other rows at most ``RADIUS`` bits away, for ids divisible by 20 (else null)."""
    rows = Scratch(spark, "simhash").table(simhash_documents(_read(spark, sf_dir, "documents")), "prints")
    queries = rows.where("doc_id % 20 = 0")
    near = near_counts(rows, queries).select("query", (F.col("found") - 1).alias("n_near"))
    # many queries may share a fingerprint: it is dealt out by a salt, and other rows take no part
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")
    counted = queries.withColumn("salt", salt).join(near.select(F.col("query").alias("fingerprint"), "n_near", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt")), ["fingerprint", "salt"], "left")
    rest = rows.where(F.coalesce(F.col("doc_id") % 20 != 0, F.lit(True))).withColumn("n_near", F.lit(None).cast("long"))
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near"]
    return counted.select(columns).union(rest.select(columns))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(_read(spark, sf_dir, "pages"))).withColumnRenamed("source_key", "page_id")


def op9_shard_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = histogram_sort_shards(_read(spark, sf_dir, "documents"), shards=16, keep=["doc_id"])
    return placed.withColumn("grown_shard", F.lit(None).cast("int"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_read(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(crc_repeated(_read(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = found.withColumn("best", longest(F.col("runs")))
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
                       F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    index, shards = build_index(vectors)
    return search_index(index, shards, vectors.where("vec_id % 20 = 0"), k=20)


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_bestfit_packing": op2_bestfit_packing,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "quality_ablations": quality_ablations,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_secrets": op6_secrets,
    "op7_simhash": op7_simhash,
    "op8_warc_derivatives": op8_warc_derivatives,
    "op9_shard_sort": op9_shard_sort,
    "op10_html_extract": op10_html_extract,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_graph_search": op12_graph_search,
}
