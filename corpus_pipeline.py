"""Corpus pipeline: quality rules, toxicity, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet in the shared folder and hands the reread table to the next.  All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.llm import bestfit_packing, jaccard_join, quality_rules, secrets, toxicity
from cohortlens.llm.scratch import Scratch, released

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    ledger = quality_rules.apply_policy(quality_rules.rule_ledger(docs, keep=docs.columns))
    return ledger.where("kept").select(docs.columns)


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, trained on what is left of the labelled ones, doesn't reject."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxicity_scores(docs, model).where("predicted = 0").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Rows are told apart by all their columns, so different rows that share an id, or have
    none, are documents of their own; they come in order of the id (null last), then of a
    digest of the row.  Of wholly equal rows one stays, but for those without words, which
    link with nothing.  Extra columns may have any names but the two used here.
    """
    row = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).cast("binary"))
    keyed = docs.withColumn("__row", row)
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "__row")
    groups = jaccard_join.ngram_jaccard_join(keyed.select(order.alias("__key"), "text"), "__key")
    heads = groups.where("__key.__row = component_id.__row").groupBy(F.col("__key.__row").alias("__row")).agg(F.max("n_shingles").alias("__n"))
    # The join leaves equal rows together, so this needs no exchange of its own.
    kept = keyed.join(heads, "__row").withColumn("__n", F.when(F.col("__n") == 0, F.monotonically_increasing_id()))
    return kept.dropDuplicates(["__row", "__n"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and their length (where there is such a column) brought up to date."""
    masked = secrets.redact_secrets(docs, secrets.train(docs))
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of 4096 tokens."""
    import public_tokenizers

    return bestfit_packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality rules", quality), ("toxicity", clean_language), ("n-gram Jaccard join", one_of_each), ("secret scans", no_secrets), ("best-fit packing", packed)]

#: Learned models and tokenizers aren't SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with released():
            docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
