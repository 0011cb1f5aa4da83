"""Surveillance of a growing folder of reports: marker prevalence and associations of each source so far.

Each run takes the files that came since the last one (a file stream with a checkpoint,
until all that are there are taken), counts their reports' markers and pairs of markers,
and adds up all counts into the report.  Only new files are read; what is kept of the old
ones is their counts.

    python -m jobs.surveillance --documents FOLDER --output FOLDER --checkpoint FOLDER [--config FILE]

``--documents`` may also be a pattern of files or folders.  Under ``--output``: ``counts`` (a partition for each batch of the stream) and ``report``
(a partition for each source).  A batch that is tried again after a failure replaces its
own partition, so nothing counts twice; a run without new files writes the same report.
A file counts once, by its name: reports that come again in another file count again.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortlens.operators import bootstrap, strata
from cohortlens.sources.markers import mentioned

log = logging.getLogger(__name__)
CONFIG = Path(__file__).with_suffix(".json")
_BY = ["source"]
_COUNTS = "source string, item1 string, item2 string, n long, batch long"
_REPORT = "marker string, n long, k long, prevalence double, lower double, upper double, n_multi long, partner string, partner_phi double, partner_adj_p double"
#: The item that stands for "as many markers as make a report a multiple one"; no marker may be named so.
MULTIPLE = "(multiple)"


def load_config(path: str | Path = CONFIG) -> dict:
    """panel, source, source_type, text, multiple_from, confidence, method, files_per_batch."""
    config = json.loads(Path(path).read_text())
    if MULTIPLE in config["panel"]:
        raise ValueError(f"{MULTIPLE} can't be a marker")
    return config


def batch_counts(documents: DataFrame, config: dict) -> DataFrame:
    """source, item1, item2, n of some reports; ``MULTIPLE`` counts those with ``multiple_from`` markers or more."""
    marked = documents.select(F.col(f"`{config['source']}`").cast("string").alias("source"), mentioned(config["panel"], F.col(f"`{config['text']}`")).alias("markers"))
    counts = strata.cell_counts(marked, _BY, "markers")
    many = marked.where(F.size("markers") >= config["multiple_from"]).groupBy("source").agg(F.count("*").alias("n"))
    return counts.unionByName(many.select("source", F.lit(MULTIPLE).alias("item1"), F.lit(None).cast("string").alias("item2"), "n"))


def report(counts: DataFrame, config: dict) -> DataFrame:
    """A row for each source and marker: prevalence with its interval, the source's multiple reports, and the strongest partner.

    ``partner`` is the marker of largest |phi| (ties: the smaller adjusted p, then the name), null where no pair varies.
    """
    total = strata.merged(counts, _BY)
    many = total.where(F.col("item1") == MULTIPLE).select("source", F.col("n").alias("n_multi"))
    cells = total.where(F.coalesce(F.col("item1") != MULTIPLE, F.lit(True)))
    shares = strata.prevalence(cells, _BY)
    n, k, low = F.col("n"), F.col("k"), (1 - config["confidence"]) / 2
    shares = shares.select("*", (bootstrap.binomial_quantile(n, k, low) / n).alias("lower"), (bootstrap.binomial_quantile(n, k, 1 - low) / n).alias("upper"))
    tests = strata.associations(cells, _BY, method=config["method"])
    both = tests.select("source", F.col("item1").alias("marker"), F.col("item2").alias("partner"), "phi", "adj_p").union(tests.select("source", "item2", "item1", "phi", "adj_p"))
    # a source and marker have as many rows as there are other markers
    first = Window.partitionBy("source", "marker").orderBy(F.desc(F.round(F.abs("phi"), 12)), F.round("adj_p", 12), "partner")
    best = both.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(F.col("source").alias("_s"), F.col("marker").alias("_m"), "partner", F.col("phi").alias("partner_phi"), F.col("adj_p").alias("partner_adj_p"))
    full = shares.join(best, shares["source"].eqNullSafe(best["_s"]) & (shares["feature"] == best["_m"]), "left")
    full = full.join(many.select(F.col("source").alias("_t"), "n_multi"), F.col("source").eqNullSafe(F.col("_t")), "left")
    return full.select(F.col("feature").alias("marker"), "n", "k", "prevalence", "lower", "upper", F.coalesce("n_multi", F.lit(0).cast("long")).alias("n_multi"), "partner", "partner_phi", "partner_adj_p", "source")


def read_report(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(f"{_REPORT}, source string").parquet(f"{output}/report")


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Takes the new Parquet files of ``documents`` (a folder or pattern), writes counts and report, and returns the report as it stands."""
    config = config or load_config()
    seen = {"batches": 0}
    kept = f"{output}/counts"

    def take(batch: DataFrame, number: int) -> None:
        counts = batch_counts(batch, config).withColumn("batch", F.lit(number).cast("long"))
        # few rows: a cell of each source; the batch's number makes a second try replace the first
        counts.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(kept)
        seen["batches"] += 1
        rows = spark.read.schema(_COUNTS).parquet(kept).where((F.col("batch") == number) & F.col("item1").isNull()).agg(F.sum("n")).first()[0]
        log.info("batch %d: read %d reports from %s, wrote their counts to %s", number, rows or 0, documents, kept)

    # a folder without files yet has no counts, but a report without rows
    spark.createDataFrame([], _COUNTS).write.mode("ignore").partitionBy("batch").parquet(kept)
    # only these columns are read
    stream = spark.readStream.schema(f"`{config['source']}` {config['source_type']}, `{config['text']}` string").option("maxFilesPerTrigger", config["files_per_batch"]).parquet(documents)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%d new batches", seen["batches"])
    counts = spark.read.schema(_COUNTS).parquet(kept)
    report(counts, config).repartition("source").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("source").parquet(f"{output}/report")
    out = read_report(spark, output)
    log.info("wrote %d rows to %s/report", out.count(), output)
    return out


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="jobs.surveillance", description="Marker prevalence and associations of a growing folder of reports.")
    parser.add_argument("--documents", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--checkpoint", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("surveillance").getOrCreate()
    try:
        run(spark, given.documents, given.output, given.checkpoint, load_config(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
