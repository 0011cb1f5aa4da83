"""Atlas of phenotype-marker associations, one partition for each stratum.

Isolates are reports in words (``documents``) with assessed phenotypes (``labels``).  A
panel of patterns says which markers a report mentions; inside each stratum (a language
or laboratory) every phenotype is tested against every marker, with the tests of a
stratum corrected together.

    python -m jobs.association_atlas --documents PATH --labels PATH --output PATH [--config FILE] [--only en fr]

The whole output is replaced, or with ``--only`` the partitions of the strata named (the
others stay as they are).  A rerun gives the same rows.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.operators import strata
from cohortlens.sources.markers import holding, mentioned

log = logging.getLogger(__name__)
CONFIG = Path(__file__).with_suffix(".json")
_SCHEMA = "phenotype string, marker string, n long, n00 long, n01 long, n10 long, n11 long, phi double, odds_ratio double, chi2 double, p double, adj_p double, test string, significant boolean"


def load_config(path: str | Path = CONFIG) -> dict:
    """panel, phenotypes, stratum, id, text, alpha, method, least_rows."""
    config = json.loads(Path(path).read_text())
    shared = set(config["panel"]) & set(config["phenotypes"])
    if shared:
        raise ValueError(f"both a marker and a phenotype: {sorted(shared)}")
    return config


def atlas(documents: DataFrame, labels: DataFrame, config: dict) -> DataFrame:
    """A row for each stratum, phenotype and marker that vary there.

    Reports without labels and labels without a report take no part; a null stratum is one.
    Texts stay where they are read: only ids and marker names are exchanged.
    """
    stratum = config["stratum"]
    marked = documents.select(F.col(config["id"]).alias("id"), F.col(stratum).cast("string").alias("stratum"), mentioned(config["panel"], F.col(config["text"])).alias("markers"))
    assessed = labels.select(F.col(config["id"]).alias("id"), holding(config["phenotypes"]).alias("phenotypes"))
    counts = strata.cell_counts(marked.join(assessed, "id"), ["stratum"], "phenotypes", "markers")
    enough = counts.withColumn("_rows", F.max(F.when(F.col("item1").isNull(), F.col("n"))).over(_per_stratum())).where(F.col("_rows") >= config["least_rows"]).drop("_rows")
    found = strata.associations(enough, ["stratum"], list(config["phenotypes"]), config["method"])
    return found.select(F.col("item1").alias("phenotype"), F.col("item2").alias("marker"), "n", "n00", "n01", "n10", "n11", "phi", strata.odds_ratio().alias("odds_ratio"), "chi2", "p", "adj_p", "test",
                        (F.col("adj_p") <= config["alpha"]).alias("significant"), F.col("stratum").alias(stratum))


def _per_stratum():
    """Over counts, a stratum's window holds as many rows as it has cells."""
    from pyspark.sql import Window

    return Window.partitionBy("stratum")


def read_output(spark: SparkSession, output: str, config: dict) -> DataFrame:
    # the partitions' type is given, as names such as 01 would be read as numbers
    return spark.read.schema(f"{_SCHEMA}, {config['stratum']} string").parquet(output)


def run(spark: SparkSession, documents: str, labels: str, output: str, config: dict | None = None, only: list[str] | None = None) -> DataFrame:
    """Reads both tables, writes the atlas by stratum, and returns the output as it stands."""
    config = config or load_config()
    docs, assessed = spark.read.parquet(documents), spark.read.parquet(labels)
    if only:
        docs = docs.where(F.col(config["stratum"]).cast("string").isin(only))
    log.info("read %d reports from %s and %d assessments from %s", docs.count(), documents, assessed.count(), labels)
    found = atlas(docs, assessed, config)
    # a stratum has a row for each phenotype and marker: one file for each
    writer = found.repartition(config["stratum"]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if only else "static").partitionBy(config["stratum"])
    writer.parquet(output)
    out = read_output(spark, output, config)
    for row in out.groupBy(config["stratum"]).agg(F.count("*").alias("n"), F.sum(F.col("significant").cast("long")).alias("found")).orderBy(config["stratum"]).toLocalIterator():
        log.info("wrote %d tests of stratum %s to %s, %d significant", row["n"], row[0], output, row["found"])
    return out


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="jobs.association_atlas", description="Atlas of phenotype-marker associations by stratum.")
    parser.add_argument("--documents", required=True)
    parser.add_argument("--labels", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    parser.add_argument("--only", nargs="+", help="strata whose partitions are written anew")
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("association-atlas").getOrCreate()
    try:
        run(spark, given.documents, given.labels, given.output, load_config(given.config), given.only)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
