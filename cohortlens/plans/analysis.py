"""The whole analysis of a folder of matrices: one plan for each result, one report.

Results are DataFrames over the same long form; what reaches the driver has as many
rows as the matrix has columns or pairs of them, or a stated number of top rows.
"""

from __future__ import annotations

import json
import logging
import uuid
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Settings
from ..operators import advanced, bootstrap, charts, communities, graph, mining, pairs, report, resistance, scores, validation
from ..operators.figures import bars_svg, histogram_svg, network_svg, save
from ..operators.workbook import report_workbook
from ..sources.matrix import BinaryMatrix, discover, from_wide, join_files, read_delimited
from ..sources.shared import settled, shared_dir

log = logging.getLogger(__name__)


@dataclass
class Result:
    name: str
    frame: DataFrame
    note: str


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at):
        raise FileNotFoundError(f"no such folder: {folder}")
    return [f.getPath().getName() for f in store.listStatus(at)]


def load(spark: SparkSession, settings: Settings, files: list[str] | None = None) -> BinaryMatrix:
    """The preferred file of the folder, or the named files joined by their id."""
    base = settings.data_dir if "://" in settings.data_dir else f"file://{Path(settings.data_dir).resolve()}"
    names = files or [discover(listed(spark, base))]
    if names == [None]:
        raise FileNotFoundError(f"no CSV files in {base}")
    tables = [read_delimited(spark, f"{base.rstrip('/')}/{n}") for n in names]
    wide = tables[0]
    for t in tables[1:]:
        wide = join_files(wide, t)
    return from_wide(wide, wide.columns[0], settings.classes, settings.null_is_one)


def results(m: BinaryMatrix, c: Settings) -> list[Result]:
    """All results, in the order of the report."""
    m = BinaryMatrix(settled(m.ones), settled(m.rows), m.features, m.classes)
    flags = resistance.multiresistance(m, c.mdr_threshold)
    sub = resistance.mdr_subset(m, c.mdr_threshold)
    classes, genes = m.class_level(), m.role("gene")
    sub_classes, sub_genes = sub.class_level(), sub.role("gene")
    mixed = classes.union(BinaryMatrix(genes.ones, genes.rows, genes.features.withColumn("ord", F.col("ord") + 1000)))
    everything = settled(pairs.tested(pairs.contingency(m)))
    edges = settled(graph.network_edges(m, c.alpha, c.fdr_method, everything))
    ci = lambda x: bootstrap.bootstrap_ci(x, c.n_iterations, c.confidence, c.seed)
    out = [
        Result("overview", validation.overview(m, flags), "Isolates and multiresistant isolates"),
        Result("class_ci_all", ci(classes), "Prevalence of classes, all isolates"),
        Result("gene_ci_all", ci(genes), "Prevalence of genes, all isolates"),
        Result("class_ci_mdr", ci(sub_classes), "Prevalence of classes, multiresistant isolates"),
        Result("gene_ci_mdr", ci(sub_genes), "Prevalence of genes, multiresistant isolates"),
        Result("class_patterns", bootstrap.pattern_intervals(mining.pattern_frequencies(mining.patterns(sub_classes)), c.n_iterations, c.confidence, c.seed), "Patterns of classes"),
        Result("gene_patterns", bootstrap.pattern_intervals(mining.pattern_frequencies(mining.patterns(sub_genes, mining.NO_GENOTYPE)), c.n_iterations, c.confidence, c.seed), "Patterns of genes"),
        Result("class_pairs", pairs.report_view(pairs.cooccurrence(sub_classes, c.alpha, c.fdr_method)), "Classes that occur together"),
        Result("gene_pairs", pairs.report_view(pairs.cooccurrence(sub_genes, c.alpha, c.fdr_method)), "Genes that occur together"),
        Result("class_gene_pairs", pairs.report_view(pairs.cooccurrence(mixed, c.alpha, c.fdr_method, cross_roles=True)), "Classes and genes that occur together"),
        Result("class_rules", mining.rule_view(mining.association_rules(mining.frequent_itemsets(classes, c.min_support), c.min_lift)), "Rules among classes"),
        Result("gene_rules", mining.rule_view(mining.association_rules(mining.frequent_itemsets(genes, c.min_support), c.min_lift)), "Rules among genes"),
        Result("gene_sequences", mining.ordered_patterns(genes, c.min_support), "Ordered patterns of genes"),
        Result("class_sequences", mining.ordered_patterns(classes, c.min_support), "Ordered patterns of classes"),
        Result("redundancy", advanced.redundant_pairs(m), "Nearly equal features"),
        Result("network", graph.edge_list(edges), "Significant pairs of all features"),
    ]
    if not edges.isEmpty():
        paths, groups = graph.shortest_paths(edges), settled(communities.louvain(edges))
        # Co-selection takes what is significant among multiresistant isolates, targets what ties genes to classes.
        together = lambda x: pairs.cooccurrence(x, c.alpha, c.fdr_method).select("item1", "item2", F.bround("phi", 3).alias("phi"))
        tests = settled(together(sub_classes).union(together(sub_genes)))
        tied = pairs.cooccurrence(mixed, c.alpha, c.fdr_method, cross_roles=True)
        tied = settled(tied.select(F.col("item2").alias("item1"), "item2", F.bround("phi", 3).alias("phi"), F.bround("adj_p", 3).alias("p")))
        modules = scores.coselection_modules(tests, paths, groups)
        intervals = bootstrap.binomial_intervals(pairs.prevalence(mixed), c.n_iterations, c.confidence, c.seed).select("feature", F.col("lower").alias("lo"), F.col("upper").alias("hi"))
        risk = settled(graph.row_risk(m, graph.node_scores(edges), intervals))
        out += [
            Result("communities", groups.orderBy("community", "id"), "Communities of the network"),
            Result("network_summary", graph.network_summary(edges, m), "Size and density of the network"),
            Result("risk_top", risk.orderBy(F.desc("risk"), "row").limit(20), "Isolates at the highest risk"),
            Result("risk_bins", charts.histogram(risk, "risk").orderBy("bin"), "Isolates by risk"),
            Result("coselection_modules", modules.withColumn("genes", F.array_join("genes", ", ")), "Modules of co-selected genes"),
            Result("coselection_ranking", scores.rank_by_potential(tests, paths, groups), "Genes by co-selection potential"),
            Result("targets", scores.intervention_targets(edges, paths, groups, tied, modules, pairs.prevalence(m)).limit(20), "Targets by priority"),
        ]
    return out


def charts_of(tables: list[tuple[str, str, pd.DataFrame]]) -> dict[str, tuple[str, str]]:
    """Charts of the tables that are there: name -> (svg, what it shows)."""
    by = {name: t for name, _, t in tables if len(t)}
    out = {}
    for name, what in (("class_ci_all", "Share of isolates that resist each class, in percent"), ("gene_ci_all", "Share of isolates that carry each gene, in percent")):
        if name in by:
            t = by[name].head(40)
            out[name] = (bars_svg(t["feature"].tolist(), t["mean"].tolist(), what, t["lower"].tolist(), t["upper"].tolist()), what)
    if "network" in by:
        e = by["network"]
        kinds = {"gene-gene": ("gene", "gene"), "pheno-pheno": ("phenotype", "phenotype")}
        roles: dict[str, str] = {}
        for r in e.itertuples(index=False):
            for x, role in zip((r.src, r.dst), kinds.get(r.edge_type, ("phenotype", "gene"))):
                roles.setdefault(x, role)
        out["network"] = (network_svg(e, roles, "Significant pairs"), "Significant pairs of features; dashed where they avoid each other")
    if "risk_bins" in by:
        out["risk"] = (histogram_svg(by["risk_bins"], "Isolates by risk"), "Isolates by risk")
    if "targets" in by:
        t = by["targets"]
        out["targets"] = (bars_svg(t["gene"].tolist(), t["priority"].tolist(), "Targets by priority"), "Targets by priority")
    return out


def analyse(spark: SparkSession, settings: Settings, files: list[str] | None = None) -> dict:
    """Run everything and write CSV, JSON and HTML; a stage that fails is logged and left out."""
    out = Path(settings.output_dir).resolve()
    out.mkdir(parents=True, exist_ok=True)
    # executors write there: the output folder itself only where they share it
    large = f"{out.as_uri()}/tables" if spark.sparkContext.master.startswith("local") else f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    tables, failed = [], {}
    for r in results(load(spark, settings, files), settings):
        try:
            rows, more = report.shown(r.frame, f"{large}/{r.name}")
            tables.append((r.name, f"{r.note}. {more}" if more else r.note, rows))
        except Exception as e:  # noqa: BLE001 - a stage on its own
            log.exception("%s failed", r.name)
            failed[r.name] = str(e).splitlines()[0]
    csv = report.write_csv(tables, out)
    figures = charts_of(tables)
    page = report.write_html(tables, out, "Multiresistance analysis", figures)
    about = {"Analysis": "Multiresistance analysis", **{k: v for k, v in settings.__dict__.items() if k != "classes"}}
    index = save(figures, out)
    book = report_workbook(out / "report.xlsx", tables, about, report.METHODS, index)
    (out / "summary.json").write_text(json.dumps({"settings": {k: v for k, v in settings.__dict__.items()}, "rows": {n: len(t) for n, _, t in tables}, "failed": failed}, indent=1))
    return {"status": "success" if not failed else "partial", "output_dir": str(out), "html_reports": [page], "excel_reports": [book], "csv_files": csv, "charts": [f for f, _ in index], "failed": failed, "total_files": len(csv) + len(index) + 3}
