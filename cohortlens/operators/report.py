"""Reports of bounded tables: CSV, HTML, workbook, and triples of JSON, CSV and Markdown."""

from __future__ import annotations

import html
import json
import time
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

#: Rows of a table that a report shows at most, and how a note on the others begins.
MOST, _CUT = 100_000, "The first "


def shown(df: DataFrame, place: str, most: int | None = None) -> tuple[pd.DataFrame, str]:
    """A report's rows of a table, and what is to be said of the others.

    A table of more rows is written whole, as Parquet by Spark, at ``place``; the report
    has its first rows in their order and names their true number and that place.
    """
    most = MOST if most is None else most
    rows = df.limit(most + 1).toPandas()
    if len(rows) <= most:
        return rows, ""
    df.write.mode("overwrite").parquet(place)
    total = df.sparkSession.read.parquet(place).count()
    return rows.head(most), f"{_CUT}{most} of {total} rows; all are in {place}."


def table_html(t: pd.DataFrame, caption: str, level: str = "h2") -> str:
    """A table with three digits; the caller's frame isn't changed."""
    head = f"<{level}>{html.escape(caption)}</{level}>" if caption else ""
    if t.empty:
        return f"{head}<p>No data available.</p>"
    return head + t.round(3).to_html(index=False, border=0, escape=True)


#: Files that have a name of their own.
FILES = {"targets": "intervention_targets_top20"}


def write_csv(tables: list[tuple[str, str, pd.DataFrame]], out: Path) -> list[str]:
    paths = []
    for name, _, t in tables:
        path = out / f"{FILES.get(name, name)}.csv"
        t.to_csv(path, index=False)
        paths.append(str(path))
    return paths


def save_page(text: str, out: Path, prefix: str = "analysis", now: float | None = None) -> str:
    """A page under a name with the time in seconds, so that runs don't overwrite each other."""
    out.mkdir(parents=True, exist_ok=True)
    path = out / f"{prefix}_{int(time.time() if now is None else now)}.html"
    path.write_text(text)
    return str(path)


def light_html(values: dict[str, object], title: str) -> str:
    """A short page of names and values."""
    rows = "".join(f"<tr><th>{html.escape(str(k))}</th><td>{html.escape(str(v))}</td></tr>" for k, v in values.items())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table>{rows}</table></body></html>"


def collect_results(out: Path) -> dict[str, list[str]]:
    """What an analysis left in its folder, by kind, in order of the names."""
    return {kind: sorted(str(p) for p in out.glob(f"*.{kind}")) for kind in ("html", "xlsx", "csv", "json", "svg")}


#: The report's sections in their order: title, what it shows, tables (by name, with a title where there are several), chart.
SECTIONS: list[tuple[str, str, list[tuple[str, str]], str | None]] = [
    ("Resistance to classes, all isolates", "Share of isolates that resist each class of drugs, with bootstrap limits.", [("class_ci_all", "")], "class_ci_all"),
    ("Resistance to classes, multiresistant isolates", "The same among isolates that resist enough classes to count as multiresistant.", [("class_ci_mdr", "")], None),
    ("Genes, all isolates", "Share of isolates that carry each gene, with bootstrap limits.", [("gene_ci_all", "")], "gene_ci_all"),
    ("Genes, multiresistant isolates", "The same among multiresistant isolates.", [("gene_ci_mdr", "")], None),
    ("Patterns of classes", "Combinations of classes that multiresistant isolates resist, and how frequent they are.", [("class_patterns", "")], None),
    ("Patterns of genes", "Combinations of genes that multiresistant isolates carry.", [("gene_patterns", "")], None),
    ("Classes that occur together", "Pairs that stay significant after the correction for many tests, with phi.", [("class_pairs", "")], None),
    ("Genes that occur together", "Pairs of genes, tested in the same way.", [("gene_pairs", "")], None),
    ("Classes and genes", "Pairs of a class and a gene over all isolates.", [("class_gene_pairs", "")], None),
    ("Rules among classes", "If these, then those: support, confidence, lift, leverage and conviction.", [("class_rules", "")], None),
    ("Rules among genes", "The same for genes.", [("gene_rules", "")], None),
    ("Network of all features", "Significant pairs of classes, drugs and genes as edges.", [("network_summary", "Size and density"), ("network", "Edges"), ("communities", "Communities"), ("redundancy", "Nearly equal features")], "network"),
    ("Risk by network", "Isolates by the sum of their features' places in the network, weighted by how well each is known.", [("risk_top", "Highest risk")], "risk"),
    ("Ordered patterns", "Chains A→B and A→B→C of correlated features.", [("gene_sequences", "Genes"), ("class_sequences", "Classes")], None),
    ("Co-selection and targets", "Groups of genes that travel together, and nodes by priority.", [("coselection_modules", "Modules"), ("coselection_ranking", "Potential"), ("targets", "Targets")], "targets"),
]

#: What the workbook and the report say about how numbers come about.
METHODS = [
    "Values are 0 or 1; an isolate resists a class if it resists any of its drugs, and is multiresistant from the set number of classes on.",
    "Limits are percentiles of binomial resamples of each column; a resample depends on the seed, the column and its number only.",
    "Pairs: chi-square with Yates' correction, or Fisher's exact test where an expected count is below 5; phi is the strength.",
    "All tests of a table are corrected together; pairs without a defined test are left out before.",
    "Rules come from all frequent itemsets, of any length; lift above 1 means that the parts occur together more often than by chance.",
    "Network measures: degree, betweenness and eigenvector centrality; communities by modularity.",
    "Shown numbers are rounded copies; files have full precision.",
]


def write_html(tables: list[tuple[str, str, pd.DataFrame]], out: Path, title: str, figures: dict[str, tuple[str, str]] | None = None) -> str:
    """Numbered sections in the order of SECTIONS, with their charts; tables of no section come last."""
    by = {name: (note, t) for name, note, t in tables}
    left, body = dict(by), []
    if "overview" in by:
        body.append(table_html(left.pop("overview")[1], "Overview"))
    for i, (name, text, parts, chart) in enumerate(SECTIONS, 1):
        if not any(p in by for p, _ in parts):
            continue
        body.append(f"<section id='s{i}'><h2>{i}) {html.escape(name)}</h2><p>{html.escape(text)}</p>")
        if chart and figures and chart in figures:
            body.append(f"<figure>{figures[chart][0]}<figcaption>{html.escape(figures[chart][1])}</figcaption></figure>")
        for k, (p, what) in enumerate(parts):
            if p in by:
                left.pop(p, None)
                note, rows = by[p]
                body.append(table_html(rows, f"{i}{chr(97 + k)}) {what}" if what else "", "h3"))
                if _CUT in note:
                    body.append(f"<p>{html.escape(note[note.index(_CUT):])}</p>")
        body.append("</section>")
    body += [table_html(t, note) for note, t in left.values()]
    body.append("<section><h2>Methods</h2><ul>" + "".join(f"<li>{html.escape(x)}</li>" for x in METHODS) + "</ul></section>")
    path = out / "report.html"
    style = "body{font-family:sans-serif;max-width:70em;margin:2em auto}table{border-collapse:collapse}td,th{padding:.2em .6em;border-bottom:1px solid #ccc;text-align:left}svg{max-width:100%}"
    path.write_text(f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{''.join(body)}</body></html>")
    return str(path)


def write_triple(t: pd.DataFrame, out: Path, name: str, interpretation: str, checks: dict[str, bool], metadata: dict | None = None) -> list[str]:
    """The same result as JSON, CSV and Markdown with its interpretation and checks."""
    out.mkdir(parents=True, exist_ok=True)
    t.to_csv(out / f"{name}.csv", index=False)
    (out / f"{name}.json").write_text(json.dumps({"metadata": metadata or {}, "interpretation": interpretation, "checks": checks, "rows": json.loads(t.to_json(orient="records"))}, indent=1))
    head = "| " + " | ".join(map(str, t.columns)) + " |\n|" + "---|" * len(t.columns) + "\n"
    rows = "".join("| " + " | ".join(map(str, r)) + " |\n" for r in t.itertuples(index=False))
    lines = "".join(f"- [{'x' if ok else ' '}] {what}\n" for what, ok in checks.items())
    (out / f"{name}.md").write_text(f"# {name}\n\n{interpretation}\n\n{head}{rows}\n{lines}")
    return [str(out / f"{name}.{x}") for x in ("json", "csv", "md")]


def target_text(targets: pd.DataFrame, top_n: int = 20) -> str:
    """A plain-text list of targets."""
    lines = ["Intervention targets", "=" * 20]
    for r in targets.head(top_n).itertuples(index=False):
        lines.append(f"{r.rank:3d}. {r.gene}: priority {r.priority:.3f} (association {r.association:.3f}, degree {r.degree:.3f}, betweenness {r.betweenness:.3f}, prevalence {r.prevalence:.3f}, mobility {r.mobility:.1f})")
    return "\n".join(lines) + "\n"


#: Rows of each part of the advanced report.
ADVANCED = {"association_rules": 15, "redundancy": 10, "network": 20, "importance": 20, "stability": 20}


def advanced_html(found: dict[str, DataFrame], path: str) -> str:
    """The advanced operators' results, the first rows of each."""
    parts = []
    for name, df in found.items():
        t = df.limit(ADVANCED.get(name, 20)).toPandas()
        parts.append(table_html(t.map(lambda v: ", ".join(v) if hasattr(v, "__iter__") and not isinstance(v, str) else v), name.replace("_", " ").capitalize()))
    Path(path).write_text("<!DOCTYPE html><html><head><meta charset='utf-8'><title>Advanced analysis</title></head><body>" + "".join(parts) + "</body></html>")
    return path
