"""The jobs as queries over the given tables, with their DuckDB twins.

Each query runs its job twice into one new folder under ``spark.checkpoint.dir`` and
returns the output as it stands after the second run; the files stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.plans import oracles as o
from cohortlens.sources.shared import shared_dir

from . import association_atlas, surveillance


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def job1_association_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = _folder(spark, "job1") + "/atlas"
    for _ in range(2):
        out = association_atlas.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", output)
    return _rounded(out, "phi", "odds_ratio", "chi2", "p", "adj_p")


def job2_surveillance(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "job2")
    for _ in range(2):  # a pattern, as the table may be one file
        out = surveillance.run(spark, f"{sf_dir}/documents.parquet*", f"{folder}/output", f"{folder}/checkpoint")
    return _rounded(out, "prevalence", "lower", "upper", "partner_phi", "partner_adj_p")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_association_atlas": job1_association_atlas, "job2_surveillance": job2_surveillance}


def _found(panel: dict[str, str]) -> str:
    """Rows of (marker, pattern)."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({text(name)}, {text(pattern)})" for name, pattern in panel.items())


def _tests(tables: str, by: str) -> str:
    """CTEs from tables (by, item1, item2, n00 .. n11, n) to ``adjusted``."""
    return f"""
valid AS (SELECT *, {o.LEAST_E} < 5 AS exact, {o.PHI} AS phi, {o.YATES} AS y FROM {tables} WHERE n10 + n11 > 0 AND n10 + n11 < n AND n01 + n11 > 0 AND n01 + n11 < n),
tested AS (SELECT *, CASE WHEN exact THEN phi * phi * n ELSE y END AS chi2, CASE WHEN exact THEN {o.FISHER} ELSE {o.erfc('sqrt(y / 2)')} END AS p FROM valid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY p, item1, item2) AS rk, count(*) OVER (PARTITION BY {by}) AS m FROM tested),
adjusted AS (SELECT *, least(1, min(p * m / rk) OVER (PARTITION BY {by} ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS adj_p FROM ranked)"""


_ATLAS, _WATCH = association_atlas.load_config(), surveillance.load_config()
_KINDS = " UNION ALL ".join(f"SELECT doc_id, lang, '{name}' AS item1 FROM d WHERE {condition}" for name, condition in _ATLAS["phenotypes"].items())

ORACLES: dict[str, str] = {
    "job1_association_atlas": f"""
WITH d AS (SELECT documents.doc_id, lang, text, toxic, quality FROM documents JOIN labels ON labels.doc_id = documents.doc_id),
panel(item2, pattern) AS (VALUES {_found(_ATLAS['panel'])}),
has AS (SELECT doc_id, lang, item2 FROM d JOIN panel ON regexp_matches(text, pattern)),
kinds AS ({_KINDS}),
rows_ AS (SELECT lang, count(*) AS n FROM d GROUP BY lang),
ks AS (SELECT lang, item2, count(*) AS k2 FROM has GROUP BY ALL),
ps AS (SELECT lang, item1, count(*) AS k1 FROM kinds GROUP BY ALL),
js AS (SELECT kinds.lang, item1, item2, count(*) AS n11 FROM kinds JOIN has USING (doc_id) GROUP BY ALL),
tables_ AS (SELECT ps.lang, ps.item1, ks.item2, n, n - k1 - k2 + coalesce(n11, 0) AS n00, k2 - coalesce(n11, 0) AS n01, k1 - coalesce(n11, 0) AS n10, coalesce(n11, 0) AS n11
            FROM ps JOIN ks USING (lang) JOIN rows_ USING (lang) LEFT JOIN js ON js.lang = ps.lang AND js.item1 = ps.item1 AND js.item2 = ks.item2),{_tests('tables_', 'lang')}
SELECT item1 AS phenotype, item2 AS marker, n, n00, n01, n10, n11, round(phi, 6) AS phi, round((n00 + 0.5) * (n11 + 0.5) / ((n01 + 0.5) * (n10 + 0.5)), 6) AS odds_ratio, round(chi2, 6) AS chi2, round(p, 6) AS p,
       round(adj_p, 6) AS adj_p, CASE WHEN exact THEN 'fisher' ELSE 'chi2' END AS test, adj_p <= {_ATLAS['alpha']} AS significant, lang FROM adjusted""",
    "job2_surveillance": f"""
WITH panel(marker, pattern) AS (VALUES {_found(_WATCH['panel'])}),
has AS (SELECT doc_id, source, marker FROM documents JOIN panel ON regexp_matches(text, pattern)),
rows_ AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
many AS (SELECT source, count(*) AS n_multi FROM (SELECT doc_id, source FROM has GROUP BY ALL HAVING count(*) >= {_WATCH['multiple_from']}) GROUP BY source),
ks AS (SELECT source, marker, count(*) AS k, any_value(n) AS n FROM has JOIN rows_ USING (source) GROUP BY ALL),
js AS (SELECT a.source, a.marker AS item1, b.marker AS item2, count(*) AS n11 FROM has a JOIN has b USING (doc_id) WHERE a.marker < b.marker GROUP BY ALL),
tables_ AS (SELECT a.source, a.marker AS item1, b.marker AS item2, a.n, a.n - a.k - b.k + coalesce(n11, 0) AS n00, b.k - coalesce(n11, 0) AS n01, a.k - coalesce(n11, 0) AS n10, coalesce(n11, 0) AS n11
            FROM ks a JOIN ks b ON a.source = b.source AND a.marker < b.marker LEFT JOIN js ON js.source = a.source AND js.item1 = a.marker AND js.item2 = b.marker),{_tests('tables_', 'source')},
both_ AS (SELECT source, item1 AS marker, item2 AS partner, phi, adj_p FROM adjusted UNION ALL SELECT source, item2, item1, phi, adj_p FROM adjusted),
best AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY source, marker ORDER BY round(abs(phi), 12) DESC, round(adj_p, 12), partner) = 1),
cdf AS (SELECT source, marker, k, n, x, sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(k / n) + (n - x) * ln(1 - k / n))) OVER (PARTITION BY source, marker ORDER BY x) AS c
        FROM ks, LATERAL (SELECT unnest(range(0, n + 1)) AS x) WHERE k < n),
limits AS (SELECT source, marker, min(x) FILTER (c >= {(1 - _WATCH['confidence']) / 2} - 1e-9) AS lo, min(x) FILTER (c >= {(1 + _WATCH['confidence']) / 2} - 1e-9) AS hi FROM cdf GROUP BY ALL)
SELECT ks.marker, ks.n, ks.k, round(k / n, 6) AS prevalence, round(coalesce(lo, k) / n, 6) AS lower, round(coalesce(hi, k) / n, 6) AS upper, coalesce(n_multi, 0)::BIGINT AS n_multi, partner, round(phi, 6) AS partner_phi, round(adj_p, 6) AS partner_adj_p, ks.source
FROM ks LEFT JOIN many USING (source) LEFT JOIN limits USING (source, marker) LEFT JOIN best USING (source, marker)""",
}
