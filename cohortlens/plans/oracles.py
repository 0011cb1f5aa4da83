"""DuckDB twins of the queries: common table expressions for the shared matrices, tests and networks."""

from __future__ import annotations

from ..sources.matrix import BRANDS, DRUG_CLASSES, FLAGS, brand_classes, feature_roles


def _values(rows: list[tuple]) -> str:
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows)


FEATURES = _values(feature_roles(BRANDS + FLAGS, brand_classes()))
CLASSES = _values([(c, "class", i, None) for i, c in enumerate(DRUG_CLASSES)])

MATRIX = f"""
ones AS (SELECT DISTINCT l_orderkey AS r, p_brand AS f FROM lineitem JOIN part ON l_partkey = p_partkey
         UNION SELECT DISTINCT l_orderkey, 'flag_' || l_returnflag || l_linestatus FROM lineitem),
feats(f, role, ord, class) AS (VALUES {FEATURES}),
rws AS (SELECT DISTINCT l_orderkey AS r FROM lineitem),
flags AS (SELECT rws.r, count(DISTINCT class) AS n_classes, count(DISTINCT class) >= 3 AS is_mdr
          FROM rws LEFT JOIN (SELECT r, class FROM ones JOIN feats USING (f) WHERE class IS NOT NULL) c ON rws.r = c.r GROUP BY rws.r),
cfeats(f, role, ord, class) AS (VALUES {CLASSES}),
cones AS (SELECT DISTINCT r, class AS f FROM ones JOIN feats USING (f) WHERE class IS NOT NULL),
mrows AS (SELECT r FROM flags WHERE is_mdr),
mcones AS (SELECT * FROM cones WHERE r IN (SELECT r FROM mrows)),
gfeats AS (SELECT * FROM feats WHERE role = 'gene'),
gones AS (SELECT r, f FROM ones JOIN gfeats USING (f)),
mgones AS (SELECT * FROM gones WHERE r IN (SELECT r FROM mrows)),
pfeats AS (SELECT * FROM feats WHERE role = 'phenotype'),
pones AS (SELECT r, f FROM ones JOIN pfeats USING (f)),
cgfeats AS (SELECT * FROM cfeats UNION ALL SELECT f, role, ord + 100, class FROM gfeats),
cgones AS (SELECT * FROM cones UNION ALL SELECT * FROM gones)"""

PARTS = """
prows AS (SELECT p_partkey AS r FROM part),
psones AS (SELECT p_partkey AS r, p_brand AS f FROM part UNION SELECT p_partkey, 'size_' || p_size FROM part),
psfeats AS (SELECT f, 'gene' AS role, (row_number() OVER (ORDER BY f) - 1)::INT AS ord, NULL::VARCHAR AS class FROM (SELECT DISTINCT f FROM psones))"""


def erfc(z: str) -> str:
    term = f"exp((2 * i + 1) * ln(greatest({z}, 1e-300)) + 2 * i * ln(2) + lgamma(i + 1) - lgamma(2 * i + 2) - ({z}) * ({z}))"
    return f"CASE WHEN {z} > 6 THEN 0 ELSE greatest(0, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 200), lambda i: {term}))) END"


_R, _K, _N = "(n10 + n11)", "(n01 + n11)", "n"


def _ln_pmf(x: str) -> str:
    g = lambda v: f"lgamma({v} + 1)"
    return (f"({g(_R)} + {g(f'(n - {_R})')} + {g(_K)} + {g(f'(n - {_K})')} - {g('n')} - {g(x)} - {g(f'({_R} - {x})')} - {g(f'({_K} - {x})')} - {g(f'(n - {_R} - {_K} + {x})')})")


LOW, HIGH = f"greatest(0, {_R} + {_K} - n)", f"least({_R}, {_K})"
FISHER = f"least(1, list_sum(list_transform(range({LOW}, {HIGH} + 1), lambda x: CASE WHEN {_ln_pmf('x')} <= {_ln_pmf('n11')} + 1e-7 THEN exp({_ln_pmf('x')}) ELSE 0 END)))"
UPPER = f"least(1, list_sum(list_transform(range(n11, {HIGH} + 1), lambda x: exp({_ln_pmf('x')}))))"
PHI = "((n00::DOUBLE * n11 - n01::DOUBLE * n10) / sqrt((n00 + n01)::DOUBLE * (n10 + n11) * (n00 + n10) * (n01 + n11)))"


def _expected() -> list[tuple[str, str]]:
    return [("n00", "((n00 + n01)::DOUBLE * (n00 + n10) / n)"), ("n01", "((n00 + n01)::DOUBLE * (n01 + n11) / n)"),
            ("n10", "((n10 + n11)::DOUBLE * (n00 + n10) / n)"), ("n11", "((n10 + n11)::DOUBLE * (n01 + n11) / n)")]


LEAST_E = "least(" + ", ".join(e for _, e in _expected()) + ")"
YATES = "(" + " + ".join(f"pow(abs({o} - {e}) - least(0.5, abs({o} - {e})), 2) / {e}" for o, e in _expected()) + ")"
PLAIN = "CASE WHEN (n00 + n01) * (n10 + n11) * (n00 + n10) * (n01 + n11) > 0 THEN n * pow(n00::DOUBLE * n11 - n01::DOUBLE * n10, 2) / ((n00 + n01)::DOUBLE * (n10 + n11) * (n00 + n10) * (n01 + n11)) ELSE 0 END"


def pairs(p: str, ones: str, rows: str, feats: str, cross: bool = False) -> str:
    """CTEs {p}k prevalences, {p}c all tables, {p}t tests of valid ones, {p}a adjusted."""
    rule = "a.role <> 'gene' AND b.role = 'gene'" if cross else "a.ord < b.ord"
    return f"""
{p}n AS (SELECT count(*) AS n FROM {rows}),
{p}k AS (SELECT x.f, x.role, x.ord, coalesce(c.k, 0) AS k, n FROM {feats} x LEFT JOIN (SELECT f, count(*) AS k FROM {ones} GROUP BY f) c ON x.f = c.f CROSS JOIN {p}n),
{p}j AS (SELECT a.f AS f1, b.f AS f2, count(*) AS n11 FROM {ones} a JOIN {ones} b ON a.r = b.r AND a.f <> b.f GROUP BY a.f, b.f),
{p}c AS (SELECT a.f AS item1, b.f AS item2, a.role AS role1, b.role AS role2, a.ord AS ord1, b.ord AS ord2, a.k AS k1, b.k AS k2, a.n,
         a.n - a.k - b.k + coalesce(n11, 0) AS n00, b.k - coalesce(n11, 0) AS n01, a.k - coalesce(n11, 0) AS n10, coalesce(n11, 0) AS n11
         FROM {p}k a JOIN {p}k b ON {rule} LEFT JOIN {p}j ON f1 = a.f AND f2 = b.f),
{p}v AS (SELECT *, {LEAST_E} < 5 AS exact, {PHI} AS phi, {YATES} AS y FROM {p}c WHERE k1 > 0 AND k1 < n AND k2 > 0 AND k2 < n),
{p}t AS (SELECT *, CASE WHEN exact THEN phi * phi * n ELSE y END AS chi2, CASE WHEN exact THEN {FISHER} ELSE {erfc('sqrt(y / 2)')} END AS p FROM {p}v),
{p}r AS (SELECT *, row_number() OVER (ORDER BY p, item1, item2) AS rk, count(*) OVER () AS m FROM {p}t),
{p}a AS (SELECT *, least(1, min(p * m / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS adj_p, least(1, p * m) AS bonferroni,
         least(1, max(p * (m - rk + 1)) OVER (ORDER BY rk ROWS UNBOUNDED PRECEDING)) AS holm FROM {p}r)"""


def _levels(deepest: int) -> str:
    """Breadth-first levels with numbers of shortest paths, as far as any of the test networks reaches."""
    out = ["d1 AS (SELECT src, dst, 1 AS distance, 1 AS paths FROM bi), u1 AS (SELECT * FROM d1),"]
    for k in range(2, deepest + 1):
        out.append(f"""d{k} AS (SELECT a.src, b.dst, {k} AS distance, sum(a.paths) AS paths FROM d{k - 1} a JOIN bi b ON a.dst = b.src WHERE a.src <> b.dst
       AND NOT EXISTS (SELECT 1 FROM u{k - 1} x WHERE x.src = a.src AND x.dst = b.dst) GROUP BY a.src, b.dst),
u{k} AS (SELECT * FROM u{k - 1} UNION ALL SELECT * FROM d{k}),""")
    return "\n".join(out)


NETWORK = pairs("h", "ones", "rws", "feats") + """,
edges AS (SELECT item1 AS src, item2 AS dst, round_even(phi, 3) AS phi, round_even(adj_p, 3) AS p_value,
          CASE WHEN role1 = 'gene' AND role2 = 'gene' THEN 'gene-gene' WHEN role1 = 'gene' OR role2 = 'gene' THEN 'pheno-gene' ELSE 'pheno-pheno' END AS edge_type
          FROM ha WHERE adj_p <= 0.05),
bi AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
vs AS (SELECT DISTINCT src AS id FROM bi),
deg AS (SELECT src AS id, count(*) AS degree, count(*) / ((SELECT count(*) FROM vs) - 1) AS degree_centrality FROM bi GROUP BY src),
""" + _levels(12) + """
sp AS (SELECT id AS src, id AS dst, 0 AS distance, 1 AS paths FROM vs UNION ALL SELECT * FROM u12),
btw AS (SELECT vs.id, coalesce(b, 0) * 2 / (((SELECT count(*) FROM vs) - 1) * ((SELECT count(*) FROM vs) - 2)) AS betweenness FROM vs LEFT JOIN (
        SELECT x.dst AS id, sum(x.paths * y.paths / w.paths) AS b FROM sp x JOIN sp y ON x.dst = y.src JOIN sp w ON w.src = x.src AND w.dst = y.dst
        WHERE x.src < y.dst AND x.src <> x.dst AND y.src <> y.dst AND x.distance + y.distance = w.distance GROUP BY x.dst) q USING (id)),
comm AS (SELECT f AS id, ord % 5 + 1 AS community FROM feats),
prs AS (SELECT item1, item2, phi, p FROM ht),
best AS (SELECT least(item1, item2) AS lo, greatest(item1, item2) AS hi, arg_max(phi, abs(phi)) AS phi FROM prs GROUP BY 1, 2)"""


def cs(wanted: str) -> str:
    """The co-selection score of (gene1, gene2) rows."""
    return f"""SELECT w.*, least(1, 0.4 * least(abs(coalesce(b.phi, 0)), 1) + 0.3 * coalesce(1 / (sp.distance + 1), 0) + 0.3 * (c1.community IS NOT DISTINCT FROM c2.community)::INT) AS cs
    FROM {wanted} w LEFT JOIN best b ON b.lo = least(gene1, gene2) AND b.hi = greatest(gene1, gene2) LEFT JOIN sp ON sp.src = gene1 AND sp.dst = gene2
    LEFT JOIN comm c1 ON c1.id = gene1 LEFT JOIN comm c2 ON c2.id = gene2"""


def sql(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join((MATRIX, *ctes)) + "\n" + select
