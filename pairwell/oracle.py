"""The registered queries in DuckDB's SQL, each over its whole tables."""

from __future__ import annotations

_DAYS = "abs(datediff('day', a.o_orderdate::DATE, c.o_orderdate::DATE))::BIGINT"
_EDGES = f"""edges AS (
  SELECT a.o_orderkey::VARCHAR AS anchor_id, c.o_orderkey::VARCHAR AS candidate_id, {_DAYS} AS days
  FROM orders a JOIN orders c ON a.o_orderpriority IS NOT DISTINCT FROM c.o_orderpriority AND {_DAYS} <= 30
  WHERE a.o_orderstatus = 'P' AND c.o_orderstatus = 'O' AND a.o_orderkey <> c.o_orderkey)"""
_PAIRS = f"""{_EDGES},
pairs AS (
  SELECT anchor_id, candidate_id, days FROM edges
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY days, candidate_id) <= 2)"""


def _weights(unit: str | None, pairs: str = _PAIRS) -> str:
    share = f"1.0::DOUBLE / count(*) OVER (PARTITION BY {unit})" if unit else "1.0::DOUBLE"
    return f"""{pairs},
pw AS (SELECT anchor_id, candidate_id, {share} AS weight FROM pairs),
uw AS (
  SELECT anchor_id AS unit_id, 'anchor' AS role, sum(weight) AS match_weight FROM pw GROUP BY 1
  UNION ALL SELECT candidate_id, 'candidate', sum(weight) FROM pw GROUP BY 1)"""


def _serial(edges: str, order: str, take: str = "free[1:2]", resource: str = "candidate_id") -> str:
    """The serial pass. edges has (grp, anchor_id, place, candidate_id, days, uniq); one step serves an anchor of each grp."""
    return f"""RECURSIVE {edges},
served AS (SELECT grp, anchor_id, row_number() OVER (PARTITION BY grp ORDER BY any_value(place), anchor_id) AS k FROM edges GROUP BY grp, anchor_id),
pool AS (
  SELECT grp, k, anchor_id, list({{'c': candidate_id, 'd': days, 'r': {resource}}} ORDER BY {order}) AS cands
  FROM edges JOIN served USING (grp, anchor_id) GROUP BY grp, k, anchor_id),
run AS (
  SELECT grp, 0::BIGINT AS k, NULL::VARCHAR AS anchor_id, []::VARCHAR[] AS used, NULL::STRUCT(c VARCHAR, d BIGINT, r VARCHAR)[] AS got FROM (SELECT DISTINCT grp FROM served)
  UNION ALL
  SELECT grp, k, anchor_id, list_concat(used, [x.r FOR x IN got]), got
  FROM (SELECT grp, k, anchor_id, used, {take} AS got
        FROM (SELECT pool.grp, pool.k, pool.anchor_id, run.used, [x FOR x IN cands IF NOT list_contains(run.used, x.r)] AS free
              FROM run JOIN pool ON pool.grp = run.grp AND pool.k = run.k + 1))),
pairs AS (SELECT grp, anchor_id, p.c AS candidate_id, p.d AS days FROM (SELECT grp, anchor_id, unnest(got) AS p FROM run WHERE anchor_id IS NOT NULL))"""


_ORDERS = f"""edges AS (
  SELECT a.o_orderpriority AS grp, a.o_orderkey::VARCHAR AS anchor_id, a.o_orderkey AS place, c.o_orderkey::VARCHAR AS candidate_id, {_DAYS} AS days, c.o_custkey::VARCHAR AS uniq
  FROM orders a JOIN orders c ON a.o_orderpriority IS NOT DISTINCT FROM c.o_orderpriority AND {_DAYS} <= 30
  WHERE a.o_orderstatus = 'P' AND c.o_orderstatus = 'O' AND a.o_orderkey <> c.o_orderkey)"""
_NEAREST = _serial(_ORDERS, "days, candidate_id")
_UNIQUE = _serial(_ORDERS, "days, candidate_id", resource="uniq")
_SCORED = f"""edges AS (
  SELECT a.o_orderpriority AS grp, a.o_orderkey::VARCHAR AS anchor_id, a.o_orderkey AS place, c.o_orderkey::VARCHAR AS candidate_id, {_DAYS} AS days, c.o_custkey::VARCHAR AS uniq
  FROM orders a JOIN orders c ON a.o_orderpriority IS NOT DISTINCT FROM c.o_orderpriority AND abs(a.o_totalprice::DOUBLE - c.o_totalprice::DOUBLE) <= 500.0
  WHERE a.o_orderstatus = 'P' AND c.o_orderstatus = 'O')"""
_SHOWN = "SELECT anchor_id, candidate_id, days FROM pairs"

_CONSTRAINED = f"""o AS (SELECT *, CASE WHEN o_custkey % 10 > 0 THEN o_orderkey % 2 END AS parity, o_orderdate::DATE + (o_custkey % 700)::INT AS paid FROM orders),
tested AS (
  SELECT a.o_orderkey::VARCHAR AS anchor_id, c.o_orderkey::VARCHAR AS candidate_id, {_DAYS} AS days,
    CASE WHEN NOT coalesce(a.parity = c.parity, FALSE) THEN 'gender_mismatch' WHEN abs(a.o_totalprice - c.o_totalprice) > 50000 THEN 'caliper_mismatch'
         WHEN abs(datediff('day', a.paid, c.paid)) > 365 THEN 'date_window_mismatch' END AS reason
  FROM o a JOIN o c ON a.o_orderpriority IS NOT DISTINCT FROM c.o_orderpriority AND {_DAYS} <= 30 WHERE a.o_orderstatus = 'P' AND c.o_orderstatus = 'O')"""

_SAMPLES = f"""{_PAIRS},
s AS (SELECT o.*, o_totalprice / 100000 AS price, o_custkey / 1000 AS customer FROM orders o),
sampled AS (
  SELECT CASE o_orderstatus WHEN 'P' THEN 'case' ELSE 'control' END AS role, 'pre' AS phase, o.* FROM s o WHERE o_orderstatus IN ('P', 'O')
  UNION ALL SELECT 'case', 'post', o.* FROM pairs JOIN s o ON anchor_id = o_orderkey::VARCHAR
  UNION ALL SELECT 'control', 'post', o.* FROM pairs JOIN s o ON candidate_id = o_orderkey::VARCHAR)"""


def _numeric(features: dict[str, str]) -> str:
    cells = "\n  UNION ALL ".join(f"SELECT role, phase, {i} AS place, '{name}' AS covariate, ({x})::DOUBLE AS x FROM sampled" for i, (name, x) in enumerate(features.items()))
    return f"""{_SAMPLES},
long AS ({cells}),
m AS (
  SELECT place, covariate, phase, count(x) FILTER (WHERE role = 'case') AS n_case, count(x) FILTER (WHERE role = 'control') AS n_control,
    avg(x) FILTER (WHERE role = 'case') AS mean_case, avg(x) FILTER (WHERE role = 'control') AS mean_control,
    var_pop(x) FILTER (WHERE role = 'case') AS var_case, var_pop(x) FILTER (WHERE role = 'control') AS var_control
  FROM long GROUP BY ALL),
steps AS (SELECT covariate, phase, x, count(*) FILTER (WHERE role = 'case') AS k1, count(*) FILTER (WHERE role = 'control') AS k0 FROM long GROUP BY ALL),
cum AS (SELECT covariate, phase, sum(k1) OVER w AS c1, sum(k0) OVER w AS c0 FROM steps WINDOW w AS (PARTITION BY covariate, phase ORDER BY x)),
gaps AS (SELECT covariate, phase, avg(abs(c1::DOUBLE / n_case - c0::DOUBLE / n_control)) AS ecdf_mean, max(abs(c1::DOUBLE / n_case - c0::DOUBLE / n_control)) AS ecdf_max
  FROM cum JOIN m USING (covariate, phase) GROUP BY ALL),
sorted AS (SELECT covariate, phase, role, x, row_number() OVER (PARTITION BY covariate, phase, role ORDER BY x) - 1 AS i FROM long),
grid AS (
  SELECT covariate, phase, i, greatest(n_case, n_control) - 1 AS last, i * (n_case - 1) AS p1, i * (n_control - 1) AS p0
  FROM m, unnest(range(greatest(n_case, n_control))) t(i)),
q AS (
  SELECT grid.covariate, grid.phase, a.x + (p1 % last) / last::DOUBLE * (coalesce(b.x, a.x) - a.x) AS q1, c.x + (p0 % last) / last::DOUBLE * (coalesce(d.x, c.x) - c.x) AS q0 FROM grid
  JOIN sorted a ON a.covariate = grid.covariate AND a.phase = grid.phase AND a.role = 'case' AND a.i = p1 // last
  LEFT JOIN sorted b ON b.covariate = grid.covariate AND b.phase = grid.phase AND b.role = 'case' AND b.i = p1 // last + 1
  JOIN sorted c ON c.covariate = grid.covariate AND c.phase = grid.phase AND c.role = 'control' AND c.i = p0 // last
  LEFT JOIN sorted d ON d.covariate = grid.covariate AND d.phase = grid.phase AND d.role = 'control' AND d.i = p0 // last + 1),
eqq AS (SELECT covariate, phase, avg(abs(q1 - q0)) AS eqq_mean, max(abs(q1 - q0)) AS eqq_max FROM q GROUP BY ALL),
report AS (
  SELECT m.*, (mean_case - mean_control) / sqrt((var_case + var_control) / 2) AS smd, var_case / var_control AS variance_ratio, ecdf_mean, ecdf_max, eqq_mean, eqq_max
  FROM m JOIN gaps USING (covariate, phase) JOIN eqq USING (covariate, phase))"""


_METRICS = ("mean_case", "mean_control", "smd", "variance_ratio", "ecdf_mean", "ecdf_max", "eqq_mean", "eqq_max")
_RAW = {"customer": "customer", "price": "price"}
_ALL = _RAW | {"customer^2": "customer * customer", "price^2": "price * price", "customer * price": "customer * price"}
_WIDE = ", ".join(f"max({m}) FILTER (WHERE phase = '{p}') AS {m}_{p}" for p in ("pre", "post") for m in _METRICS)
_WIDE_ROUNDED = ", ".join(f"round({m}_{p}, 6) AS {m}_{p}" for p in ("pre", "post") for m in _METRICS)


def _categorical(rows: str, level: str) -> str:
    """Of rows(role, phase, level, ...): counts by level, both phases side by side. Levels are those of rows before matching."""
    n = ", ".join(f"count(*) FILTER (WHERE role = '{r}' AND phase = '{p}') AS n_{r}_{p}" for p in ("pre", "post") for r in ("case", "control"))
    t = ", ".join(f"count(*) FILTER (WHERE role = '{r}' AND phase = '{p}') AS t_{r}_{p}" for p in ("pre", "post") for r in ("case", "control"))
    p = ", ".join(f"n_{r}_{p} / t_{r}_{p} AS p_{r}_{p}" for p in ("pre", "post") for r in ("case", "control"))
    chi = ", ".join(
        f"sqrt(sum(pow(n_case_{p} - both_{p} * s_case_{p} / s_{p}, 2) / greatest(both_{p} * s_case_{p} / s_{p}, 1e-12) + pow(n_control_{p} - both_{p} * s_control_{p} / s_{p}, 2) / greatest(both_{p} * s_control_{p} / s_{p}, 1e-12)) OVER () / s_{p}) AS cramers_v_{p}"
        for p in ("pre", "post"))
    sums = ", ".join(f"(sum(n_case_{p}) OVER ())::DOUBLE AS s_case_{p}, (sum(n_control_{p}) OVER ())::DOUBLE AS s_control_{p}, (sum(n_case_{p} + n_control_{p}) OVER ())::DOUBLE AS s_{p}, (n_case_{p} + n_control_{p})::DOUBLE AS both_{p}" for p in ("pre", "post"))
    smds = ", ".join(f"coalesce((p_case_{p} - p_control_{p}) / nullif(sqrt((p_case_{p} * (1 - p_case_{p}) + p_control_{p} * (1 - p_control_{p})) / 2), 0), 0) AS smd_{p}" for p in ("pre", "post"))
    return f"""{rows},
totals AS (SELECT {t} FROM labelled),
counted AS (SELECT {level} AS level, {n} FROM labelled WHERE {level} IN (SELECT {level} FROM labelled WHERE phase = 'pre' AND has) GROUP BY 1),
shares AS (SELECT *, {p}, {sums} FROM counted, totals),
levels AS (SELECT *, {smds}, {chi} FROM shares)"""


_LEVEL_COLUMNS = ", ".join(
    [c for p in ("pre", "post") for c in (f"n_case_{p}", f"n_control_{p}", f"round(p_case_{p}, 6) AS p_case_{p}", f"round(p_control_{p}, 6) AS p_control_{p}", f"round(smd_{p}, 6) AS smd_{p}")]
    + [f"round(cramers_v_{p}, 6) AS cramers_v_{p}" for p in ("pre", "post")])
_PRIORITY = _categorical(f"{_SAMPLES},\nlabelled AS (SELECT role, phase, coalesce(nullif(o_orderpriority, '5-LOW'), 'missing') AS lv, TRUE AS has FROM sampled)", "lv")
_SEGMENT = _categorical(
    f"""{_SAMPLES},
labelled AS (SELECT role, phase, CASE WHEN role = 'case' OR o_orderkey % 2 = 0 THEN c_mktsegment ELSE 'missing' END AS lv, role = 'case' OR o_orderkey % 2 = 0 AS has
  FROM sampled JOIN customer ON o_custkey = c_custkey)""",
    "lv",
)


def _subclasses(k: int, reference: str, weight: str) -> str:
    return f"""WITH every AS (SELECT o_orderkey AS unit_id, CASE o_orderstatus WHEN 'P' THEN 'anchor' ELSE 'candidate' END AS role, CASE WHEN o_orderkey % 17 > 0 THEN o_totalprice::DOUBLE END AS score FROM orders WHERE o_orderstatus IN ('P', 'O')),
u AS (SELECT * FROM every WHERE score IS NOT NULL),
r AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS pos, count(*) OVER () AS n FROM u WHERE {reference}),
cuts AS (SELECT score FROM r, range(1, {k}) b(k) WHERE pos = k * (n - 1) // {k}),
placed AS (SELECT u.*, (SELECT count(*) FROM cuts WHERE cuts.score < u.score)::BIGINT AS subclass FROM u),
counts AS (SELECT subclass, count(*) FILTER (WHERE role = 'anchor') AS na, count(*) FILTER (WHERE role = 'candidate') AS nc FROM placed GROUP BY 1),
kept AS (SELECT unit_id, role, subclass, round({weight}, 6) AS weight FROM placed JOIN counts USING (subclass) WHERE na > 0 AND nc > 0)"""


_ATT = _subclasses(6, "role = 'anchor'", "CASE role WHEN 'anchor' THEN 1.0::DOUBLE ELSE na::DOUBLE / nc END")
_ATE = _subclasses(10, "TRUE", "CASE role WHEN 'anchor' THEN (na + nc)::DOUBLE / na ELSE (na + nc)::DOUBLE / nc END")

_MEMBERS = """urgent AS (SELECT o_custkey, min(o_orderdate::DATE) AS event FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
m AS (
  SELECT c_custkey, c_custkey::VARCHAR AS id, c_mktsegment, c_acctbal, event, DATE '1990-01-01' + (c_custkey * 37 % 2000)::INT AS birth,
    CASE WHEN c_custkey % 5 = 0 THEN DATE '1996-01-01' + (c_custkey * 53 % 1500)::INT END AS death,
    CASE WHEN c_custkey % 4 = 0 THEN DATE '1997-01-01' + (c_custkey * 11 % 1200)::INT END AS until, (c_custkey // 3)::VARCHAR AS family
  FROM customer LEFT JOIN urgent ON c_custkey = o_custkey),
cases AS (SELECT * FROM m WHERE event < birth + INTERVAL 72 MONTH)"""
_POOL = f"""{_MEMBERS},
pool0 AS (
  SELECT a.c_mktsegment AS grp, a.id AS anchor_id, a.event AS place, c.id AS candidate_id, abs(datediff('day', a.birth, c.birth))::BIGINT AS days, c.family AS uniq, a.event AS a_event,
    c.event IS NULL OR c.event > a.event AS risk, c.death IS NULL OR c.death > a.event AS alive, c.until IS NULL OR c.until > a.event AS resident
  FROM cases a JOIN m c ON a.c_mktsegment IS NOT DISTINCT FROM c.c_mktsegment AND abs(datediff('day', a.birth, c.birth)) <= 200),
edges AS (SELECT * FROM pool0 WHERE risk AND alive AND resident AND anchor_id <> candidate_id)"""
_TRANSITION = _serial(_POOL, "days, candidate_id")
_FAMILIES = _serial(_POOL.replace("SELECT a.c_mktsegment AS grp", "SELECT 'all' AS grp"), "days, candidate_id", resource="uniq")
_SUPPORT = f"""{_MEMBERS},
scored AS (SELECT *, CASE WHEN c_custkey % 11 > 0 THEN c_acctbal::DOUBLE END AS score FROM m),
scases AS (SELECT * FROM scored WHERE event < birth + INTERVAL 72 MONTH),
bounds AS (SELECT greatest((SELECT min(score) FROM scases), min(score)) AS low, least((SELECT max(score) FROM scases), max(score)) AS high, min(score) AS all_low, max(score) AS all_high FROM scored),
fit AS (SELECT * FROM scored, bounds WHERE score BETWEEN low AND high),
edges AS (
  SELECT a.c_mktsegment AS grp, a.id AS anchor_id, a.event AS place, c.id AS candidate_id, abs(datediff('day', a.birth, c.birth))::BIGINT AS days, NULL::VARCHAR AS uniq
  FROM (SELECT * FROM fit WHERE event < birth + INTERVAL 72 MONTH) a JOIN fit c ON a.c_mktsegment IS NOT DISTINCT FROM c.c_mktsegment AND abs(a.score - c.score) <= 300
  WHERE (c.event IS NULL OR c.event > a.event) AND a.id <> c.id)"""
_SUPPORTED = _serial(_SUPPORT, "days, candidate_id", take="free[1:1]")

_LEARN = """d AS (
  SELECT o_orderkey::VARCHAR AS id, o_orderpriority, o_orderdate::DATE AS day, o_totalprice / 100000 AS x1, (year(o_orderdate) - 1998)::DOUBLE AS x2,
    ((o_totalprice > 200000 AND o_orderkey % 3 > 0) OR (year(o_orderdate) > 1998 AND o_orderkey % 7 = 0))::INT::DOUBLE AS y FROM orders)"""
_P = "greatest(least(1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))), 1 - 1e-8), 1e-8)"
_LOGIT = f"""RECURSIVE {_LEARN},
fit AS (
  SELECT 0 AS it, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 1.0::DOUBLE AS moved
  UNION ALL
  SELECT it + 1, n0, n1, n2, greatest(abs(n0 - b0), abs(n1 - b1), abs(n2 - b2))
  FROM (
    SELECT it, b0, b1, b2,
      (t0 * (m11 * m22 - m12 * m12) - m01 * (t1 * m22 - m12 * t2) + m02 * (t1 * m12 - m11 * t2)) / det AS n0,
      (m00 * (t1 * m22 - m12 * t2) - t0 * (m01 * m22 - m12 * m02) + m02 * (m01 * t2 - t1 * m02)) / det AS n1,
      (m00 * (m11 * t2 - t1 * m12) - m01 * (m01 * t2 - t1 * m02) + t0 * (m01 * m12 - m11 * m02)) / det AS n2
    FROM (
      SELECT *, m00 * (m11 * m22 - m12 * m12) - m01 * (m01 * m22 - m12 * m02) + m02 * (m01 * m12 - m11 * m02) AS det
      FROM (
        SELECT it, b0, b1, b2, sum(w) AS m00, sum(w * x1) AS m01, sum(w * x2) AS m02, sum(w * x1 * x1) + 1e-6 AS m11, sum(w * x1 * x2) AS m12, sum(w * x2 * x2) + 1e-6 AS m22,
          sum(z) AS t0, sum(z * x1) AS t1, sum(z * x2) AS t2
        FROM (SELECT it, b0, b1, b2, x1, x2, p * (1 - p) AS w, p * (1 - p) * (b0 + b1 * x1 + b2 * x2) + y - p AS z FROM (SELECT *, {_P} AS p FROM fit, d WHERE moved > 1e-8 AND it < 100))
        GROUP BY it, b0, b1, b2)))),
last AS (SELECT * FROM fit ORDER BY it DESC LIMIT 1)"""
_NET = f"""RECURSIVE {_LEARN},
size AS (SELECT count(*) AS n, 1 / greatest(0.25 * max(1 + x1 * x1 + x2 * x2) + 0.025, 1e-8) AS step FROM d),
fit AS (
  SELECT 0 AS it, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2
  UNION ALL
  SELECT it + 1, b0 - step * g0, sign(z1) * greatest(abs(z1) - step * 0.025, 0), sign(z2) * greatest(abs(z2) - step * 0.025, 0)
  FROM (SELECT it, b0, g0, step, b1 - step * (g1 + 0.025 * b1) AS z1, b2 - step * (g2 + 0.025 * b2) AS z2
        FROM (SELECT it, b0, b1, b2, step, sum(p - y) / n AS g0, sum((p - y) * x1) / n AS g1, sum((p - y) * x2) / n AS g2 FROM (SELECT *, {_P} AS p FROM fit, d, size WHERE it < 20) GROUP BY it, b0, b1, b2, step, n))),
last AS (SELECT * FROM fit ORDER BY it DESC LIMIT 1)"""
_COV = f"""{_LEARN},
g AS (SELECT y, covar_samp(x1, x1) AS a, covar_samp(x1, x2) AS b, covar_samp(x2, x2) AS c FROM d GROUP BY y),
v AS (SELECT 'pooled_within_groups' AS over, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM g UNION ALL SELECT 'full_sample', covar_samp(x1, x1), covar_samp(x1, x2), covar_samp(x2, x2) FROM d),
i AS (SELECT *, a + 1e-8 AS ra, c + 1e-8 AS rc, (a + 1e-8) * (c + 1e-8) - b * b AS det FROM v)"""

_MATCHED = "per AS (SELECT anchor_id, count(*) AS n FROM pairs GROUP BY 1)"
_REUSED_SUMMARY = f"""{_PAIRS}, {_MATCHED},
t AS (SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS anchors, count(*) AS matched, count(*) FILTER (WHERE n < 2) AS below, sum(n)::BIGINT AS pairs FROM per)"""

ORACLE_SQL = {
    "candidate_edges": f"WITH {_EDGES} SELECT * FROM edges",
    "match_nearest": f"WITH {_NEAREST} {_SHOWN}",
    "match_unique_key": f"WITH {_UNIQUE} {_SHOWN}",
    "match_random": f"WITH {_serial(_ORDERS, "md5(concat(11, chr(58), anchor_id, chr(58), candidate_id)), candidate_id")} {_SHOWN}",
    "match_fallback": f"WITH {_serial(_ORDERS, 'days, candidate_id', take='CASE WHEN len(free) >= 3 THEN free[1:3] WHEN len(free) >= 1 THEN free[1:1] ELSE [] END')} {_SHOWN}",
    "match_replacement": f"WITH {_PAIRS} SELECT * FROM pairs",
    "match_constraints": f"WITH {_CONSTRAINED} SELECT anchor_id, candidate_id, days FROM tested WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY days, candidate_id) <= 2",
    "match_score_caliper": f"WITH {_serial(_SCORED, 'days, candidate_id')} {_SHOWN}",
    "match_summary": f"""WITH {_REUSED_SUMMARY}
SELECT anchors + matched AS total_anchors_evaluated, anchors - matched AS anchors_with_no_candidates, below AS anchors_below_required_ratio, matched AS matched_anchors, 0::BIGINT AS unmatched_anchors, pairs AS pairs_selected,
  0::BIGINT AS used_controls, round(pairs / matched, 6) AS avg_controls_per_case, 'Att' AS requested_estimand, CASE WHEN below > 0 THEN 'Atm' ELSE 'Att' END AS realized_estimand, CASE WHEN below > 0 THEN 'ratio_shortfall' ELSE '' END AS drift_reasons FROM t""",
    "match_diagnostics": f"""WITH {_UNIQUE}, {_MATCHED},
t AS (SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS anchors, count(*) AS matched, count(*) FILTER (WHERE n < 2) AS below, sum(n)::BIGINT AS pairs, (SELECT count(DISTINCT candidate_id) FROM pairs) AS used FROM per)
SELECT anchors AS total_anchors_evaluated, anchors - matched AS anchors_with_no_candidates, below AS anchors_below_required_ratio, matched AS matched_anchors, anchors - matched AS unmatched_anchors, pairs AS pairs_selected, used AS used_controls,
  round(pairs / matched, 6) AS avg_controls_per_case, 'Att' AS requested_estimand, CASE WHEN matched < anchors OR below > 0 THEN 'Atm' ELSE 'Att' END AS realized_estimand,
  concat_ws(',', CASE WHEN matched < anchors THEN 'unmatched_anchors' END, CASE WHEN below > 0 THEN 'ratio_shortfall' END) AS drift_reasons FROM t""",
    "match_exclusions": f"""WITH {_UNIQUE},
first AS (SELECT candidate_id, min(anchor_id::BIGINT) AS turn FROM pairs GROUP BY 1),
values_ AS (SELECT pairs.grp, uniq, min(pairs.anchor_id::BIGINT) AS turn FROM pairs JOIN (SELECT DISTINCT candidate_id, uniq FROM edges) USING (candidate_id) GROUP BY ALL),
why AS (SELECT CASE WHEN first.turn < place THEN 'used_control_replacement_disabled' WHEN values_.turn < place THEN 'unique_key_reused' END AS reason
  FROM edges LEFT JOIN first USING (candidate_id) LEFT JOIN values_ ON values_.grp = edges.grp AND values_.uniq = edges.uniq)
SELECT 'constraint' AS category, reason, count(*) AS n FROM why WHERE reason IS NOT NULL GROUP BY reason""",
    "constraint_exclusions": f"WITH {_CONSTRAINED} SELECT 'constraint' AS category, reason, count(*) AS n FROM tested WHERE reason IS NOT NULL GROUP BY reason",
    "score_exclusions": f"""WITH {_serial(_SCORED, 'days, candidate_id', resource='uniq')},
first AS (SELECT candidate_id, min(anchor_id::BIGINT) AS turn FROM pairs GROUP BY 1),
values_ AS (SELECT pairs.grp, uniq, min(pairs.anchor_id::BIGINT) AS turn FROM pairs JOIN (SELECT DISTINCT candidate_id, uniq FROM edges) USING (candidate_id) GROUP BY ALL),
why AS (SELECT CASE WHEN a.o_orderpriority <> c.o_orderpriority THEN 'strata_mismatch' WHEN first.turn < a.o_orderkey THEN 'used_control_replacement_disabled' WHEN values_.turn < a.o_orderkey THEN 'unique_key_reused'
    WHEN abs(a.o_totalprice::DOUBLE - c.o_totalprice::DOUBLE) > 500.0 THEN 'propensity_score_caliper' END AS reason
  FROM orders a JOIN orders c ON a.o_orderstatus = 'P' AND c.o_orderstatus = 'O' LEFT JOIN first ON first.candidate_id = c.o_orderkey::VARCHAR LEFT JOIN values_ ON values_.grp = a.o_orderpriority AND values_.uniq = c.o_custkey::VARCHAR)
SELECT 'constraint' AS category, reason, count(*) AS n FROM why WHERE reason IS NOT NULL GROUP BY reason""",
    "match_weights": f"WITH {_weights('anchor_id')} SELECT unit_id, role, round(match_weight, 6) AS match_weight FROM uw",
    "match_weights_atc": f"WITH {_weights('candidate_id')} SELECT unit_id, role, round(match_weight, 6) AS match_weight FROM uw",
    "match_weights_realized": f"WITH {_weights(None, _NEAREST)} SELECT unit_id, role, round(match_weight, 6) AS match_weight FROM uw",
    "unit_weight_table": f"""WITH {_weights('anchor_id')},
sw AS (SELECT o_orderkey::VARCHAR AS id, (1 + o_custkey % 3)::DOUBLE AS w FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 2 = 0)
SELECT unit_id, role, round(match_weight, 6) AS match_weight, coalesce(w, 1.0::DOUBLE) AS sampling_weight, round(match_weight * coalesce(w, 1.0::DOUBLE), 6) AS analysis_weight FROM uw LEFT JOIN sw ON id = unit_id""",
    "pair_weights": f"WITH {_weights('anchor_id')} SELECT anchor_id, candidate_id, round(weight, 6) AS weight FROM pw",
    "effective_sample_size": f"WITH {_weights('anchor_id')} SELECT role, round(pow(sum(match_weight), 2) / sum(match_weight * match_weight), 6) AS ess, round(sum(match_weight), 6) AS total FROM uw GROUP BY role",
    "balance_numeric": f"WITH {_numeric(_ALL)}, w AS (SELECT covariate, {_WIDE} FROM report GROUP BY covariate) SELECT covariate, {_WIDE_ROUNDED} FROM w",
    "balance_categorical": f"WITH {_PRIORITY} SELECT 'priority' AS covariate, level, {_LEVEL_COLUMNS} FROM levels",
    "balance_supplemental": f"WITH {_SEGMENT} SELECT level, {_LEVEL_COLUMNS} FROM levels",
    "balance_thresholds": f"""WITH {_numeric(_RAW)}, c AS (SELECT covariate, abs(smd) <= 0.1 AS smd_ok, variance_ratio BETWEEN 0.8 AND 1.25 AS ratio_ok, ecdf_max <= 0.1 AS ecdf_ok FROM report WHERE phase = 'post'),
p AS (SELECT *, smd_ok AND ratio_ok AND ecdf_ok AS passed FROM c) SELECT *, bool_and(passed) OVER () AS all_passed FROM p""",
    "balance_projected": f"""WITH {_PAIRS},
people AS (SELECT o_orderkey::VARCHAR AS id, o_orderstatus, o_totalprice / 100000 AS price, o_custkey / 1000 AS customer, o_orderpriority FROM orders),
rows_ AS (
  SELECT 'before' AS phase, CASE o_orderstatus WHEN 'P' THEN 1 ELSE 0 END AS treated, * FROM people
  UNION ALL SELECT 'after', 1, * FROM people WHERE id IN (SELECT anchor_id FROM pairs) UNION ALL SELECT 'after', 0, * FROM people WHERE id IN (SELECT candidate_id FROM pairs)),
numbers AS (
  SELECT phase, covariate, (avg(x) FILTER (WHERE treated = 1) - avg(x) FILTER (WHERE treated = 0)) / sqrt((var_samp(x) FILTER (WHERE treated = 1) + var_samp(x) FILTER (WHERE treated = 0)) / 2) AS v
  FROM (SELECT phase, treated, unnest(['price', 'customer']) AS covariate, unnest([price, customer]) AS x FROM rows_) GROUP BY ALL),
shares AS (SELECT phase, o_orderpriority, count(*) FILTER (WHERE treated = 1) AS k1, count(*) FILTER (WHERE treated = 0) AS k0 FROM rows_ GROUP BY ALL),
gaps AS (SELECT phase, max(gap) AS v FROM (SELECT phase, abs(k1 / sum(k1) OVER (PARTITION BY phase) - k0 / sum(k0) OVER (PARTITION BY phase)) AS gap FROM shares) GROUP BY phase),
both_ AS (SELECT covariate, 'numeric' AS metric_type, phase, v FROM numbers UNION ALL SELECT 'priority', 'categorical_max_abs_diff', phase, v FROM gaps)
SELECT covariate, metric_type, round(max(v) FILTER (WHERE phase = 'before'), 6) AS smd_before, round(max(v) FILTER (WHERE phase = 'after'), 6) AS smd_after FROM both_ GROUP BY ALL""",
    "balance_diagnostics": f"""WITH {_PAIRS}, k AS (
  SELECT unnest(['anchor:priority=' || o_orderpriority, 'anchor:customer=' || o_custkey]) AS key, 1 AS a, 0 AS c FROM pairs JOIN orders ON anchor_id = o_orderkey::VARCHAR
  UNION ALL SELECT unnest(['candidate:priority=' || o_orderpriority, 'candidate:customer=' || o_custkey]), 0, 1 FROM pairs JOIN orders ON candidate_id = o_orderkey::VARCHAR)
SELECT key, sum(a)::BIGINT AS anchor_count, sum(c)::BIGINT AS candidate_count FROM k GROUP BY key""",
    "csv_summary": f"""WITH {_REUSED_SUMMARY}
SELECT place::BIGINT AS place, line FROM (SELECT unnest(range(11)) AS place, unnest(['metric,value', 'total_anchors_evaluated,' || (anchors + matched), 'matched_anchors,' || matched, 'unmatched_anchors,0', 'pairs_selected,' || pairs, 'anchors_with_no_candidates,' || (anchors - matched),
  'anchors_below_required_ratio,' || below, 'used_controls,0', 'avg_controls_per_case,' || printf('%.4f', pairs / matched), 'requested_estimand,Att', 'realized_estimand,' || CASE WHEN below > 0 THEN 'Atm' ELSE 'Att' END]) AS line FROM t)""",
    "csv_exclusions": f"""WITH {_CONSTRAINED}, n AS (SELECT reason, count(*) AS n FROM tested WHERE reason IS NOT NULL GROUP BY reason)
SELECT 0::BIGINT AS place, 'reason,count' AS line UNION ALL SELECT row_number() OVER (ORDER BY CASE reason WHEN 'gender_mismatch' THEN 0 ELSE 1 END, reason), reason || ',' || n FROM n""",
    "csv_numeric": f"""WITH {_numeric(_RAW)}, w AS (SELECT covariate, {_WIDE} FROM report GROUP BY covariate)
SELECT 0::BIGINT AS place, 'covariate,mean_case_pre,mean_control_pre,smd_pre,var_ratio_pre,ecdf_mean_diff_pre,ecdf_max_diff_pre,eqq_mean_diff_pre,eqq_max_diff_pre,mean_case_post,mean_control_post,smd_post,var_ratio_post,ecdf_mean_diff_post,ecdf_max_diff_post,eqq_mean_diff_post,eqq_max_diff_post' AS line
UNION ALL SELECT row_number() OVER (ORDER BY covariate), covariate || ',' || concat_ws(',', {", ".join(f"printf('%.4f', {m}_{p})" for p in ("pre", "post") for m in _METRICS)}) FROM w""",
    "csv_categorical": f"""WITH {_PRIORITY}
SELECT 0::BIGINT AS place, 'covariate,level,p_case_pre,p_control_pre,smd_pre,p_case_post,p_control_post,smd_post,cramers_v_pre,cramers_v_post' AS line
UNION ALL SELECT row_number() OVER (ORDER BY level), 'priority,' || level || ',' || concat_ws(',', {", ".join(f"printf('%.4f', {c}_{p})" for p in ("pre", "post") for c in ("p_case", "p_control", "smd"))}, printf('%.4f', cramers_v_pre), printf('%.4f', cramers_v_post)) FROM levels""",
    "subclassification": f"{_ATT} SELECT * FROM kept",
    "subclassification_ate": f"{_ATE} SELECT * FROM kept",
    "subclass_summary": f"{_ATT} SELECT k AS subclass, coalesce(na, 0) AS anchor_count, coalesce(nc, 0) AS candidate_count, round(na::DOUBLE / (na + nc), 6) AS propensity FROM range(6) b(k) LEFT JOIN counts ON subclass = k",
    "subclass_dropped": f"""{_ATT} SELECT unit_id, role, 'no_score' AS why, CASE role WHEN 'anchor' THEN 0 ELSE 1 END::BIGINT AS place FROM every WHERE score IS NULL
UNION ALL SELECT unit_id, role, 'no_overlap', CASE role WHEN 'anchor' THEN 2 ELSE 3 END FROM u WHERE unit_id NOT IN (SELECT unit_id FROM kept)""",
    "transition_matching": f"WITH {_TRANSITION} {_SHOWN}",
    "transition_exclusions": f"""WITH {_TRANSITION},
taken AS (SELECT pairs.candidate_id, a.event AS taken_at, a.id AS taken_by FROM pairs JOIN m a ON a.id = pairs.anchor_id),
why AS (SELECT CASE WHEN NOT risk THEN 'additional_filter' WHEN (taken_at, taken_by) < (a_event, anchor_id) THEN 'used_control_replacement_disabled' WHEN anchor_id = pool0.candidate_id THEN 'self_match'
    WHEN NOT alive THEN 'control_not_alive_at_index_date' WHEN NOT resident THEN 'control_non_resident_at_index_date' END AS reason
  FROM pool0 LEFT JOIN taken ON taken.candidate_id = pool0.candidate_id)
SELECT CASE reason WHEN 'additional_filter' THEN reason ELSE 'constraint' END AS category, reason, count(*) AS n FROM why WHERE reason IS NOT NULL GROUP BY ALL""",
    "transition_families": f"WITH {_FAMILIES} {_SHOWN}",
    "transition_support": f"WITH {_SUPPORTED} {_SHOWN}",
    "transition_diagnostics": f"""WITH {_SUPPORTED},
t AS (SELECT (SELECT count(*) FROM scases) AS cases, (SELECT count(*) FROM fit WHERE event < birth + INTERVAL 72 MONTH) AS kept, (SELECT count(*) FROM scored) AS everyone, (SELECT count(*) FROM fit) AS inside, (SELECT count(DISTINCT anchor_id) FROM pairs) AS matched)
SELECT cases AS total_anchors_evaluated, matched AS matched_anchors, kept - matched AS unmatched_anchors, kept - matched AS anchors_with_no_candidates, cases - kept AS trimmed_anchors, everyone - inside AS trimmed_candidates,
  low AS support_overlap_low, high AS support_overlap_high, all_low AS candidate_bounds_low, all_high AS candidate_bounds_high, CASE WHEN kept > matched OR cases > kept OR everyone > inside THEN 'Atm' ELSE 'Att' END AS realized_estimand,
  concat_ws(',', CASE WHEN cases > kept OR everyone > inside THEN 'common_support_trimming' END, CASE WHEN kept > matched THEN 'unmatched_anchors' END) AS drift_reasons FROM t, bounds""",
    "propensity_scores": f"WITH {_LOGIT} SELECT id, y::BIGINT AS label, round({_P}, 6) AS probability, round(b0 + b1 * x1 + b2 * x2, 6) AS linear_predictor FROM d, last",
    "elastic_net_scores": f"WITH {_NET} SELECT id, round({_P}, 6) AS probability FROM d, last",
    "propensity_match": f"""WITH {_LOGIT}, s AS (SELECT d.*, {_P} AS p FROM d, last)
SELECT a.id AS anchor_id, c.id AS candidate_id, abs(datediff('day', a.day, c.day))::BIGINT AS days FROM s a JOIN s c ON a.o_orderpriority = c.o_orderpriority AND abs(a.p - c.p) <= 0.002
WHERE a.y = 1 AND c.y = 0 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY days, c.id) <= 2""",
    "mahalanobis_preparation": f"""WITH {_COV} SELECT over, cell::BIGINT AS cell, round(covariance, 6) AS covariance, round(inverse, 6) AS inverse
FROM (SELECT over, unnest(range(4)) AS cell, unnest([a, b, b, c]) AS covariance, unnest([rc / det, -b / det, -b / det, ra / det]) AS inverse FROM i)""",
    "mahalanobis_match": f"""WITH {_COV}
SELECT p.id AS anchor_id, q.id AS candidate_id, abs(datediff('day', p.day, q.day))::BIGINT AS days FROM i JOIN d p ON p.y = 1 AND over = 'pooled_within_groups' JOIN d q ON q.y = 0 AND p.o_orderpriority = q.o_orderpriority
WHERE rc / det * pow(p.x1 - q.x1, 2) - 2 * b / det * (p.x1 - q.x1) * (p.x2 - q.x2) + ra / det * pow(p.x2 - q.x2, 2) <= 0.0001 QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY days, q.id) <= 2""",
    "rank_transform": f"""WITH {_LEARN} SELECT id, rank() OVER (ORDER BY x1) + (count(*) OVER (PARTITION BY x1) - 1) / 2 AS price_rank, rank() OVER (ORDER BY x2) + (count(*) OVER (PARTITION BY x2) - 1) / 2 AS year_rank FROM d""",
}
