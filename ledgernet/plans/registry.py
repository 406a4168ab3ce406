"""Query registry: one Spark plan and one DuckDB twin per operator.

Spark side: every callable takes ``(spark, sf_dir)`` and returns a lazy
DataFrame over the whole fixture tables.  SQL side: an independent, naive
formulation over the same parquet views, used as the correctness oracle.
Doubles are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgernet.catalog import FEATURE_CATALOGUE, SIMPLE_FEATURES, selected_features, stat_columns
from ledgernet.functions.draws import uniform_sql
from ledgernet.functions.stats import stats_sql
from ledgernet.operators import classify as clf
from ledgernet.operators import egonet as ego
from ledgernet.operators import embed as emb
from ledgernet.operators import features as feat
from ledgernet.operators import graph as gr
from ledgernet.operators import metrics as met
from ledgernet.operators import sampling as smp
from ledgernet.operators import transactions as tx
from ledgernet.operators import traverse as trv
from ledgernet.operators import walks as wk
from ledgernet.operators.scaling import minmax_scale, zscore
from ledgernet.plans import pipelines as pl
from ledgernet.plans.oracle import rounded, rounded_sql
from ledgernet.session import cut_lineage, scratch_table
from ledgernet.sources import fixtures as fx

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


E = fx.TX_EDGES_SQL
N = fx.TX_NODES_SQL

# ---------------------------------------------------------------- A1-A7
_TX_DOUBLES = [c for c in tx.TX_FEATURE_COLUMNS if c not in ("degree", "in_degree", "out_degree")]

_INC_SQL = f"""
e AS {E},
inc AS (
  SELECT target AS node, "timestamp" AS ts, amount, 1 AS is_in,
         CASE WHEN source = target THEN 1 ELSE 0 END AS is_out FROM e
  UNION ALL
  SELECT source, "timestamp", amount, 0, 1 FROM e WHERE source <> target)"""


def _interval_sql() -> str:
    pivots = ",\n  ".join(
        f"max(CASE WHEN dir = '{d}' THEN {s}_x END) AS {s}_{d}_tx_interval"
        for d in ("in", "out", "all") for s in ("avg", "min", "max", "sum", "std", "ent"))
    return f"""
dt AS (SELECT node, 'in' AS dir, ts FROM inc WHERE is_in = 1
       UNION ALL SELECT node, 'out', ts FROM inc WHERE is_out = 1
       UNION ALL SELECT node, 'all', ts FROM inc),
gaps AS (SELECT node, dir, (ts - lag(ts) OVER (PARTITION BY node, dir ORDER BY ts)) / 60.0 AS g FROM dt),
gs AS (SELECT node, dir, {stats_sql('g', 'x')} FROM gaps WHERE g IS NOT NULL GROUP BY node, dir),
iv AS (SELECT node,
  {pivots}
  FROM gs GROUP BY node)"""


def _amount_sql() -> str:
    i = "CASE WHEN is_in = 1 THEN amount END"
    o = "CASE WHEN is_out = 1 THEN amount END"
    return f"""
amt AS (SELECT node, count(*) AS degree,
  count(CASE WHEN is_in = 1 THEN 1 END) AS in_degree,
  count(CASE WHEN is_out = 1 THEN 1 END) AS out_degree,
  {stats_sql(i, 'amount_in_tx')},
  {stats_sql(o, 'amount_out_tx')},
  {stats_sql('amount', 'amount_all_tx')}
  FROM inc GROUP BY node)"""


def _tx_features_select(src: str) -> str:
    cols = ", ".join(
        [f"{src}.{c}" for c in ("degree", "in_degree", "out_degree")]
        + [f"coalesce({'iv' if 'interval' in c else 'amt'}.{c}, 0) AS {c}" for c in _TX_DOUBLES])
    return cols


TX_FEATURES_SQL = rounded_sql(f"""
WITH {_INC_SQL},
{_amount_sql()},
{_interval_sql()}
SELECT amt.node, {_tx_features_select('amt')}
FROM amt LEFT JOIN iv ON amt.node = iv.node""", _TX_DOUBLES)


@register("tx_features", TX_FEATURES_SQL)
def q_tx_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, amount statistics and gap statistics per node."""
    return rounded(tx.transaction_features(fx.tx_edges(spark, sf_dir)))




# ---------------------------------------------------------------- A8-A15 egonet


def _ego_ctes(variant: str) -> str:
    if variant == "multi":
        g = "SELECT source, target, count(*) AS c, sum(amount) AS a FROM e GROUP BY source, target"
    else:
        g = "SELECT DISTINCT source, target, 1 AS c, 1.0 AS a FROM e"
    return f"""
g AS ({g}),
gn AS (SELECT source AS node FROM g UNION SELECT target FROM g),
m AS (SELECT node AS u, node AS v FROM gn UNION SELECT source, target FROM g),
ee AS (SELECT m1.u, g.source, g.target, g.c, g.a FROM m m1 JOIN g ON m1.v = g.source
       JOIN m m2 ON m2.u = m1.u AND m2.v = g.target),
ein AS (SELECT u, target AS v, sum(c) AS ci, sum(a) AS ai FROM ee GROUP BY u, target),
eout AS (SELECT u, source AS v, sum(c) AS co, sum(a) AS ao FROM ee GROUP BY u, source),
deg AS (SELECT node, sum(dout) AS dout, sum(din) AS din FROM
        (SELECT source AS node, c AS dout, 0 AS din FROM g UNION ALL SELECT target, 0, c FROM g) GROUP BY node),
x AS (SELECT m.u, m.v, CAST(coalesce(ein.ci, 0) AS BIGINT) AS ci, CAST(coalesce(eout.co, 0) AS BIGINT) AS co,
             CAST(coalesce(ein.ai, 0) AS DOUBLE) AS ai, CAST(coalesce(eout.ao, 0) AS DOUBLE) AS ao,
             CAST(d.din AS BIGINT) AS din, CAST(d.dout AS BIGINT) AS dout
      FROM m LEFT JOIN ein ON ein.u = m.u AND ein.v = m.v
             LEFT JOIN eout ON eout.u = m.u AND eout.v = m.v
             JOIN deg d ON d.node = m.v)"""


def _ego_select(variant: str) -> str:
    nv = "CASE WHEN v <> u THEN"
    stats = [stats_sql(f"{nv} CAST(ci + co AS DOUBLE) END", "neighbor_degree")]
    if variant == "multi":
        stats.append(stats_sql(f"{nv} ai + ao END", "neighbor_w_degree"))
    stats += [stats_sql(f"{nv} CAST(ci AS DOUBLE) END", "neighbor_in_degree"),
              stats_sql(f"{nv} CAST(co AS DOUBLE) END", "neighbor_out_degree")]
    within = "CAST(sum(co) AS BIGINT) AS no_edge_within_egonet"
    if variant == "multi":
        e_in = f"CAST(coalesce(sum({nv} din - ci END), 0) AS BIGINT)"
        e_out = f"CAST(coalesce(sum({nv} dout - co END), 0) AS BIGINT)"
        head = [within, f"{e_in} AS no_edge_in_egonet", f"{e_out} AS no_edge_out_egonet",
                f"{e_in} + {e_out} AS no_edge_all_egonet"]
    else:
        k = "count(CASE WHEN v <> u THEN 1 END)"
        din_u = "max(CASE WHEN v = u THEN din END)"
        dout_u = "max(CASE WHEN v = u THEN dout END)"
        ci_u = "max(CASE WHEN v = u THEN ci END)"
        e_in = f"CAST({k} * ({din_u} - {ci_u}) AS BIGINT)"
        e_out = f"CAST({k} * ({dout_u} - {dout_u}) AS BIGINT)"
        head = [f"CAST({din_u} + {dout_u} AS BIGINT) AS degree", f"CAST({din_u} AS BIGINT) AS in_degree",
                f"CAST({dout_u} AS BIGINT) AS out_degree", within,
                f"{e_in} AS no_edge_in_egonet", f"{e_out} AS no_edge_out_egonet",
                f"{e_in} + {e_out} AS no_edge_all_egonet"]
    return ",\n  ".join(["u AS node"] + head + stats)


def ego_sql(variant: str) -> str:
    cols = ego.MULTI_EGO_COLUMNS if variant == "multi" else ego.SIMPLE_EGO_COLUMNS
    doubles = [c for c in cols if c.split("_")[0] in ("avg", "min", "max", "sum", "std", "ent")]
    return rounded_sql(f"""
WITH e AS {E},
{_ego_ctes(variant)}
SELECT {_ego_select(variant)}
FROM x GROUP BY u""", doubles)


@register("egonet_multigraph", ego_sql("multi"))
def q_egonet_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8 + A8-A12: multigraph egonet edge counts and neighbour degree statistics."""
    return rounded(ego.egonet_features(fx.tx_edges(spark, sf_dir), "multi"))


@register("egonet_simple", ego_sql("simple"))
def q_egonet_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple-graph degrees, anchor-based egonet counts, neighbour stats."""
    return rounded(ego.egonet_features(fx.tx_edges(spark, sf_dir), "simple"))


# ---------------------------------------------------------------- A16-A18 feature tables

_COUNT_COLS = {"degree", "in_degree", "out_degree", "no_edge_within_egonet", "no_edge_in_egonet",
               "no_edge_out_egonet", "no_edge_all_egonet"}
_MULTI_NAMES = [n for n, _ in FEATURE_CATALOGUE if n not in ("node", "address", "isp", "is_anchor")]


def _ego_cte(variant: str, name: str) -> str:
    return f"""{_ego_ctes(variant)},
{name} AS (SELECT {_ego_select(variant)} FROM x GROUP BY u)"""


def node_features_sql(anchors_only: bool = False, round_doubles: bool = True) -> str:
    src = {c: ("amt" if c in ("degree", "in_degree", "out_degree") or "amount" in c
               else "iv" if "interval" in c else "ego") for c in _MULTI_NAMES}
    cols = ", ".join(f"coalesce({src[c]}.{c}, 0) AS {c}" for c in _MULTI_NAMES)
    where = "WHERE n.is_anchor = 1" if anchors_only else ""
    inner = f"""
WITH nodes AS {N}, {_INC_SQL},
{_amount_sql()},
{_interval_sql()},
{_ego_cte('multi', 'ego')}
SELECT n.node, n.address, n.isp, n.is_anchor, {cols}
FROM nodes n LEFT JOIN amt ON amt.node = n.node LEFT JOIN iv ON iv.node = n.node
     LEFT JOIN ego ON ego.node = n.node {where}"""
    if not round_doubles:
        return inner
    return rounded_sql(inner, [c for c in _MULTI_NAMES if c not in _COUNT_COLS])


@register("node_features", node_features_sql())
def q_node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 67-feature table for every node (zeros for isolated nodes)."""
    return rounded(feat.node_features(fx.tx_edges(spark, sf_dir), fx.tx_nodes(spark, sf_dir)))


@register("anchor_node_features", node_features_sql(anchors_only=True))
def q_anchor_node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 + J3 + A16: features of the anchor nodes only (roots semi-joined first)."""
    nodes = fx.tx_nodes(spark, sf_dir)
    return rounded(feat.node_features(fx.tx_edges(spark, sf_dir), nodes, roots=feat.anchors(nodes)))


def _simple_features_sql(where: str = "") -> str:
    cols = ", ".join(f"coalesce(ego.{c}, 0) AS {c}" for c in SIMPLE_FEATURES)
    return f"""
WITH e AS {E}, nodes AS {N},
{_ego_cte('simple', 'ego')},
sf AS (SELECT n.node, n.address, n.isp, n.is_anchor, {cols}
       FROM nodes n LEFT JOIN ego ON ego.node = n.node {where})"""


@register("anchor_simple_features", rounded_sql(
    _simple_features_sql("WHERE n.is_anchor = 1") + "\nSELECT * FROM sf",
    [c for c in SIMPLE_FEATURES if c not in _COUNT_COLS]))
def q_anchor_simple_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 simple-graph features of the anchor nodes."""
    nodes = fx.tx_nodes(spark, sf_dir)
    return rounded(feat.simple_node_features(fx.tx_edges(spark, sf_dir), nodes, roots=feat.anchors(nodes)))


def _zscore_select(cols: list[str]) -> str:
    out = []
    for c in cols:
        mu, sd = f"avg(CAST({c} AS DOUBLE)) OVER ()", f"stddev_pop(CAST({c} AS DOUBLE)) OVER ()"
        out.append(f"CASE WHEN {sd} <> 0 THEN (CAST({c} AS DOUBLE) - {mu}) / {sd} "
                   f"ELSE CAST({c} AS DOUBLE) - {mu} END AS {c}")
    return ", ".join(out)


@register("simple_features_scaled", rounded_sql(
    _simple_features_sql() + f"\nSELECT node, address, isp, is_anchor, {_zscore_select(SIMPLE_FEATURES)} FROM sf",
    list(SIMPLE_FEATURES)))
def q_simple_features_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18 + M3: simple-graph features of all nodes, z-scored over all rows."""
    f = feat.simple_node_features(fx.tx_edges(spark, sf_dir), fx.tx_nodes(spark, sf_dir))
    return rounded(zscore(f, list(SIMPLE_FEATURES)))


def _minmax_select(cols: list[str]) -> str:
    out = []
    for c in cols:
        mn, mx = f"min(CAST({c} AS DOUBLE)) OVER ()", f"max(CAST({c} AS DOUBLE)) OVER ()"
        out.append(f"CASE WHEN {mx} - {mn} <> 0 THEN (CAST({c} AS DOUBLE) - {mn}) / ({mx} - {mn}) "
                   f"ELSE CAST({c} AS DOUBLE) - {mn} END AS {c}")
    return ", ".join(out)


@register("anchor_features_minmax", rounded_sql(
    _simple_features_sql("WHERE n.is_anchor = 1") + f"\nSELECT node, address, isp, is_anchor, "
    f"{_minmax_select(SIMPLE_FEATURES)} FROM sf", list(SIMPLE_FEATURES)))
def q_anchor_features_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1/M2: min-max scaling of the anchor feature table (constant column -> 0)."""
    nodes = fx.tx_nodes(spark, sf_dir)
    f = feat.simple_node_features(fx.tx_edges(spark, sf_dir), nodes, roots=feat.anchors(nodes))
    return rounded(minmax_scale(f, list(SIMPLE_FEATURES)))


# ---------------------------------------------------------------- G1-G9 graph construction
@register("weighted_edge_list", rounded_sql(f"""
WITH e AS {E},
g AS (SELECT source, target, count(*) AS n_tx, sum(coalesce(amount, 0)) AS amount,
             max(coalesce("timestamp", 0)) AS ts FROM e GROUP BY source, target),
tot AS (SELECT node, sum(amount) AS at, sum(CAST(ts AS DOUBLE)) AS tt, count(*) AS d FROM
        (SELECT source AS node, amount, ts FROM g UNION ALL SELECT target, amount, ts FROM g) GROUP BY node)
SELECT g.source, g.target,
  (CASE WHEN tot.at <> 0 THEN g.amount / tot.at ELSE 0 END)
  * (CASE WHEN tot.tt <> 0 THEN CAST(g.ts AS DOUBLE) / tot.tt ELSE 0 END)
  * (CAST(g.n_tx AS DOUBLE) / tot.d) AS weight
FROM g JOIN tot ON tot.node = g.source""", ["weight"], digits=15))
def q_weighted_edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4 + G5: collapsed, normalised, weighted simple edge list."""
    w = gr.weighted_edge_list(fx.tx_edges(spark, sf_dir))
    # weights are products of three shares (tiny): compare at 15 decimals
    return w.select("source", "target", (F.round("weight", 15) + F.lit(0.0)).alias("weight"))


@register("unweighted_edge_list", f"""
WITH e AS {E} SELECT DISTINCT source, target, 1.0 AS weight FROM e""")
def q_unweighted_edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2 + G3: simple edges with unit weight."""
    return gr.unweighted_edge_list(fx.tx_edges(spark, sf_dir))


@register("out_degrees", f"""
WITH e AS {E}, nodes AS {N},
d AS (SELECT source AS node, count(DISTINCT target) AS out_degree FROM e GROUP BY source)
SELECT n.node, CAST(coalesce(d.out_degree, 0) AS BIGINT) AS out_degree,
       CAST(floor(log2(coalesce(d.out_degree, 0) + 1)) AS INTEGER) AS log_degree
FROM nodes n LEFT JOIN d ON d.node = n.node""")
def q_out_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-degree and log bucket per node."""
    return gr.out_degrees(fx.tx_nodes(spark, sf_dir), fx.tx_edges(spark, sf_dir))


@register("graph_summary", f"""
WITH e AS {E}
SELECT (SELECT count(*) FROM (SELECT source AS n FROM e UNION SELECT target FROM e)) AS n_nodes,
       CAST(count(*) AS BIGINT) AS n_edges,
       (SELECT count(*) FROM (SELECT DISTINCT source, target FROM e)) AS n_pairs,
       CAST(sum(CASE WHEN source = target THEN 1 ELSE 0 END) AS BIGINT) AS n_self_loop_tx
FROM e""")
def q_graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node / transaction / pair / self-loop counts."""
    return gr.graph_summary(fx.tx_edges(spark, sf_dir))


@register("collapsed_edges", rounded_sql(f"""
WITH e AS {E}
SELECT source, target, count(*) AS n_tx, sum(coalesce(amount, 0)) AS amount,
       max(coalesce("timestamp", 0)) AS "timestamp" FROM e GROUP BY source, target""", ["amount"]))
def q_collapsed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel transactions collapsed with multiplicity, amount, latest time."""
    return rounded(gr.collapse_edges(fx.tx_edges(spark, sf_dir)))


# ---------------------------------------------------------------- S3/S4/J1/P6/P7 published set
@register("labeled_published", rounded_sql(f"""
WITH f AS {fx.pub_features_sql()}, c AS {fx.PUB_CLASSES_SQL}
SELECT f.*, c."txId", CASE WHEN c.label = 'unknown' THEN '0' ELSE c.label END AS label,
       CAST(CASE WHEN c.label = '1' THEN 1 ELSE 0 END AS INTEGER) AS y
FROM f LEFT JOIN c ON f.address = c."txId\"""", [f"f_{i}" for i in range(64)]))
def q_labeled_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + S4 + J1 + P6 + P7: positional published features with recoded labels."""
    lab = feat.labeled_published(fx.pub_features(spark, sf_dir), fx.pub_classes(spark, sf_dir))
    return rounded(lab.withColumn("y", feat.binary_label("label")))



# ---------------------------------------------------------------- M4 / U1 sampling


@register("stratified_split", f"""
WITH a AS (SELECT * FROM {N} WHERE is_anchor = 1),
c AS (SELECT isp, count(*) AS n FROM a GROUP BY isp),
t AS (SELECT CAST(ceil(count(*) * 0.2) AS BIGINT) AS n_draws, count(*) AS tot FROM a),
al AS (SELECT c.isp, floor(t.n_draws * c.n / t.tot) AS fl,
              t.n_draws * c.n / t.tot - floor(t.n_draws * c.n / t.tot) AS rem, t.n_draws FROM c, t),
al2 AS (SELECT isp, fl, n_draws - sum(fl) OVER () AS need,
               row_number() OVER (ORDER BY rem DESC, isp ASC) AS rk FROM al),
k AS (SELECT isp, CAST(fl + CASE WHEN rk <= need THEN 1 ELSE 0 END AS BIGINT) AS k FROM al2),
r AS (SELECT a.node, a.isp, row_number() OVER (PARTITION BY a.isp ORDER BY {uniform_sql(42, 'a.node')}, a.node) AS rn
      FROM a)
SELECT r.node, r.isp, r.rn <= k.k AS is_test FROM r JOIN k ON k.isp = r.isp""")
def q_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: exact stratified 80/20 split of the anchor nodes by class, seed 42."""
    a = feat.anchors(fx.tx_nodes(spark, sf_dir)).select("node", "isp")
    return smp.stratified_split(a, "isp", "node", seed=42).select("node", "isp", "is_test")


_LAB_SQL = f"""lab AS (SELECT f.address, c.label FROM {fx.pub_features_sql(1)} f
               LEFT JOIN {fx.PUB_CLASSES_SQL} c ON f.address = c."txId")"""


@register("balanced_undersample", f"""
WITH {_LAB_SQL},
reps AS (SELECT range AS rep FROM range(50)),
pos AS (SELECT address, label FROM lab WHERE label = '1'),
neg AS (SELECT address, label FROM lab WHERE label = '2'),
rk AS (SELECT reps.rep, neg.address, neg.label,
              row_number() OVER (PARTITION BY reps.rep ORDER BY
                (('0x' || substr(md5(concat_ws('|', CAST(reps.rep + 42 AS VARCHAR), CAST(neg.address AS VARCHAR))), 1, 13))::BIGINT
                 / 4503599627370496.0), neg.address) AS rn
       FROM neg, reps)
SELECT reps.rep, pos.address, pos.label FROM pos, reps
UNION ALL
SELECT rep, address, label FROM rk WHERE rn <= (SELECT count(*) FROM pos)""")
def q_balanced_undersample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1 + U2 + O4: 50 balanced repetitions (all illicit + as many random licit)."""
    lab = feat.labeled_published(fx.pub_features(spark, sf_dir, 1), fx.pub_classes(spark, sf_dir))
    s = smp.balanced_undersample(lab.select("address", "label"), "label", "address", repetitions=50)
    return s.select("rep", "address", "label")


# ---------------------------------------------------------------- M8-M10 metrics
_PRED_SQL = f"""{_LAB_SQL},
d AS (SELECT CAST(CASE WHEN lab.label = '1' THEN 1 ELSE 0 END AS INTEGER) AS y,
             CAST(f.f_0 AS DOUBLE) AS s FROM lab JOIN {fx.pub_features_sql(1)} f ON f.address = lab.address)"""


@register("binary_metrics", rounded_sql(f"""
WITH {_PRED_SQL},
ps AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM d GROUP BY s),
cu AS (SELECT s, pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              AS below FROM ps),
auc AS (SELECT sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM cu),
cm AS (SELECT count(CASE WHEN y = 1 AND s > 0 THEN 1 END) AS tp, count(CASE WHEN y <> 1 AND s > 0 THEN 1 END) AS fp,
              count(CASE WHEN y = 1 AND NOT s > 0 THEN 1 END) AS fn,
              count(CASE WHEN y = CAST(s > 0 AS INTEGER) THEN 1 END) AS ok, count(*) AS n FROM d)
SELECT CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS prec,
       CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rec,
       CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
       ok / n AS acc, auc.auc FROM cm, auc""", ["prec", "rec", "f1", "acc", "auc"]))
def q_binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 + M10: binary precision/recall/F1/accuracy and tie-aware ROC-AUC of the
    rule ``f_0 > 0`` against the illicit label (scores taken from the data)."""
    lab = feat.labeled_published(fx.pub_features(spark, sf_dir, 1), fx.pub_classes(spark, sf_dir))
    d = lab.select(feat.binary_label("label").alias("y"), F.col("f_0").alias("score"),
                   (F.col("f_0") > 0).cast("int").alias("pred"))
    return rounded(met.binary_report(d).crossJoin(met.roc_auc(d)))


@register("macro_metrics", rounded_sql(f"""
WITH lab AS (SELECT f.address, CASE WHEN c.label = 'unknown' THEN '0' ELSE c.label END AS y, f.f_0 AS s
             FROM {fx.pub_features_sql(1)} f LEFT JOIN {fx.PUB_CLASSES_SQL} c ON f.address = c."txId"),
d AS (SELECT y, CASE WHEN s > 0.5 THEN '1' WHEN s > 0 THEN '2' ELSE '0' END AS p FROM lab),
cls AS (SELECT y AS c FROM d UNION SELECT p FROM d),
pc AS (SELECT cls.c, CAST(count(CASE WHEN y = c AND p = c THEN 1 END) AS DOUBLE) AS tp,
              CAST(count(CASE WHEN y <> c AND p = c THEN 1 END) AS DOUBLE) AS fp,
              CAST(count(CASE WHEN y = c AND p <> c THEN 1 END) AS DOUBLE) AS fn
       FROM cls, d GROUP BY cls.c)
SELECT avg(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END) AS prec,
       avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END) AS rec,
       avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) AS f1,
       (SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) FROM d) AS acc
FROM pc""", ["prec", "rec", "f1", "acc"]))
def q_macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: macro precision/recall/F1 and accuracy over three classes for a
    threshold rule on ``f_0``."""
    lab = feat.labeled_published(fx.pub_features(spark, sf_dir, 1), fx.pub_classes(spark, sf_dir))
    s = F.col("f_0")
    d = lab.select(F.col("label").alias("y"),
                   F.when(s > 0.5, "1").when(s > 0, "2").otherwise("0").alias("pred"))
    return rounded(met.macro_report(d))



# ---------------------------------------------------------------- T1-T7 balls and role ids

K_HOPS = 4
_GRAPH_SQL = f"""e AS {E},
se AS (SELECT DISTINCT source, target FROM e),
gn AS (SELECT source AS node FROM se UNION SELECT target FROM se)"""
_BALL_SQL = f"""r(root, node, layer) AS (
  SELECT node, node, 0 FROM gn
  UNION SELECT r.root, se.target, r.layer + 1 FROM r JOIN se ON se.source = r.node WHERE r.layer < {K_HOPS}),
ball AS (SELECT root, node, CAST(min(layer) AS INTEGER) AS layer FROM r GROUP BY root, node)"""


def _on_balls(spark: SparkSession, sf_dir: str, work) -> DataFrame:
    """``work(simple edges, all nodes, ball)`` for the balls of all nodes, in
    batches of roots."""
    simple = scratch_table(gr.simple_edges(fx.tx_edges(spark, sf_dir)))
    nodes = scratch_table(gr.graph_nodes(simple))
    return trv.in_root_batches(simple, nodes, K_HOPS, lambda some: work(simple, nodes, trv.k_hop_ball(simple, some, K_HOPS)))


@register("k_hop_ball", f"""WITH RECURSIVE {_GRAPH_SQL}, {_BALL_SQL}
SELECT root, node, layer FROM ball""")
def q_k_hop_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-hop out-ball with BFS layer of every node of the graph."""
    return _on_balls(spark, sf_dir, lambda simple, nodes, ball: ball)


@register("in_ball_successors", f"""WITH RECURSIVE {_GRAPH_SQL}, {_BALL_SQL},
c AS (SELECT b.root, b.node, count(*) AS n FROM ball b JOIN se ON se.source = b.node
      JOIN ball b2 ON b2.root = b.root AND b2.node = se.target GROUP BY b.root, b.node)
SELECT b.root, b.node, b.layer, CAST(coalesce(c.n, 0) AS BIGINT) AS n_in_ball
FROM ball b LEFT JOIN c ON c.root = b.root AND c.node = b.node""")
def q_in_ball_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successors of each ball node inside the same ball."""
    return _on_balls(spark, sf_dir, lambda simple, nodes, ball: trv.in_ball_successors(ball, simple))


@register("sp_roles", f"""WITH RECURSIVE {_GRAPH_SQL}, {_BALL_SQL},
d AS (SELECT gn.node, CAST(floor(log2(count(se.target) + 1)) AS INTEGER) AS ld
      FROM gn LEFT JOIN se ON se.source = gn.node GROUP BY gn.node)
SELECT b.root, b.node, b.layer,
       concat_ws(':', 'sp', CAST(dr.ld AS VARCHAR), CAST(b.layer AS VARCHAR), CAST(dn.ld AS VARCHAR)) AS token
FROM ball b JOIN d dr ON dr.node = b.root JOIN d dn ON dn.node = b.node""")
def q_sp_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 + G8: shortest-path role ids (log out-degree of root, layer, of node)."""
    return _on_balls(spark, sf_dir, lambda simple, nodes, ball: trv.sp_roles(ball, gr.out_degrees(nodes, simple)))


def _wl_sql() -> str:
    xs = ", ".join(f"CAST(floor(log2(count(CASE WHEN a.layer = {l} THEN 1 END) + 1)) AS BIGINT)"
                   for l in range(K_HOPS + 1))
    zeros = ", ".join("0" for _ in range(K_HOPS + 1))
    return f"""WITH RECURSIVE {_GRAPH_SQL}, {_BALL_SQL},
xc AS (SELECT w.root, w.node, list_value({xs}) AS x
       FROM ball w JOIN se ON se.target = w.node JOIN ball a ON a.root = w.root AND a.node = se.source
       GROUP BY w.root, w.node),
xv AS (SELECT b.root, b.node, b.layer, coalesce(xc.x, list_value({zeros})::BIGINT[]) AS x
       FROM ball b LEFT JOIN xc ON xc.root = b.root AND xc.node = b.node)
SELECT v.root, v.node, v.layer,
  'wl:(' || array_to_string(rx.x, ',') || '):' || CAST(v.layer AS VARCHAR) || ':(' || array_to_string(v.x, ',') || ')'
  AS token
FROM xv v JOIN xv rx ON rx.root = v.root AND rx.node = v.root"""


@register("wl_roles", _wl_sql())
def q_wl_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: Weisfeiler-Lehman style role ids from in-ball predecessor counts per layer."""
    return _on_balls(spark, sf_dir, lambda simple, nodes, ball: trv.wl_roles(ball, simple, K_HOPS))


# ---------------------------------------------------------------- R1-R8 transitions and walks
def _wel_sql(uniform: bool = False) -> str:
    weight = "1.0" if uniform else """(CASE WHEN tot.at <> 0 THEN g.amount / tot.at ELSE 0 END)
  * (CASE WHEN tot.tt <> 0 THEN CAST(g.ts AS DOUBLE) / tot.tt ELSE 0 END)
  * (CAST(g.n_tx AS DOUBLE) / tot.d)"""
    return f"""e AS {E},
g AS (SELECT source, target, count(*) AS n_tx, sum(coalesce(amount, 0)) AS amount,
             max(coalesce("timestamp", 0)) AS ts FROM e GROUP BY source, target),
tot AS (SELECT node, sum(amount) AS at, sum(CAST(ts AS DOUBLE)) AS tt, count(*) AS d FROM
        (SELECT source AS node, amount, ts FROM g UNION ALL SELECT target, amount, ts FROM g) GROUP BY node),
wel AS (SELECT g.source, g.target, {weight} AS weight
  FROM g JOIN tot ON tot.node = g.source),
pk AS (SELECT source, count(*) AS d, sum(weight) AS tot FROM wel GROUP BY source),
c AS (SELECT wel.source, wel.target AS next,
             CASE WHEN coalesce(pk.tot, 0) = 0 THEN 1.0 ELSE wel.weight END AS w,
             CASE WHEN coalesce(pk.tot, 0) = 0 THEN CAST(pk.d AS DOUBLE) ELSE pk.tot END AS tt
      FROM wel JOIN pk ON pk.source = wel.source),
t AS (SELECT source, next, w,
  coalesce(sum(w) OVER (PARTITION BY source ORDER BY next ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / tt AS lo,
  CASE WHEN row_number() OVER (PARTITION BY source ORDER BY next DESC) = 1 THEN 1.0
       ELSE sum(w) OVER (PARTITION BY source ORDER BY next ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / tt END AS hi
  FROM c)"""


_WEL_SQL = _wel_sql()

NUM_WALKS, WALK_LEN, SEED = 2, 5, 42


@register("transition_table", rounded_sql(f"""WITH {_WEL_SQL}
SELECT source, next, lo, hi FROM t""", ["lo", "hi"], digits=12))
def q_transition_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative first-step probabilities per node (weighted graph)."""
    w = gr.weighted_edge_list(fx.tx_edges(spark, sf_dir))
    cum = wk.cumulative_table(w.select("source", F.col("target").alias("next"), "weight"), ["source"], "next")
    return rounded(cum.select("source", "next", "lo", "hi"), 12)


def _walks_sql() -> str:
    steps = []
    for i in range(1, WALK_LEN):
        u = uniform_sql(SEED, "w.root", "w.walk_no", f"{i}")
        steps.append(f"""w{i} AS (SELECT w.root, w.walk_no, coalesce(t.next, w.cur) AS cur,
  CASE WHEN t.next IS NULL THEN w.walk ELSE list_append(w.walk, t.next) END AS walk
  FROM w{i - 1} w LEFT JOIN t ON t.source = w.cur AND t.lo <= {u} AND {u} < t.hi)""")
    return f"""WITH {_WEL_SQL},
gn AS (SELECT source AS node FROM wel UNION SELECT target FROM wel),
w0 AS (SELECT gn.node AS root, wn.walk_no, gn.node AS cur, [gn.node] AS walk
       FROM gn, (SELECT range AS walk_no FROM range({NUM_WALKS})) wn),
{",".join(steps)}
SELECT root, walk_no, array_to_string(walk, ' ') AS walk FROM w{WALK_LEN - 1}"""


def _walk_text(walks: DataFrame) -> DataFrame:
    return walks.select("root", F.col("walk_no").cast("long").alias("walk_no"),
                        F.concat_ws(" ", F.transform("walk", lambda x: x.cast("string"))).alias("walk"))


@register("random_walks", _walks_sql())
def q_random_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 + R5 + R7 + R8: 2 weighted first-order walks of length 5 from every node."""
    w = gr.weighted_edge_list(fx.tx_edges(spark, sf_dir))
    roots = gr.graph_nodes(w)
    return _walk_text(wk.simulate_walks(w, roots, NUM_WALKS, WALK_LEN, seed=SEED))


# Per-node settings of every second node: 0 to 2 walks of at most 3 to 7 nodes.
_OVERRIDES_SQL = f"""(SELECT node, node % 3 AS num_walks, 3 + node % 5 AS walk_length FROM {N} WHERE node % 2 = 0)"""
LONGEST = 7


def _override_walks_sql() -> str:
    steps = []
    for i in range(1, LONGEST):
        u = uniform_sql(SEED, "w.root", "w.walk_no", f"{i}")
        steps.append(f"""w{i} AS (SELECT w.root, w.walk_no, w.max_len, coalesce(t.next, w.cur) AS cur,
  CASE WHEN t.next IS NULL THEN w.walk ELSE list_append(w.walk, t.next) END AS walk
  FROM w{i - 1} w LEFT JOIN t ON len(w.walk) < w.max_len AND t.source = w.cur AND t.lo <= {u} AND {u} < t.hi)""")
    return f"""WITH {_WEL_SQL},
gn AS (SELECT source AS node FROM wel UNION SELECT target FROM wel),
ov AS {_OVERRIDES_SQL},
w0 AS (SELECT gn.node AS root, wn.walk_no, coalesce(ov.walk_length, {WALK_LEN}) AS max_len, gn.node AS cur,
              [gn.node] AS walk
       FROM gn LEFT JOIN ov ON ov.node = gn.node
       JOIN (SELECT range AS walk_no FROM range({LONGEST})) wn ON wn.walk_no < coalesce(ov.num_walks, {NUM_WALKS})),
{",".join(steps)}
SELECT root, walk_no, array_to_string(walk, ' ') AS walk FROM w{LONGEST - 1}"""


@register("per_node_override_walks", _override_walks_sql())
def q_per_node_override_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk number and length set per node (no walk where the number is 0);
    nodes without a setting use the global ones."""
    w = gr.weighted_edge_list(fx.tx_edges(spark, sf_dir))
    node = F.col("node")
    overrides = fx.tx_nodes(spark, sf_dir).where(node % 2 == 0).select(
        "node", (node % 3).alias("num_walks"), (node % 5 + 3).alias("walk_length"))
    return _walk_text(wk.simulate_walks(w, gr.graph_nodes(w), NUM_WALKS, WALK_LEN, seed=SEED, overrides=overrides))


P2, Q2 = 0.5, 2.0


def _second_order_sql() -> str:
    inv_p, inv_q = 1.0 / P2, 1.0 / Q2
    fmax = max(inv_p, 1.0, inv_q)

    def acc(w: str, a: str) -> str:
        ua = uniform_sql(SEED, f"{w}.root", f"{w}.walk_no", "{i}", a, "1")
        return (f"(zt.zero_total OR {ua} < (CASE WHEN t.next = {w}.prev THEN {inv_p!r} "
                f"WHEN se.source IS NOT NULL THEN 1.0 ELSE {inv_q!r} END) / {fmax!r})")

    u1 = uniform_sql(SEED, "w.root", "w.walk_no", "1")
    ctes = [f"""w1 AS (SELECT w.root, w.walk_no, CASE WHEN t.next IS NULL THEN w.prev ELSE w.cur END AS prev,
  coalesce(t.next, w.cur) AS cur, CASE WHEN t.next IS NULL THEN w.walk ELSE list_append(w.walk, t.next) END AS walk
  FROM w0 w LEFT JOIN t ON t.source = w.cur AND t.lo <= {u1} AND {u1} < t.hi)"""]
    for i in range(2, WALK_LEN):
        up0 = uniform_sql(SEED, "w.root", "w.walk_no", f"{i}", "0", "0")
        upr = uniform_sql(SEED, "r.root", "r.walk_no", f"{i}", "r.a + 1", "0")
        ctes.append(f"""att{i}(root, walk_no, prev, cur, walk, a, nxt, acc) AS (
  SELECT w.root, w.walk_no, w.prev, w.cur, w.walk, 0, t.next, {acc('w', '0').replace('{i}', str(i))}
  FROM w{i - 1} w JOIN t ON t.source = w.cur AND t.lo <= {up0} AND {up0} < t.hi
  JOIN zt ON zt.source = w.cur LEFT JOIN se ON se.source = w.prev AND se.target = t.next
  UNION ALL
  SELECT r.root, r.walk_no, r.prev, r.cur, r.walk, r.a + 1, t.next, {acc('r', 'r.a + 1').replace('{i}', str(i))}
  FROM att{i} r JOIN t ON t.source = r.cur AND t.lo <= {upr} AND {upr} < t.hi
  JOIN zt ON zt.source = r.cur LEFT JOIN se ON se.source = r.prev AND se.target = t.next
  WHERE NOT r.acc)""")
        ctes.append(f"""w{i} AS (SELECT root, walk_no, cur AS prev, nxt AS cur, list_append(walk, nxt) AS walk
  FROM att{i} WHERE acc
  UNION ALL SELECT root, walk_no, prev, cur, walk FROM w{i - 1} w
  WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.source = w.cur))""")
    return f"""WITH RECURSIVE {_WEL_SQL},
zt AS (SELECT source, coalesce(tot, 0) = 0 AS zero_total FROM pk),
se AS (SELECT DISTINCT source, target FROM wel),
gn AS (SELECT source AS node FROM wel UNION SELECT target FROM wel),
w0 AS (SELECT gn.node AS root, wn.walk_no, CAST(NULL AS BIGINT) AS prev, gn.node AS cur, [gn.node] AS walk
       FROM gn, (SELECT range AS walk_no FROM range({NUM_WALKS})) wn),
{",".join(ctes)}
SELECT root, walk_no, array_to_string(walk, ' ') AS walk FROM w{WALK_LEN - 1}"""


@register("second_order_walks", _second_order_sql())
def q_second_order_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 + R5: node2vec second-order walks (p = 0.5, q = 2) by exact rejection
    sampling with keyed draws (oracle: one recursive CTE over attempts per step)."""
    w = gr.weighted_edge_list(fx.tx_edges(spark, sf_dir))
    roots = gr.graph_nodes(w)
    return _walk_text(wk.simulate_walks(w, roots, NUM_WALKS, WALK_LEN, seed=SEED, p=P2, q=Q2))


#: Most 2-paths through a node that has rows in the second-order table.
MAX_PATHS = 64

_PATHS_SQL = f"""deg_in AS (SELECT target AS node, count(*) AS n FROM wel GROUP BY target),
small AS (SELECT pk.source AS node FROM pk JOIN deg_in ON deg_in.node = pk.source WHERE pk.d * deg_in.n <= {MAX_PATHS}),
paths AS (SELECT a.source AS prev, a.target AS cur, c.next,
    CASE WHEN coalesce(pk.tot, 0) = 0 THEN 1.0
         ELSE c.w * CASE WHEN c.next = a.source THEN {1 / P2!r}
                         WHEN EXISTS (SELECT 1 FROM wel x WHERE x.source = a.source AND x.target = c.next) THEN 1.0
                         ELSE {1 / Q2!r} END END AS w
  FROM wel a JOIN small ON small.node = a.target JOIN pk ON pk.source = a.target JOIN c ON c.source = a.target)"""


@register("second_order_transitions", rounded_sql(f"""WITH {_WEL_SQL}, {_PATHS_SQL}
SELECT prev, cur, next, w / sum(w) OVER (PARTITION BY prev, cur) AS probability FROM paths""", ["probability"], digits=12))
def q_second_order_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: normalised second-step probabilities (p = 0.5, q = 2) of every edge into
    a node of at most 64 two-paths; the walks below reject at the others."""
    w = gr.weighted_edge_list(fx.tx_edges(spark, sf_dir))
    return rounded(wk.second_order_transitions(w, P2, Q2, max_paths=MAX_PATHS)
                   .select("prev", "cur", "next", "probability"), 12)


def _hybrid_sql() -> str:
    """The rejection walks' SQL, with one draw from the table at small nodes."""
    ctes = _second_order_sql()
    for i in range(2, WALK_LEN):
        u = uniform_sql(SEED, "w.root", "w.walk_no", f"{i}")
        ctes = ctes.replace(f"FROM w{i - 1} w JOIN t ON", f"FROM (SELECT * FROM w{i - 1} WHERE cur NOT IN (SELECT node FROM small)) w JOIN t ON")
        ctes = ctes.replace(f"FROM att{i} WHERE acc\n", f"""FROM att{i} WHERE acc
  UNION ALL SELECT w.root, w.walk_no, w.cur, pt.next, list_append(w.walk, pt.next) FROM w{i - 1} w
  JOIN pt ON pt.prev = w.prev AND pt.cur = w.cur AND pt.lo <= {u} AND {u} < pt.hi
""")
    table = f"""{_PATHS_SQL},
pt AS (SELECT prev, cur, next,
    coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(w) OVER (PARTITION BY prev, cur) AS lo,
    CASE WHEN lead(next) OVER o IS NULL THEN 1.0
         ELSE sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(w) OVER (PARTITION BY prev, cur) END AS hi
  FROM paths WINDOW o AS (PARTITION BY prev, cur ORDER BY next)),
zt AS ("""
    return ctes.replace("zt AS (", table, 1)


@register("second_order_walks_hybrid", _hybrid_sql())
def q_second_order_walks_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 + R5: the second-order walks by one draw a step from the probability
    table where that is small, by rejection at the other nodes."""
    w = gr.weighted_edge_list(fx.tx_edges(spark, sf_dir))
    return _walk_text(wk.simulate_walks(w, gr.graph_nodes(w), NUM_WALKS, WALK_LEN, seed=SEED, p=P2, q=Q2,
                                        max_paths=MAX_PATHS))



# ---------------------------------------------------------------- pipelines (rows-only checks)


CORPUS_WALKS, CORPUS_LEN = 80, 10


def _corpus_sql(uniform_weights: bool = False, relabel: bool = True, n_walks: int = CORPUS_WALKS,
                length: int = CORPUS_LEN) -> str:
    steps = []
    for i in range(1, length):
        u = uniform_sql(SEED, "w.root", "w.walk_no", f"{i}")
        steps.append(f"""w{i} AS (SELECT w.root, w.walk_no,
    coalesce(t.next, tr.next, w.cur) AS cur,
    CASE WHEN coalesce(t.next, tr.next) IS NULL THEN w.walk ELSE list_append(w.walk, coalesce(t.next, tr.next)) END AS walk,
    coalesce(bl.layer = {K_HOPS}, false) AS restricted
  FROM w{i - 1} w
  LEFT JOIN t ON NOT w.restricted AND t.source = w.cur AND t.lo <= {u} AND {u} < t.hi
  LEFT JOIN tr ON w.restricted AND tr.root = w.root AND tr.source = w.cur AND tr.lo <= {u} AND {u} < tr.hi
  LEFT JOIN ball bl ON bl.root = w.root AND bl.node = coalesce(t.next, tr.next, w.cur))""")
    body = f"""WITH RECURSIVE {_wel_sql(uniform_weights)},
se AS (SELECT source, target FROM wel),
gn AS (SELECT source AS node FROM se UNION SELECT target FROM se),
{_BALL_SQL},
trc AS (SELECT b.root, wel.source, wel.target AS next, wel.weight FROM ball b JOIN wel ON wel.source = b.node
        JOIN ball b2 ON b2.root = b.root AND b2.node = wel.target WHERE b.layer = {K_HOPS}),
pkr AS (SELECT root, source, count(*) AS d, sum(weight) AS tot FROM trc GROUP BY root, source),
cr AS (SELECT trc.root, trc.source, trc.next,
              CASE WHEN coalesce(pkr.tot, 0) = 0 THEN 1.0 ELSE trc.weight END AS w,
              CASE WHEN coalesce(pkr.tot, 0) = 0 THEN CAST(pkr.d AS DOUBLE) ELSE pkr.tot END AS tt
       FROM trc JOIN pkr ON pkr.root = trc.root AND pkr.source = trc.source),
tr AS (SELECT root, source, next,
  coalesce(sum(w) OVER (PARTITION BY root, source ORDER BY next ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / tt AS lo,
  CASE WHEN row_number() OVER (PARTITION BY root, source ORDER BY next DESC) = 1 THEN 1.0
       ELSE sum(w) OVER (PARTITION BY root, source ORDER BY next ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / tt END AS hi
  FROM cr),
w0 AS (SELECT gn.node AS root, wn.walk_no, gn.node AS cur, [gn.node] AS walk, false AS restricted
       FROM gn, (SELECT range AS walk_no FROM range({n_walks})) wn),
{",".join(steps)},
deg AS (SELECT gn.node, CAST(floor(log2(count(se.target) + 1)) AS INTEGER) AS ld
        FROM gn LEFT JOIN se ON se.source = gn.node GROUP BY gn.node),
sp AS (SELECT b.root, b.node,
         concat_ws(':', 'sp', CAST(dr.ld AS VARCHAR), CAST(b.layer AS VARCHAR), CAST(dn.ld AS VARCHAR)) AS token
       FROM ball b JOIN deg dr ON dr.node = b.root JOIN deg dn ON dn.node = b.node),
ex AS (SELECT root, walk_no, unnest(walk) AS node, generate_subscripts(walk, 1) AS pos FROM w{length - 1})
""" + (f"""SELECT ex.root, ex.walk_no,
       string_agg(CASE WHEN ex.pos = 1 THEN CAST(ex.root AS VARCHAR) ELSE sp.token END, ' ' ORDER BY ex.pos) AS walk
FROM ex LEFT JOIN sp ON sp.root = ex.root AND sp.node = ex.node
GROUP BY ex.root, ex.walk_no""" if relabel else
        f"SELECT root, walk_no, array_to_string(walk, ' ') AS walk FROM w{length - 1}")
    return body


@register("structural_corpus_sp", _corpus_sql())
def q_structural_corpus_sp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9 + T4 + T7: ball-confined walks (length 10, 80 per node, k = 4) over the
    weighted graph, relabelled with shortest-path role ids."""
    corpus = pl.structural_corpus(gr.weighted_edge_list(fx.tx_edges(spark, sf_dir)), "sp", walk_length=CORPUS_LEN,
                                  num_walks=CORPUS_WALKS, until_k=K_HOPS, seed=SEED)
    return corpus.select(
        "root", F.col("walk_no").cast("long").alias("walk_no"), F.concat_ws(" ", "tokens").alias("walk"))


def _na_sql() -> str:
    sel = [c for c in selected_features() if c != "node"]
    conv = ", ".join(
        f"CASE WHEN {c} IS NULL OR isnan(CAST({c} AS DOUBLE)) OR abs(CAST({c} AS DOUBLE)) >= 2147483648.0 "
        f"OR trunc(CAST({c} AS DOUBLE)) + 1 <= 0 THEN -2147483648 "
        f"ELSE CAST(floor(log2(trunc(CAST({c} AS DOUBLE)) + 1)) AS BIGINT) END" for c in sel)
    wl = _wl_sql()
    head, tail = wl.split("\nSELECT v.root, v.node, v.layer,", 1)
    return f"""{head},
nf AS ({node_features_sql(round_doubles=False)}),
attr AS (SELECT node, list_value({conv})::BIGINT[] AS a FROM nf),
wlt AS (SELECT v.root, v.node, v.layer,{tail})
SELECT wlt.root, wlt.node, wlt.layer,
  'na:(' || array_to_string(ar.a, ',') || '):' || CAST(wlt.layer AS VARCHAR) || ':(' || array_to_string(an.a, ',') || ')#'
  || wlt.token AS token
FROM wlt JOIN attr ar ON ar.node = wlt.root JOIN attr an ON an.node = wlt.node"""


@register("na_roles", _na_sql())
def q_na_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 + T6 + P5: attribute role ids, attributes = the selected catalogue features."""
    attrs = cut_lineage(feat.select_catalogue(feat.node_features(fx.tx_edges(spark, sf_dir), fx.tx_nodes(spark, sf_dir)),
                                              selected_only=True))
    return _on_balls(spark, sf_dir, lambda simple, nodes, ball: trv.na_roles(ball, simple, attrs, K_HOPS))


@register("structural_embedding_wl")
def q_structural_embedding_wl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4 + E1 + E3 + E5: WL structural embedding with the reference defaults
    (128 dims, walk length 10, 80 walks, window 10, k = 4, 5 epochs)."""
    el = gr.weighted_edge_list(fx.tx_edges(spark, sf_dir))
    out, _, _ = pl.structural_embedding(el, "wl")
    return out


@register("structural_embedding_na")
def q_structural_embedding_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4 + T6 + T8: structural embedding of attribute-aware roles, attributes =
    the selected catalogue features."""
    edges = fx.tx_edges(spark, sf_dir)
    attrs = feat.select_catalogue(feat.node_features(edges, fx.tx_nodes(spark, sf_dir)), selected_only=True)
    out, _, _ = pl.structural_embedding(gr.weighted_edge_list(edges), "na", attrs)
    return out


@register("structural_embedding_n2v")
def q_structural_embedding_n2v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4 + T8: the structural pipeline's confined walks with node ids as tokens."""
    out, _, _ = pl.structural_embedding(gr.weighted_edge_list(fx.tx_edges(spark, sf_dir)), "n2v")
    return out


@register("structural_classification")
def q_structural_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L6 on structural vectors: the anchors' shortest-path embeddings -> RF and L1-LR."""
    out, _, _ = pl.structural_embedding(gr.weighted_edge_list(fx.tx_edges(spark, sf_dir)), "sp")
    return pl.embedding_classification(cut_lineage(out), fx.tx_nodes(spark, sf_dir), "0;sp", "sp", 128)


@register("feature_classification")
def q_feature_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L5 + M1 + M4-M8 + M10-M12: anchors' 67 features, min-max fitted on train,
    RF and L1-LR; two stats rows."""
    nodes = fx.tx_nodes(spark, sf_dir)
    features = feat.node_features(fx.tx_edges(spark, sf_dir), nodes, roots=feat.anchors(nodes))
    stats, _ = pl.feature_classification(features, nodes, "0;fe")
    return stats


@register("feature_ranking")
def q_feature_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M12 + O1: RF impurity importance of the 67 features, ranked."""
    nodes = fx.tx_nodes(spark, sf_dir)
    features = feat.node_features(fx.tx_edges(spark, sf_dir), nodes, roots=feat.anchors(nodes))
    _, ranking = pl.feature_classification(features, nodes, "0;fe")
    return ranking


@register("node2vec_classification")
def q_node2vec_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L8 + E2 + E4 + L6: node2vec walks (64 dims, length 5, 20 walks, window 10,
    5 epochs) -> skip-gram -> anchors -> RF and L1-LR."""
    el = gr.weighted_edge_list(fx.tx_edges(spark, sf_dir))
    stats, _ = pl.node2vec_baseline(el, fx.tx_nodes(spark, sf_dir), "0;n2v")
    return stats


@register("published_baseline")
def q_published_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 balanced repetitions on the published features; 100 stats rows."""
    return pl.published_baseline(fx.pub_features(spark, sf_dir), fx.pub_classes(spark, sf_dir), repetitions=50)


@register("feature_projection")
def q_feature_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6 (re-aimed) + M2 + F9: 2-D PCA projection of the scaled feature table,
    shifted to be non-negative, as node attributes."""
    f = feat.node_features(fx.tx_edges(spark, sf_dir), fx.tx_nodes(spark, sf_dir))
    return emb.projection_2d(f, feat.feature_columns(f))



# ---------------------------------------------------------------- G7, P5, J2/L2, L3, M13, L7


@register("out_adjacency", f"""
WITH e AS {E}, se AS (SELECT DISTINCT source, target FROM e),
d AS (SELECT source, count(*) AS out_degree FROM se GROUP BY source)
SELECT se.source, se.target, d.out_degree FROM se JOIN d ON d.source = se.source""")
def q_out_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7 (long form): successor rows with the source's out-degree."""
    return gr.out_adjacency(fx.tx_edges(spark, sf_dir))


_SEL = selected_features()


@register("selected_features", rounded_sql(f"""
SELECT {", ".join(_SEL)} FROM ({node_features_sql()}) AS nf""",
                                           [c for c in _SEL if c not in _COUNT_COLS and c != "node"]))
def q_selected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: the catalogue's selected subset (node + 10 flagged features)."""
    f = feat.node_features(fx.tx_edges(spark, sf_dir), fx.tx_nodes(spark, sf_dir))
    return rounded(feat.select_catalogue(f, selected_only=True))


_PUB_NAMES = [f"f_{i}" for i in range(64)]


@register("merged_published_features", rounded_sql(
    _simple_features_sql() + f""",
z AS (SELECT node, address, isp, is_anchor, {_zscore_select(SIMPLE_FEATURES)} FROM sf),
pub AS (SELECT p.*, c."txId", CASE WHEN c.label = 'unknown' THEN '0' ELSE c.label END AS label
        FROM {fx.pub_features_sql()} p LEFT JOIN {fx.PUB_CLASSES_SQL} c ON p.address = c."txId"),
ps AS (SELECT * FROM pub WHERE address IN (SELECT address FROM z))
SELECT z.*, CAST(ps."timestamp" AS DOUBLE) AS "timestamp", {", ".join(f"ps.{c}" for c in _PUB_NAMES)},
       ps."txId", ps.label
FROM z LEFT JOIN ps ON ps.address = z.address""", list(SIMPLE_FEATURES) + ["timestamp", *_PUB_NAMES]))
def q_merged_published_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 + A18 + M3 + J1 + J2 + J3: z-scored simple-graph features of all nodes
    left-joined with the labelled published features of those nodes (nodes
    without a published address have nulls there)."""
    _, _, merged = pl.simple_graph_features(fx.tx_edges(spark, sf_dir), fx.tx_nodes(spark, sf_dir),
                                            fx.pub_features(spark, sf_dir), fx.pub_classes(spark, sf_dir))
    # a nullable timestamp is compared as double
    return rounded(merged.withColumn("timestamp", F.col("timestamp").cast("double")))


@register("merged_classification")
def q_merged_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L5 on the merged table: the anchors with published features, 25 + 64
    features as they are (already z-scored), none of the seven metadata
    columns; two stats rows."""
    nodes = fx.tx_nodes(spark, sf_dir)
    _, _, merged = pl.simple_graph_features(fx.tx_edges(spark, sf_dir), nodes, fx.pub_features(spark, sf_dir),
                                            fx.pub_classes(spark, sf_dir))
    stats, _ = pl.feature_classification(merged.where("txId IS NOT NULL"), nodes, "0;merged", minmax=False)
    return stats


@register("embedding_node_list")
def q_embedding_node_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3 + O2 + P4: node list for the attribute-aware embedding: node plus the
    10 best-ranked features of the RF ranking."""
    nodes = fx.tx_nodes(spark, sf_dir)
    edges = fx.tx_edges(spark, sf_dir)
    features = cut_lineage(feat.node_features(edges, nodes))
    _, ranking = pl.feature_classification(features, nodes, "0;fe")
    _, node_list = pl.graph_preparation(edges, features, ranking, top_k=10)
    return node_list


@register("importance_spread")
def q_importance_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100-tree forest importances with across-tree population std."""
    nodes = fx.tx_nodes(spark, sf_dir)
    f = feat.node_features(fx.tx_edges(spark, sf_dir), nodes, roots=feat.anchors(nodes))
    cols = feat.feature_columns(f)
    tr = cut_lineage(clf.assemble(f.select("node", F.col("isp").alias("y"), *cols), cols)
                     .select("node", "label", "features"))
    return clf.importance_spread(tr, cols)


@register("concat_classification")
def q_concat_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L7 + J5 + M3: node2vec embeddings (64 dims) concatenated with z-scored
    engineered features; RF and L1-LR on the anchors."""
    edges, nodes = fx.tx_edges(spark, sf_dir), fx.tx_nodes(spark, sf_dir)
    e = pl.node2vec_embedding(gr.weighted_edge_list(edges))
    features = cut_lineage(feat.node_features(edges, nodes))
    return pl.concat_classification(cut_lineage(e), features, "0;concat", "concat", 64)



# ---------------------------------------------------------------- G6, R6
@register("dense_ids", f"""WITH e AS {E},
gn AS (SELECT source AS node FROM e UNION SELECT target FROM e)
SELECT node, row_number() OVER (ORDER BY node) - 1 AS dense_id FROM gn""")
def q_dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ids 0..N-1 in node order (range-sorted, no window over the nodes)."""
    return gr.dense_ids(gr.graph_nodes(fx.tx_edges(spark, sf_dir)))


@register("uniform_confined_walks", _corpus_sql(uniform_weights=True, relabel=False, n_walks=NUM_WALKS,
                                                length=CORPUS_LEN))
def q_uniform_confined_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform walks confined to each root's 4-hop ball (unit weights)."""
    w = scratch_table(gr.weighted_edge_list(fx.tx_edges(spark, sf_dir)).withColumn("weight", F.lit(1.0)))
    simple = w.select("source", "target")
    roots = scratch_table(gr.graph_nodes(simple))
    transitions = scratch_table(wk.first_order_transitions(w))

    def walks_of(some: DataFrame) -> DataFrame:
        return _walk_text(wk.simulate_walks(w, some, NUM_WALKS, CORPUS_LEN, seed=SEED, until_k=K_HOPS, transitions=transitions,
                                            ball=trv.k_hop_ball(simple, some, K_HOPS)))

    return trv.in_root_batches(simple, roots, K_HOPS, walks_of)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_node_features(spark, sf_dir)
