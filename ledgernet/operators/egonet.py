"""Out-directed egonet features.

The egonet of u is the subgraph induced on ``N[u] = {u} + successors(u)``.
For every neighbour v (v != u) we need its in/out degree (and amount-weighted
degree) *inside* the egonet; per u, the number of egonet edges and the number
of edges entering/leaving the egonet.

An edge (a -> b) lies in ego(u) iff a, b are in N[u].  Such edges are of four
kinds, each computed with equi-joins whose output is bounded by the input:

1. u -> v                     the out-edges of u themselves;
2. v -> u with u -> v         reciprocal pairs (join on the reversed pair);
3. v -> v with u -> v         a neighbour's self-loop (<= 1 row per v);
4. v -> w, v != w, u -> v, u -> w   directed triangles.

The naive plan for (4) joins ``u -> v`` with ``v -> w`` on v, i.e. emits every
in-neighbour x out-neighbour pair of a hub v: quadratic in the hub's degree.
Instead triangles are *listed* on the undirected simple projection with the
degree ordering (each pair oriented from the lower (degree, id) end): wedges
are only formed at the lower-ranked vertex, whose oriented out-degree is at
most sqrt(2m), so total work is O(m^1.5) and a hub generates no wedges of its
own.  Each triangle is then expanded into its (at most 6) directed
(u, v, w) readings.

``variant="multi"``: parallel transactions count (multigraph, A8-A12);
``variant="simple"``: pairs collapse, no amounts, and the egonet in/out counts
use the anchor-based form ``k * (in(u) - ego_in(u))`` (A13-A15).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgernet.catalog import stat_columns
from ledgernet.functions.stats import six_stat_aggs
from ledgernet.session import cut_lineage


def _collapsed(edges: DataFrame, variant: str) -> DataFrame:
    if variant == "multi":
        amt = F.coalesce(F.col("amount").cast("double"), F.lit(0.0))
        return edges.groupBy("source", "target").agg(
            F.count(F.lit(1)).alias("c"), F.sum(amt).alias("a"))
    if variant == "simple":
        return (edges.select("source", "target").distinct()
                .select("source", "target", F.lit(1).cast("long").alias("c"), F.lit(1.0).alias("a")))
    raise ValueError(f"unknown variant {variant!r}")


def _contrib(u, v, cin=None, cout=None, ain=None, aout=None, rc=None, valid=None):
    z = F.lit(0).cast("long")
    zd = F.lit(0.0)
    s = F.struct(
        u.alias("u"), v.alias("v"),
        (cin if cin is not None else z).cast("long").alias("cin"),
        (cout if cout is not None else z).cast("long").alias("cout"),
        (ain if ain is not None else zd).cast("double").alias("ain"),
        (aout if aout is not None else zd).cast("double").alias("aout"),
        (rc if rc is not None else z).cast("long").alias("rc"),
    )
    return s if valid is None else F.when(valid, s)


def triangles(g: DataFrame) -> DataFrame:
    """Undirected triangles {x, y, z} of the simple projection of ``g`` (columns
    source, target, c, a; self-loops ignored), each listed once, with the
    directed multiplicity/amount of all six orientations."""
    nl = g.filter(F.col("source") != F.col("target"))
    lo, hi = F.least("source", "target"), F.greatest("source", "target")
    fwd = F.col("source") == lo
    pairs = nl.groupBy(lo.alias("a"), hi.alias("b")).agg(
        F.sum(F.when(fwd, F.col("c")).otherwise(0)).alias("c_ab"),
        F.sum(F.when(fwd, F.col("a")).otherwise(0.0)).alias("a_ab"),
        F.sum(F.when(~fwd, F.col("c")).otherwise(0)).alias("c_ba"),
        F.sum(F.when(~fwd, F.col("a")).otherwise(0.0)).alias("a_ba"))
    deg = (pairs.select(F.explode(F.array("a", "b")).alias("node"))
           .groupBy("node").agg(F.count(F.lit(1)).alias("deg")))
    p = (pairs.join(deg.withColumnRenamed("node", "a").withColumnRenamed("deg", "da"), "a")
         .join(deg.withColumnRenamed("node", "b").withColumnRenamed("deg", "db"), "b"))
    a_low = F.col("da") <= F.col("db")          # ties broken by id: a < b always
    # read three times below: the degree joins run once
    oriented = cut_lineage(p.select(
        F.when(a_low, F.col("a")).otherwise(F.col("b")).alias("x"),
        F.when(a_low, F.col("b")).otherwise(F.col("a")).alias("y"),
        F.when(a_low, F.col("db")).otherwise(F.col("da")).alias("dy"),
        F.when(a_low, F.col("c_ab")).otherwise(F.col("c_ba")).alias("cxy"),
        F.when(a_low, F.col("a_ab")).otherwise(F.col("a_ba")).alias("axy"),
        F.when(a_low, F.col("c_ba")).otherwise(F.col("c_ab")).alias("cyx"),
        F.when(a_low, F.col("a_ba")).otherwise(F.col("a_ab")).alias("ayx")))
    o1 = oriented.alias("o1")
    o2 = oriented.alias("o2")
    o3 = oriented.alias("o3")
    wedge_order = (F.col("o1.dy") < F.col("o2.dy")) | (
        (F.col("o1.dy") == F.col("o2.dy")) & (F.col("o1.y") < F.col("o2.y")))
    wedges = o1.join(o2, (F.col("o1.x") == F.col("o2.x")) & wedge_order)
    tri = wedges.join(o3, (F.col("o3.x") == F.col("o1.y")) & (F.col("o3.y") == F.col("o2.y")))
    return tri.select(
        F.col("o1.x").alias("x"), F.col("o1.y").alias("y"), F.col("o2.y").alias("z"),
        F.col("o1.cxy").alias("cxy"), F.col("o1.axy").alias("axy"),
        F.col("o1.cyx").alias("cyx"), F.col("o1.ayx").alias("ayx"),
        F.col("o2.cxy").alias("cxz"), F.col("o2.axy").alias("axz"),
        F.col("o2.cyx").alias("czx"), F.col("o2.ayx").alias("azx"),
        F.col("o3.cxy").alias("cyz"), F.col("o3.axy").alias("ayz"),
        F.col("o3.cyx").alias("czy"), F.col("o3.ayx").alias("azy"))


def _triangle_contributions(tri: DataFrame) -> DataFrame:
    n = {k: F.col(k) for k in ("x", "y", "z")}

    def c(a, b):
        return F.col(f"c{a}{b}")

    def am(a, b):
        return F.col(f"a{a}{b}")

    rows = []
    for u, v, w in (("x", "y", "z"), ("x", "z", "y"), ("y", "x", "z"),
                    ("y", "z", "x"), ("z", "x", "y"), ("z", "y", "x")):
        ok = (c(u, v) > 0) & (c(u, w) > 0) & (c(v, w) > 0)
        # edge v -> w inside ego(u): leaves v, enters w
        rows.append(_contrib(n[u], n[v], cout=c(v, w), aout=am(v, w), valid=ok))
        rows.append(_contrib(n[u], n[w], cin=c(v, w), ain=am(v, w), valid=ok))
    return (tri.select(F.explode(F.array(*rows)).alias("r"))
            .filter(F.col("r").isNotNull()).select("r.*"))


def _only_roots(df: DataFrame, col: str, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return df
    return df.join(roots.select(F.col("node").alias("__root")).distinct(), F.col(col) == F.col("__root"),
                   "left_semi")


def near_roots(g: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Edges with both ends in N[roots] (roots and their successors): the only
    ones that a triangle read from a root can have."""
    if roots is None:
        return g
    own = _only_roots(g, "source", roots)
    members = own.select(F.col("source").alias("node")).unionAll(own.select("target")).distinct()
    return _only_roots(_only_roots(g, "source", members), "target", members)


def neighbour_table(g: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Per (u, v), v a successor of u (v != u): egonet in/out counts and amounts
    of v, plus ``rc`` = multiplicity of v -> u (for the anchor's own in-degree).
    With ``roots`` only anchors u among them are produced (semi-join first)."""
    nl_all = g.filter(F.col("source") != F.col("target"))
    nl = _only_roots(nl_all, "source", roots)
    loops = (g.filter(F.col("source") == F.col("target"))
             .select(F.col("source").alias("lnode"), F.col("c").alias("cl"), F.col("a").alias("al")))
    own = nl.select(_contrib(F.col("source"), F.col("target"), cin=F.col("c"), ain=F.col("a")).alias("r"))
    f, r = nl.alias("f"), nl_all.alias("r")
    recip = f.join(r, (F.col("f.source") == F.col("r.target")) & (F.col("f.target") == F.col("r.source"))).select(
        _contrib(F.col("f.source"), F.col("f.target"), cout=F.col("r.c"), aout=F.col("r.a"),
                 rc=F.col("r.c")).alias("r"))
    nloop = nl.join(loops, F.col("target") == F.col("lnode")).select(
        _contrib(F.col("source"), F.col("target"), cin=F.col("cl"), cout=F.col("cl"),
                 ain=F.col("al"), aout=F.col("al")).alias("r"))
    tri = _only_roots(_triangle_contributions(triangles(near_roots(g, roots))), "u", roots)
    parts = own.unionByName(recip).unionByName(nloop).select("r.*").unionByName(tri)
    return parts.groupBy("u", "v").agg(
        F.sum("cin").alias("ein"), F.sum("cout").alias("eout"),
        F.sum("ain").alias("ain"), F.sum("aout").alias("aout"), F.sum("rc").alias("rc"))


def node_degrees(g: DataFrame) -> DataFrame:
    """Per node: out/in multiplicity sums and self-loop multiplicity."""
    sides = g.select(F.explode(F.array(
        F.struct(F.col("source").alias("node"), F.col("c").alias("dout"), F.lit(0).cast("long").alias("din"),
                 F.when(F.col("source") == F.col("target"), F.col("c")).otherwise(0).cast("long").alias("cl")),
        F.struct(F.col("target").alias("node"), F.lit(0).cast("long").alias("dout"), F.col("c").alias("din"),
                 F.lit(0).cast("long").alias("cl")))).alias("s")).select("s.*")
    return sides.groupBy("node").agg(F.sum("dout").alias("dout"), F.sum("din").alias("din"),
                                     F.sum("cl").alias("cl"))


MULTI_EGO_COLUMNS = (["no_edge_within_egonet", "no_edge_in_egonet", "no_edge_out_egonet", "no_edge_all_egonet"]
                     + stat_columns("neighbor_degree") + stat_columns("neighbor_w_degree")
                     + stat_columns("neighbor_in_degree") + stat_columns("neighbor_out_degree"))
SIMPLE_EGO_COLUMNS = (["degree", "in_degree", "out_degree",
                       "no_edge_within_egonet", "no_edge_in_egonet", "no_edge_out_egonet", "no_edge_all_egonet"]
                      + stat_columns("neighbor_degree") + stat_columns("neighbor_in_degree")
                      + stat_columns("neighbor_out_degree"))


def egonet_features(edges: DataFrame, variant: str = "multi", nodes: DataFrame | None = None,
                    roots: DataFrame | None = None) -> DataFrame:
    """A8-A12 (``multi``) or A13-A15 (``simple``) for every node of the graph,
    or for every row of ``nodes`` (zeros for nodes without edges).  ``roots``
    (a ``node`` column) restricts the anchors before any per-anchor work."""
    # the collapsed graph feeds ~8 branches (own, reciprocal, loops, triangle
    # listing, degrees): materialise it once instead of re-scanning the edges
    g = cut_lineage(_collapsed(edges, variant))
    degs = node_degrees(g)
    nb = neighbour_table(g, roots).join(
        degs.select(F.col("node").alias("v"), F.col("dout").alias("v_dout"), F.col("din").alias("v_din")), "v")
    ein, eout = F.col("ein"), F.col("eout")
    aggs = [F.count(F.lit(1)).alias("k"), F.sum("eout").alias("sum_eout"), F.sum("rc").alias("sum_rc"),
            F.sum(F.col("v_din") - ein).alias("ext_in"), F.sum(F.col("v_dout") - eout).alias("ext_out"),
            *six_stat_aggs(ein + eout, "neighbor_degree")]
    if variant == "multi":
        aggs += six_stat_aggs(F.col("ain") + F.col("aout"), "neighbor_w_degree")
    aggs += six_stat_aggs(ein, "neighbor_in_degree") + six_stat_aggs(eout, "neighbor_out_degree")
    per_u = nb.groupBy(F.col("u").alias("node")).agg(*aggs)
    base = degs if nodes is None else nodes.select("node").join(degs, "node", "left")
    base = _only_roots(base, "node", roots)
    j = base.join(per_u, "node", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    within = (z("dout") + z("sum_eout")).cast("long")
    if variant == "multi":
        e_in, e_out = z("ext_in").cast("long"), z("ext_out").cast("long")
        cols = [within.alias("no_edge_within_egonet"), e_in.alias("no_edge_in_egonet"),
                e_out.alias("no_edge_out_egonet"), (e_in + e_out).alias("no_edge_all_egonet")]
        stat_cols = MULTI_EGO_COLUMNS[4:]
    else:
        ego_in_u = z("cl") + z("sum_rc")
        e_in = (z("k") * (z("din") - ego_in_u)).cast("long")
        e_out = (z("k") * (z("dout") - z("dout"))).cast("long")
        cols = [(z("din") + z("dout")).cast("long").alias("degree"), z("din").cast("long").alias("in_degree"),
                z("dout").cast("long").alias("out_degree"),
                within.alias("no_edge_within_egonet"), e_in.alias("no_edge_in_egonet"),
                e_out.alias("no_edge_out_egonet"), (e_in + e_out).alias("no_edge_all_egonet")]
        stat_cols = SIMPLE_EGO_COLUMNS[7:]
    return j.select("node", *cols, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in stat_cols])
