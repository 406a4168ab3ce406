"""Feature tables (A16-A18), projections (P1, P3-P8) and key joins.

A feature table is a wide DataFrame with one row per node: the node metadata
(left side, so isolated nodes get zeros) joined with the transaction and
egonet features, in catalogue order.  ``roots`` (e.g. anchors) is applied as a
left-semi join, which Catalyst pushes below the per-node aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgernet.catalog import (FEATURE_CATALOGUE, META, SIMPLE_FEATURES, published_feature_names,
                               selected_features)
from ledgernet.operators import egonet as ego
from ledgernet.operators import transactions as tx
from ledgernet.operators.scaling import zscore


def anchors(nodes: DataFrame) -> DataFrame:
    """P1."""
    return nodes.filter(F.col("is_anchor") == 1)


def keep_keys(df: DataFrame, keys: DataFrame, left: str, right: str | None = None) -> DataFrame:
    """Rows of ``df`` whose ``left`` value is among ``keys[right]``."""
    right = right or left
    k = keys.select(F.col(right).alias("__k")).distinct()
    return df.join(k, F.col(left) == F.col("__k"), "left_semi")


def node_features(edges: DataFrame, nodes: DataFrame, roots: DataFrame | None = None,
                  rows_per_bucket: int = tx.DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """A16/A18 (multigraph, 67 features) for every node, or for ``roots``."""
    base = nodes.select(*META)
    if roots is not None:
        base = keep_keys(base, roots, "node")
    t = tx.transaction_features(edges, rows_per_bucket=rows_per_bucket, roots=roots)
    e = ego.egonet_features(edges, "multi", roots=roots)
    j = base.join(t, "node", "left").join(e, "node", "left")
    names = [n for n, _ in FEATURE_CATALOGUE]
    return j.select(*META, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names if c not in META])


def simple_node_features(edges: DataFrame, nodes: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """A17 (simple graph, 25 features) for every node, or for ``roots``."""
    base = nodes.select(*META)
    if roots is not None:
        base = keep_keys(base, roots, "node")
    e = ego.egonet_features(edges, "simple", roots=roots)
    j = base.join(e, "node", "left")
    return j.select(*META, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in SIMPLE_FEATURES])


def select_catalogue(features: DataFrame, selected_only: bool = False) -> DataFrame:
    """P5: project a feature table onto the catalogue order (or its selected subset)."""
    names = selected_features() if selected_only else [n for n, _ in FEATURE_CATALOGUE]
    return features.select(*names)


def top_features(features: DataFrame, ranking: DataFrame, k: int = 10) -> DataFrame:
    """O2 + P4: ``node`` plus the ``k`` best-ranked feature columns.  The ranking
    has one row per feature column (bounded by the schema width), so reading
    its top k on the driver to build the projection is bounded."""
    ranked = [r["feature"] for r in
              ranking.orderBy(F.desc("importance"), F.asc("feature")).limit(k).collect()]
    return features.select("node", *ranked)


def published_features(raw: DataFrame, n_tx: int | None = None, n_agg: int | None = None) -> DataFrame:
    """S3: name the published feature columns by position."""
    n = len(raw.columns)
    if n_tx is None and n_agg is None:
        n_agg = max(0, min(72, n - 2 - 93)) if n >= 167 else 0
        n_tx = n - 2 - n_agg
    return raw.toDF(*published_feature_names(n_tx, n_agg))


def recode_label(col: str = "label"):
    """``'unknown'`` -> ``'0'``."""
    return F.when(F.col(col) == "unknown", F.lit("0")).otherwise(F.col(col))


def labeled_published(features: DataFrame, classes: DataFrame) -> DataFrame:
    """J1 + P6: published features left-joined with classes on address = txId."""
    j = features.join(classes, features["address"] == classes["txId"], "left")
    return j.select(*[F.col(c) for c in features.columns], F.col("txId"), recode_label().alias("label"))


def binary_label(col: str = "label"):
    """1 iff the label is ``'1'`` (illicit)."""
    return (F.col(col) == "1").cast("int")


def merge_published(engineered: DataFrame, published: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J2 (+J3): published rows of the engineered nodes, and the engineered table
    left-joined with them on ``address``."""
    sel = keep_keys(published, engineered, "address")
    merged = engineered.join(sel, "address", "left")
    return sel, merged.select(*engineered.columns, *[c for c in sel.columns if c != "address"])


def simple_features_all(edges: DataFrame, nodes: DataFrame, published: DataFrame):
    """A18 (simple graph): features of all nodes, z-scored (population std, fitted
    on all rows), then the published features of those nodes and the merge."""
    eng = simple_node_features(edges, nodes)
    eng = zscore(eng, [c for c in SIMPLE_FEATURES])
    pub, merged = merge_published(eng, published)
    return eng, pub, merged


def feature_columns(df: DataFrame, meta: list[str] = META) -> list[str]:
    """All columns but the metadata ones."""
    return [c for c in df.columns if c not in meta]

