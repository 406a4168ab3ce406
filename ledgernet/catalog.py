"""Schemas, the feature catalogue and metadata column sets."""

from __future__ import annotations

from pyspark.sql import types as T

EDGES = T.StructType([
    T.StructField("source", T.LongType()),
    T.StructField("target", T.LongType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("amount", T.DoubleType()),
])
SIMPLE_EDGES = T.StructType([
    T.StructField("source", T.LongType()),
    T.StructField("target", T.LongType()),
])
WEIGHTED_EDGES = T.StructType([
    T.StructField("source", T.LongType()),
    T.StructField("target", T.LongType()),
    T.StructField("weight", T.DoubleType()),
])
NODES = T.StructType([
    T.StructField("node", T.LongType()),
    T.StructField("address", T.StringType()),
    T.StructField("isp", T.IntegerType()),
    T.StructField("is_anchor", T.IntegerType()),
])
CLASSES = T.StructType([
    T.StructField("txId", T.StringType()),
    T.StructField("label", T.StringType()),
])
STATS_TABLE = T.StructType([
    T.StructField("index", T.StringType()),
    T.StructField("exp_id", T.StringType()),
    T.StructField("emb_method", T.StringType()),
    T.StructField("classifier", T.StringType()),
] + [T.StructField(f"{part}_{m}", T.DoubleType())
     for part in ("train", "test") for m in ("prec", "rec", "f1", "acc", "auc")])

# Metadata columns that are never features.
META = ["node", "address", "isp", "is_anchor"]
META_WITH_PUBLISHED = META + ["timestamp", "txId", "label"]
PUBLISHED_META = ["address", "timestamp", "label", "txId"]

# The per-node feature catalogue of the multigraph variant, in
# output order, with its ``select`` flag (1 = in the selected subset).
FEATURE_CATALOGUE = [
    ("node", 1), ("address", 0), ("isp", 0), ("is_anchor", 0),
    ("degree", 0), ("in_degree", 1), ("out_degree", 0),
    ("avg_amount_in_tx", 0), ("min_amount_in_tx", 0), ("max_amount_in_tx", 0),
    ("sum_amount_in_tx", 1), ("std_amount_in_tx", 1), ("ent_amount_in_tx", 0),
    ("avg_in_tx_interval", 1), ("min_in_tx_interval", 0), ("max_in_tx_interval", 1),
    ("sum_in_tx_interval", 1), ("std_in_tx_interval", 0), ("ent_in_tx_interval", 0),
    ("avg_amount_out_tx", 0), ("min_amount_out_tx", 0), ("max_amount_out_tx", 0),
    ("sum_amount_out_tx", 1), ("std_amount_out_tx", 0), ("ent_amount_out_tx", 0),
    ("avg_out_tx_interval", 0), ("min_out_tx_interval", 0), ("max_out_tx_interval", 0),
    ("sum_out_tx_interval", 0), ("std_out_tx_interval", 0), ("ent_out_tx_interval", 0),
    ("avg_amount_all_tx", 0), ("min_amount_all_tx", 0), ("max_amount_all_tx", 0),
    ("sum_amount_all_tx", 0), ("std_amount_all_tx", 0), ("ent_amount_all_tx", 1),
    ("avg_all_tx_interval", 0), ("min_all_tx_interval", 0), ("max_all_tx_interval", 0),
    ("sum_all_tx_interval", 0), ("std_all_tx_interval", 0), ("ent_all_tx_interval", 0),
    ("no_edge_within_egonet", 0), ("no_edge_in_egonet", 1), ("no_edge_out_egonet", 0),
    ("no_edge_all_egonet", 1),
    ("avg_neighbor_degree", 0), ("min_neighbor_degree", 0), ("max_neighbor_degree", 0),
    ("sum_neighbor_degree", 0), ("std_neighbor_degree", 0), ("ent_neighbor_degree", 0),
    ("avg_neighbor_w_degree", 0), ("min_neighbor_w_degree", 0), ("max_neighbor_w_degree", 0),
    ("sum_neighbor_w_degree", 0), ("std_neighbor_w_degree", 0), ("ent_neighbor_w_degree", 0),
    ("avg_neighbor_in_degree", 0), ("min_neighbor_in_degree", 0), ("max_neighbor_in_degree", 0),
    ("sum_neighbor_in_degree", 0), ("std_neighbor_in_degree", 0), ("ent_neighbor_in_degree", 0),
    ("avg_neighbor_out_degree", 0), ("min_neighbor_out_degree", 0), ("max_neighbor_out_degree", 0),
    ("sum_neighbor_out_degree", 0), ("std_neighbor_out_degree", 0), ("ent_neighbor_out_degree", 0),
]

STAT_NAMES = ("avg", "min", "max", "sum", "std", "ent")


def stat_columns(name: str) -> list[str]:
    return [f"{s}_{name}" for s in STAT_NAMES]


# Column order of the simple-graph (25 feature) variant.
SIMPLE_FEATURES = (
    ["degree", "in_degree", "out_degree",
     "no_edge_within_egonet", "no_edge_in_egonet", "no_edge_out_egonet", "no_edge_all_egonet"]
    + stat_columns("neighbor_degree") + stat_columns("neighbor_in_degree")
    + stat_columns("neighbor_out_degree")
)

MULTI_FEATURES = [name for name, _ in FEATURE_CATALOGUE if name not in META]


def selected_features() -> list[str]:
    return [name for name, flag in FEATURE_CATALOGUE if flag == 1]


def published_feature_names(n_tx: int = 93, n_agg: int = 72) -> list[str]:
    """Positional names of the published feature file: address, timestamp,
    tx_feat_2.., agg_feat_1.. (defaults give the 167 columns of the original file)."""
    return (["address", "timestamp"] + [f"tx_feat_{i}" for i in range(2, 2 + n_tx)]
            + [f"agg_feat_{i}" for i in range(1, 1 + n_agg)])
