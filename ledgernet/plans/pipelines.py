"""End-to-end pipelines (L1-L9): compositions of the operators.

Each returns DataFrames (lazy where possible); writing is left to the caller
(:mod:`ledgernet.sources.sinks`).  Loops on the driver only iterate over a
fixed parameter (walk steps, BFS layers, experiment repetitions), never over
data.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgernet.catalog import META_WITH_PUBLISHED, PUBLISHED_META
from ledgernet.operators import classify as clf
from ledgernet.operators import embed as emb
from ledgernet.operators import features as feat
from ledgernet.operators import graph as gr
from ledgernet.operators import sampling as smp
from ledgernet.operators import traverse as trv
from ledgernet.operators import walks as wk
from ledgernet.operators.scaling import minmax_scale, zscore
from ledgernet.operators.skipgram import skip_gram
from ledgernet.session import cut_lineage, scratch_table


# ------------------------------------------------------------------ L1 / L2
def multigraph_features(edges: DataFrame, nodes: DataFrame, anchors_only: bool = False) -> DataFrame:
    """L1: the 67-feature table for all nodes (or anchors only)."""
    roots = feat.anchors(nodes) if anchors_only else None
    return feat.node_features(edges, nodes, roots=roots)


def simple_graph_features(edges: DataFrame, nodes: DataFrame, published_raw: DataFrame,
                          classes: DataFrame):
    """L2: simple-graph features of all nodes, z-scored, plus the labelled
    published features of those nodes and the merged table."""
    published = feat.labeled_published(feat.published_features(published_raw)
                                       if published_raw.columns[0] != "address" else published_raw, classes)
    return feat.simple_features_all(edges, nodes, published)


# ------------------------------------------------------------------ L3
def graph_preparation(edges: DataFrame, features: DataFrame | None = None, ranking: DataFrame | None = None,
                      top_k: int = 10, projection: bool = False, weighted: bool = True, scale: bool = True):
    """L3: weighted (or unweighted) simple edge list, and a node list with the
    top-k ranked features or a 2-D projection of all features (``scale``: min-max
    scaled first; the merged published table is projected as it is)."""
    edge_list = gr.weighted_edge_list(edges) if weighted else gr.unweighted_edge_list(edges)
    node_list = None
    if features is not None:
        if projection:
            cols = feat.feature_columns(features, META_WITH_PUBLISHED)
            node_list = emb.projection_2d(features, cols, scale=scale)
        elif ranking is not None:
            node_list = feat.top_features(features, ranking, top_k)
    return edge_list, node_list


# ------------------------------------------------------------------ L4
FLAGS = ("sp", "wl", "na", "n2v")


def structural_corpus(edge_list: DataFrame, flag: str = "wl", node_attributes: DataFrame | None = None,
                      walk_length: int = 10, num_walks: int = 80, until_k: int = 4, p: float = 1.0, q: float = 1.0,
                      seed: int = 42, discount: bool = True, stub_sources: bool = False,
                      max_rows: int = trv.MAX_BALL_ROWS) -> DataFrame:
    """``root, walk_no, tokens``: ball-confined biased walks from every
    node, relabelled with role ids, in batches of roots."""
    if flag not in FLAGS:
        raise ValueError(f"unknown flag {flag!r}")
    if flag == "na" and node_attributes is None:
        raise ValueError("flag 'na' needs node attributes")
    w = scratch_table(gr.read_weighted(edge_list))
    simple = w.select("source", "target")
    roots = scratch_table(gr.graph_nodes(simple))
    transitions = scratch_table(wk.first_order_transitions(w))
    if flag == "na":
        node_attributes = cut_lineage(node_attributes)

    def corpus_of(some: DataFrame) -> DataFrame:
        ball = trv.k_hop_ball(simple, some, until_k)
        walks = wk.simulate_walks(w, some, num_walks, walk_length, seed=seed, p=p, q=q, ball=ball, until_k=until_k,
                                  stub_sources=stub_sources, transitions=transitions)
        if flag == "sp":
            roles = trv.sp_roles(ball, gr.out_degrees(roots, simple), discount)
        elif flag == "wl":
            roles = trv.wl_roles(ball, simple, until_k, discount)
        elif flag == "na":
            roles = trv.na_roles(ball, simple, node_attributes, until_k, discount)
        else:
            roles = None
        return trv.relabel_walks(walks, roles)

    return trv.in_root_batches(simple, roots, until_k, corpus_of, max_rows)


def structural_embedding(edge_list: DataFrame, flag: str = "wl", node_attributes: DataFrame | None = None,
                         dimensions: int = 128, walk_length: int = 10, num_walks: int = 80,
                         window_size: int = 10, until_k: int = 4, epochs: int = 5, p: float = 1.0,
                         q: float = 1.0, seed: int = 42, discount: bool = True, stub_sources: bool = False,
                         max_rows: int = trv.MAX_BALL_ROWS):
    """L4: k-hop balls -> confined biased walks -> role relabelling -> skip-gram
    -> vectors of the original nodes.  Returns ``(embeddings, seconds, corpus)``."""
    t0 = time.time()
    corpus = scratch_table(structural_corpus(edge_list, flag, node_attributes, walk_length, num_walks, until_k, p, q, seed,
                                             discount, stub_sources, max_rows))
    vectors = skip_gram(corpus, dimensions, window_size, epochs, min_count=0, seed=seed)
    roots = gr.graph_nodes(gr.read_weighted(edge_list).select("source", "target"))
    return emb.root_vectors(vectors, roots), time.time() - t0, corpus


# ------------------------------------------------------------------ L5-L7
def _split(df: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    # materialise the classification table once: the split counts it and then
    # selects from it, and the wide feature plan must not run twice
    s = cut_lineage(smp.stratified_split(cut_lineage(df), "y", "node", seed=seed))
    return s.filter(~F.col("is_test")).drop("is_test"), s.filter(F.col("is_test")).drop("is_test")


def classify_table(table: DataFrame, feature_cols: list[str], flag: str, exp_id: str, seed: int = 42,
                   minmax: bool = False, binary: bool = True):
    """Split (M4), optional min-max fitted on train (M1), RF + LR.
    ``table`` has ``node, y`` and the feature columns.  Returns (stats, rf, lr)."""
    train, test = _split(table, seed)
    if minmax:
        train_s = minmax_scale(train, feature_cols)
        test = minmax_scale(test, feature_cols, fit_on=train)
        train = train_s
    # checkpoint the compact (node, label, features) sets: every fit pass and
    # metric job then starts from a short plan instead of the wide feature plan
    tr = cut_lineage(clf.assemble(train, feature_cols).select("node", "label", "features"))
    te = cut_lineage(clf.assemble(test, feature_cols).select("node", "label", "features"))
    out = clf.rf_lr_classification(tr, te, flag, exp_id, binary, n_features=len(feature_cols), seed=seed)
    return out


def feature_classification(features: DataFrame, nodes: DataFrame, exp_id: str, flag: str = "fe",
                           seed: int = 42, minmax: bool = True):
    """anchors' engineered features -> classification; stats rows and the
    RF feature ranking (M12)."""
    anchors = feat.anchors(nodes).select("node")
    f = feat.keep_keys(features, anchors, "node")
    cols = feat.feature_columns(f, META_WITH_PUBLISHED)
    table = f.select("node", F.col("isp").alias("y"), *cols)
    stats, rf, _ = classify_table(table, cols, flag, exp_id, seed, minmax=minmax)
    ranking = clf.feature_importance(rf, cols, features.sparkSession)
    return stats, ranking


def embedding_classification(embeddings: DataFrame, nodes: DataFrame, exp_id: str, flag: str,
                             dimensions: int, seed: int = 42):
    """anchors' embeddings -> classification."""
    e = emb.embeddings_with_labels(emb.wide_embeddings(embeddings, dimensions), nodes)
    cols = [f"emb_{i}" for i in range(dimensions)]
    table = e.select("node", F.col("isp").alias("y"), *cols)
    stats, _, _ = classify_table(table, cols, flag, exp_id, seed)
    return stats


def concat_classification(embeddings: DataFrame, features: DataFrame, exp_id: str, flag: str,
                          dimensions: int, seed: int = 42):
    """Engineered features z-scored over all rows (as the original workload
    does, before the split) joined to the embeddings; anchors only."""
    cols = feat.feature_columns(features, META_WITH_PUBLISHED)
    z = zscore(features, cols)
    wide = emb.wide_embeddings(embeddings, dimensions)
    j = wide.join(z, "node", "left").filter(F.col("is_anchor") == 1)
    ecols = [f"emb_{i}" for i in range(dimensions)]
    table = j.select("node", F.col("isp").alias("y"), *ecols, *cols)
    stats, _, _ = classify_table(table, ecols + cols, flag, exp_id, seed)
    return stats


# ------------------------------------------------------------------ L8
def node2vec_embedding(edge_list: DataFrame, dimensions: int = 64, walk_length: int = 5, num_walks: int = 20,
                       window_size: int = 10, epochs: int = 5, p: float = 1.0, q: float = 1.0, seed: int = 42,
                       overrides: DataFrame | None = None) -> DataFrame:
    """Plain node2vec walks over the whole graph -> skip-gram (min_count 1)."""
    w = gr.read_weighted(edge_list)
    roots = gr.graph_nodes(w)
    walks = wk.simulate_walks(w, roots, num_walks, walk_length, seed=seed, p=p, q=q, overrides=overrides)
    vectors = skip_gram(trv.relabel_walks(walks, None), dimensions, window_size, epochs, min_count=1, seed=seed)
    return emb.root_vectors(vectors, roots)


def node2vec_baseline(edge_list: DataFrame, nodes: DataFrame, exp_id: str, dimensions: int = 64,
                      walk_length: int = 5, num_walks: int = 20, window_size: int = 10, epochs: int = 5,
                      p: float = 1.0, q: float = 1.0, seed: int = 42, overrides: DataFrame | None = None):
    """node2vec vectors of the anchors -> classification.  Returns (stats,
    embeddings)."""
    e = cut_lineage(node2vec_embedding(edge_list, dimensions, walk_length, num_walks, window_size, epochs, p, q, seed,
                                       overrides))
    return embedding_classification(e, nodes, exp_id, "n2v", dimensions, seed), e


# ------------------------------------------------------------------ L9
def published_baseline(published: DataFrame, classes: DataFrame, repetitions: int = 50, base_seed: int = 42,
                       flag: str = "published", parallelism: int = 8, exp_name: str = "published"):
    """Labelled published features; per repetition a balanced sample, a
    stratified split with seed ``base_seed + i`` and RF + LR.  Returns the
    stats rows of all repetitions (materialised).

    All samples and splits are drawn in one plan and written once, partitioned
    by repetition.  The L1 models of all repetitions are fitted by one solver;
    the forests are independent Spark ML jobs submitted from ``parallelism``
    driver threads (the same pattern as ``CrossValidator(parallelism=...)``)."""
    lab = feat.labeled_published(published, classes)
    cols = [c for c in published.columns if c not in PUBLISHED_META]
    samples = smp.balanced_undersample(lab, "label", "address", repetitions=repetitions, base_seed=base_seed).select(
        "rep", F.col("address").alias("node"), feat.binary_label("label").alias("y"), *cols)
    split = scratch_table(smp.split_repetitions(scratch_table(samples), "rep", "y", "node", base_seed), ["rep"])
    lr = clf.l1_repetitions(split.select(F.col("rep").cast("long").alias("rep"), "y", "is_test", F.array(
        *[F.col(c).cast("double") for c in cols]).alias("features")), flag, exp_name)

    def forest(i: int) -> DataFrame:
        rows = cut_lineage(clf.assemble(split.filter(F.col("rep") == i), cols).select("node", "is_test", "label", "features"))
        row, _ = clf.simple_classification(clf.random_forest(len(cols), seed=base_seed + i), "RF", flag,
                                           rows.filter(~F.col("is_test")), rows.filter("is_test"), f"{i};{exp_name}")
        return cut_lineage(row)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        out = cut_lineage(lr)
        for part in pool.map(forest, range(repetitions)):
            out = out.unionByName(part)
    return out
