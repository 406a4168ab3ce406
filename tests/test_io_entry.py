import glob
import os
import tempfile

from pyspark.sql import functions as F

from ledgernet.operators import graph as gr
from ledgernet.operators import walks as wk
from ledgernet.sources import readers as rd
from ledgernet.sources import sinks as sk


def _scratch():
    return tempfile.mkdtemp(prefix="ledgernet-test-", dir="/tmp")


def test_edges_nodes_roundtrip_csv_and_parquet(spark, micro):
    e, n = micro
    d = _scratch()
    for fmt in ("csv", "parquet"):
        sk.write_table(e, f"{d}/edges_{fmt}", fmt=fmt)
        sk.write_table(n, f"{d}/nodes_{fmt}", fmt=fmt)
        e2 = rd.read_edges(spark, f"{d}/edges_{fmt}", fmt=fmt)
        n2 = rd.read_nodes(spark, f"{d}/nodes_{fmt}", fmt=fmt)
        assert sorted(e2.collect()) == sorted(e.collect())
        assert sorted(n2.collect()) == sorted(n.collect())
        assert e2.schema["timestamp"].dataType.typeName() == "long"


def test_weighted_reader_defaults_weight(spark, micro):
    e, _ = micro
    d = _scratch()
    sk.write_table(e.select("source", "target"), f"{d}/el", fmt="csv")
    w = rd.read_weighted_edges(spark, f"{d}/el", fmt="csv")
    assert {r["weight"] for r in w.collect()} == {1.0}
    assert w.count() == e.select("source", "target").distinct().count()


def test_word2vec_text_roundtrip(spark):
    emb = spark.createDataFrame([(1, [0.5, -1.0, 2.0]), (2, [0.0, 1.5, 3.25])], "node long, vector array<double>")
    d = _scratch()
    sk.write_word2vec_text(emb, f"{d}/emb", 3)
    back = {r["node"]: (r["emb_0"], r["emb_1"], r["emb_2"]) for r in rd.read_word2vec_text(spark, f"{d}/emb").collect()}
    assert back == {1: (0.5, -1.0, 2.0), 2: (0.0, 1.5, 3.25)}


def test_walk_shards_and_stats_append(spark):
    walks = spark.createDataFrame([(1, 0, ["1", "a", "b"]), (2, 0, ["2", "c"])],
                                  "root long, walk_no int, tokens array<string>")
    d = _scratch()
    sk.write_walks(walks, f"{d}/walks")
    assert sorted(tuple(r["tokens"]) for r in rd.read_walks(spark, f"{d}/walks").collect()) == \
        [("1", "a", "b"), ("2", "c")]
    row = spark.createDataFrame([("0", "x", "fe", "RF") + (0.5,) * 10],
                                "index string, exp_id string, emb_method string, classifier string, "
                                + ", ".join(f"{p}_{m} double" for p in ("train", "test")
                                            for m in ("prec", "rec", "f1", "acc", "auc")))
    sk.append_stats(row, f"{d}/stats")
    sk.append_stats(row, f"{d}/stats")
    assert spark.read.parquet(f"{d}/stats").count() == 2


def test_dense_ids(spark, micro):
    e, _ = micro
    ids = gr.dense_ids(gr.graph_nodes(e)).orderBy("node").collect()
    assert [r["dense_id"] for r in ids] == list(range(len(ids)))


def test_per_node_overrides(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0), (3, 1, 1.0)],
                                  "source long, target long, weight double")
    roots = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    ov = spark.createDataFrame([(1, None, None, 3, 7), (2, 0.5, 2.0, None, None)],
                               "node long, p double, q double, num_walks int, walk_length int")
    w = wk.simulate_walks(edges, roots, 2, 4, seed=1, overrides=ov).collect()
    per_root = {}
    for r in w:
        per_root.setdefault(r["root"], []).append(len(r["walk"]))
    assert len(per_root[1]) == 3 and all(x == 7 for x in per_root[1])
    assert len(per_root[2]) == 2 and all(x == 4 for x in per_root[2])


def test_entry_contract(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0 and "node" in df.columns
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 30


def test_run_log_append(spark):
    d = _scratch()
    sk.append_run_log(spark, f"{d}/runs", "wl", 1.5)
    sk.append_run_log(spark, f"{d}/runs", "sp", 2.5)
    rows = sorted((r["run"], r["run_seconds"]) for r in spark.read.parquet(f"{d}/runs").collect())
    assert rows == [("sp", 2.5), ("wl", 1.5)]


def test_readers_bind_columns_by_name(spark, micro):
    import pytest

    e, _ = micro
    d = _scratch()
    sk.write_table(e.selectExpr("7 AS idx", "amount", "source", "timestamp", "target"), f"{d}/e", fmt="csv")
    assert sorted(rd.read_edges(spark, f"{d}/e", fmt="csv").collect()) == sorted(e.collect())
    with pytest.raises(ValueError, match="is_anchor"):
        rd.read_nodes(spark, f"{d}/e", fmt="csv")


def test_published_file_is_named_by_position(spark):
    d = _scratch()
    spark.createDataFrame([(f"{k},{k + 1}," + ",".join(str(x) for x in range(165)),) for k in range(3)],
                          "value string").write.text(f"{d}/pub")
    got = rd.read_published_features(spark, f"{d}/pub", fmt="csv")
    assert len(got.columns) == 167 and got.columns[2] == "tx_feat_2" and got.columns[-1] == "agg_feat_72"
    row = got.where("address = '1'").first()
    assert (row["timestamp"], row["tx_feat_2"], row["tx_feat_94"], row["agg_feat_72"]) == (2, 0.0, 92.0, 164.0)


def test_walk_shards_are_read_in_turn(spark):
    with tempfile.TemporaryDirectory() as d:
        walks = spark.range(400).select(F.col("id").alias("root"), F.lit(0).alias("walk_no"),
                                        F.array(F.col("id").cast("string"), F.lit("x")).alias("tokens"))
        sk.write_walks(walks, f"{d}/walks", shuffle_seed=3, shards=5)
        rows = rd.read_walks(spark, f"{d}/walks", interleaved=True).collect()
        assert sorted(int(r["tokens"][0]) for r in rows) == list(range(400))
        files = {os.path.basename(f): [line.split() for line in open(f)] for f in glob.glob(f"{d}/walks/part-*")}
        assert len(files) == 5
        assert all(files[r["shard"]][r["position"]] == r["tokens"] for r in rows)
        order = [int(r["tokens"][0]) for r in sorted(rows, key=lambda r: (r["position"], r["shard"]))]
        centred = [(i - 199.5) * (v - 199.5) for i, v in enumerate(order)]
        assert abs(sum(centred) / sum((i - 199.5) ** 2 for i in range(400))) < 0.15
        sk.write_walks(walks, f"{d}/again", shuffle_seed=3, shards=5)
        again = rd.read_walks(spark, f"{d}/again", interleaved=True).collect()
        assert sorted((r["position"], r["tokens"]) for r in again) == sorted((r["position"], r["tokens"]) for r in rows)
