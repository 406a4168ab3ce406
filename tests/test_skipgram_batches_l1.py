"""Driver-free skip-gram, k-hop balls in root batches, many-model L1 logistic."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgernet.operators import graph as gr
from ledgernet.operators import l1
from ledgernet.operators import skipgram as sg
from ledgernet.operators import traverse as trv
from ledgernet.plans import pipelines as pl
from ledgernet.session import ensure_checkpoint_dir


# ---------------------------------------------------------------- skip-gram
def test_pairs_equal_brute_force(spark):
    r = random.Random(1)
    walks = [[r.choice("abcde") for _ in range(r.randint(0, 9))] for _ in range(60)] + [None]
    corpus = spark.createDataFrame([(w,) for w in walks], "tokens array<string>").repartition(4)
    names = {x["id"]: x["token"] for x in sg.token_ids(corpus.select(F.explode("tokens").alias("token"))).collect()}
    got = {(names[x["center"]], names[x["context"]]): x["weight"]
           for x in sg.pair_table(sg.compact(corpus), 3).collect()}
    want = {}
    for w in filter(None, walks):
        for i in range(len(w)):
            for j in range(len(w)):
                if i != j and abs(i - j) <= 3:
                    want[w[i], w[j]] = want.get((w[i], w[j]), 0) + 4 - abs(i - j)
    assert got == want


def test_two_tokens_of_one_id_are_an_error(spark, monkeypatch):
    tokens = spark.createDataFrame([("a",), ("b",)], "token string")
    assert sg.token_ids(tokens).count() == 2
    monkeypatch.setattr(sg.F, "xxhash64", lambda c: F.lit(7).cast("long"))
    with pytest.raises(ValueError, match="share the id 7"):
        sg.token_ids(tokens)


def test_gradient_is_that_of_the_objective():
    """One batch from flat scales moves along the objective's numeric gradient."""
    r = np.random.default_rng(1)
    u, v = r.normal(size=(3, 4)).astype(np.float32), r.normal(size=(5, 4)).astype(np.float32)
    c, o, w = np.array([0, 1, 1]), np.array([2, 0, 4]), np.array([1.0, 2.0, 0.5], np.float32)
    noise = np.cumsum(np.full(5, 0.2))
    drawn = np.minimum(np.searchsorted(noise, _draws(3), side="right"), 4)

    def objective(u, v):
        s = lambda x: 1 / (1 + np.exp(-x))
        total = 0.0
        for a, b, weight in zip(c, o, w):
            total += weight * np.log(s(u[a] @ v[b]))
            total += weight * 5 / sg.SHARED * sum(np.log(s(-u[a] @ v[k])) for k in drawn if k != b)
        return total
    before = u.astype(np.float64), v.astype(np.float64)
    u_scale, v_scale = np.zeros(3, np.float32), np.zeros(5, np.float32)
    new_u, new_v = u.copy(), v.copy()
    sg.train_block((new_u, u_scale), (new_v, v_scale), noise, (c, o, w), (1, 2, 3, 4), 5, 0.1)
    for which, new, scale in ((0, new_u, u_scale), (1, new_v, v_scale)):
        for row in range(len(new)):
            g = np.zeros(4)
            for k in range(4):
                up = [x.copy() for x in before]
                down = [x.copy() for x in before]
                up[which][row, k] += 1e-5
                down[which][row, k] -= 1e-5
                g[k] = (objective(*up) - objective(*down)) / 2e-5
            assert np.isclose(scale[row], np.mean(g * g), rtol=1e-3, atol=1e-6)
            if scale[row] > 1e-9:
                assert np.allclose((new[row] - before[which][row]) * np.sqrt(scale[row]) / 0.1, g, rtol=2e-2, atol=1e-3)


def _draws(n):
    random_ = np.random.default_rng(np.random.SeedSequence([1, 2, 3, 4]))
    random_.permutation(n)
    return random_.random(sg.SHARED)


def test_vectors_do_not_depend_on_tasks_or_partitions(spark):
    r = random.Random(2)
    rows = [([f"{x}{r.randint(0, 5)}" for _ in range(6)],) for x in "ab" * 60]
    df = spark.createDataFrame(rows, "tokens array<string>")
    runs = [sg.skip_gram(df.repartition(n), dimensions=8, window_size=3, epochs=2, block_tokens=3, tasks=t).collect()
            for n, t in ((3, 4), (7, 16))]
    a, b = ({x["token"]: x["vector"] for x in run} for run in runs)
    assert a == b and len(a) == 12
    # tokens of one group stand closer to each other than to the other group
    unit = {t: np.array(v) / np.linalg.norm(v) for t, v in a.items()}
    inside = np.mean([unit[s] @ unit[t] for s in unit for t in unit if s != t and s[0] == t[0]])
    across = np.mean([unit[s] @ unit[t] for s in unit for t in unit if s[0] != t[0]])
    assert inside > across + 0.2


def test_rare_tokens_have_no_vector(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a", "b"],), ([],)], "tokens array<string>")
    got = {x["token"] for x in sg.skip_gram(df, dimensions=4, window_size=2, epochs=1, min_count=2).collect()}
    assert got == {"a", "b"}
    assert sg.skip_gram(df.limit(0), dimensions=4, window_size=2, epochs=1).collect() == []


# ------------------------------------------------------------ root batches
def graph(spark, n=60, seed=3):
    r = random.Random(seed)
    rows = {(r.randrange(n), r.randrange(n)) for _ in range(2 * n)} | {(0, k) for k in range(1, n)}
    return spark.createDataFrame([(a, b, float(1 + (a * b) % 5)) for a, b in rows], "source long, target long, weight double")


def test_ball_sizes_are_estimated(spark):
    e = graph(spark)
    roots = gr.graph_nodes(e)
    exact = {x["root"]: x["count"] for x in trv.k_hop_ball(e, roots, 2).groupBy("root").count().collect()}
    got = {x["node"]: x["size"] for x in trv.ball_sizes(e, roots, 2, bits=12).collect()}
    assert got.keys() == exact.keys()
    assert all(abs(got[k] - exact[k]) <= 0.1 * exact[k] + 1 for k in exact)


@pytest.mark.parametrize("max_rows", [1, 400, 10 ** 9])
def test_batches_of_roots_give_the_same_corpus(spark, max_rows):
    e = graph(spark, n=14)
    roots = gr.graph_nodes(e)
    work = lambda some: trv.wl_roles(trv.k_hop_ball(e, some, 2), e, 2)
    scratch = ensure_checkpoint_dir(spark).rsplit("/", 1)[0]
    got = trv.in_root_batches(e, roots, 2, work, max_rows).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, work(roots).collect()))
    import os
    folder = scratch.removeprefix("file:")
    assert not [x for x in os.listdir(folder) if x.startswith("passing-")]


def test_batches_are_bounded(spark):
    sizes = spark.range(5000).selectExpr("id AS node", "id % 40 + 1 AS size")
    batches, n = trv.root_batches(sizes, 10_000)
    rows = batches.join(sizes, "node").groupBy("batch").agg(F.sum("size").alias("s")).collect()
    assert batches.count() == 5000 and 10 <= n <= 12 and max(x["s"] for x in rows) < 1.2 * 10_000


def test_corpus_of_every_flag(spark):
    e = graph(spark, n=12)
    attrs = gr.graph_nodes(e).select("node", (F.col("node") * 1.5).alias("a"))
    for flag in pl.FLAGS:
        one = pl.structural_corpus(e, flag, attrs, walk_length=4, num_walks=2, until_k=2)
        many = pl.structural_corpus(e, flag, attrs, walk_length=4, num_walks=2, until_k=2, max_rows=60)
        rows = sorted((x["root"], x["walk_no"], tuple(x["tokens"])) for x in one.collect())
        assert rows == sorted((x["root"], x["walk_no"], tuple(x["tokens"])) for x in many.collect())
        assert len(rows) == 24 and all(t[0] == str(root) for root, _, t in rows)


# ---------------------------------------------------------------- L1 models
def numpy_l1(x, y, c, sweeps=20_000):
    """Proximal gradient with a fixed step, the intercept as a penalised weight."""
    a = np.column_stack([x, np.ones(len(x))])
    w = v = np.zeros(a.shape[1])
    step, t = 4 / (c * np.linalg.norm(a, 2) ** 2), 1.0
    for _ in range(sweeps):
        g = c * (a.T @ (1 / (1 + np.exp(-(a @ v))) - y))
        new = v - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def test_l1_models_equal_a_numpy_solver(spark):
    r = np.random.default_rng(5)
    rows, want = [], {}
    for m in (3, 7, 8):
        n = 150 if m != 8 else 20
        x = r.normal(size=(n, 6)) * [1, 10, 0.1, 1, 1, 0]
        y = (x[:, 0] + 0.1 * x[:, 1] + r.normal(size=n) * (0.5 if m != 8 else 0) > 0.8).astype(float)
        rows += [(m, float(b), a.tolist()) for a, b in zip(x, y)]
        want[m] = numpy_l1(x, y, 1.0)
    df = spark.createDataFrame(rows, "model long, y double, features array<double>").repartition(5)
    fitted = l1.l1_logistic_models(df)
    for f in fitted.collect():
        got = np.array([*f["coefficients"], f["intercept"]])
        assert np.allclose(got, want[f["model"]], atol=1e-4), f["model"]
        assert (np.abs(got) < 1e-12).any() and f["rounds"] < 40
    scored = l1.score(df, fitted).where("model = 3").collect()
    w = want[3]
    for x in scored:
        z = np.dot(x["features"], w[:-1]) + w[-1]
        assert abs(x["probability"] - 1 / (1 + np.exp(-z))) < 1e-4 and x["prediction"] == int(x["probability"] > 0.5)
    assert l1.l1_logistic_models(df.limit(0)).collect() == []


def test_splits_of_all_repetitions_equal_single_ones(spark):
    from ledgernet.operators import sampling as smp

    df = spark.range(137).selectExpr("cast(id as string) node", "cast(id % 3 = 0 as int) y")
    reps = df.crossJoin(spark.range(4).withColumnRenamed("id", "rep"))
    got = smp.split_repetitions(reps, "rep", "y", "node", base_seed=42).collect()
    for i in range(4):
        one = smp.stratified_split(df, "y", "node", seed=42 + i).collect()
        assert {x["node"] for x in got if x["rep"] == i and x["is_test"]} == {x["node"] for x in one if x["is_test"]}


def test_repetitions_give_two_rows_each(spark):
    r = random.Random(1)
    rows = [(str(k), k % 49, *[r.gauss(k % 2, 1) for _ in range(3)]) for k in range(120)]
    published = spark.createDataFrame(rows, "address string, timestamp long, f_0 double, f_1 double, f_2 double")
    classes = spark.createDataFrame([(str(k), "1" if k % 2 else "2") for k in range(120)], "txId string, label string")
    got = pl.published_baseline(published, classes, repetitions=2).collect()
    assert sorted((x["index"], x["classifier"]) for x in got) == [(str(i), c) for i in range(2) for c in ("LR", "RF")] or \
        sorted((int(x["index"]), x["classifier"]) for x in got) == [(i, c) for i in range(2) for c in ("LR", "RF")]
    assert all(0.5 < x["train_auc"] <= 1 and x["test_acc"] is not None for x in got)


def test_a_run_that_is_done_again_replaces_its_rows(spark, tmp_path):
    from ledgernet.sources import sinks as sk

    path = f"{tmp_path}/stats"
    row = lambda v: spark.createDataFrame([(v,)], "auc double")
    sk.append_stats(row(0.1), path, "a")
    sk.append_stats(row(0.2), path, "b")
    sk.append_stats(row(0.3), path, "a")
    failing = row(0.4).withColumn("auc", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        sk.append_stats(failing, path, "b")
    assert sorted((x["run"], x["auc"]) for x in spark.read.parquet(path).collect()) == [("a", 0.3), ("b", 0.2)]
    for _ in range(2):
        sk.append_run_log(spark, f"{tmp_path}/runs", "wl", 2.0)
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 1
