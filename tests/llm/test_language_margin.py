"""Language ID rejects narrow margins, at any length."""

import random

from pyspark.sql import functions as F

from ledgernet.llm import language_id as lid


def test_noise_and_mixed_texts_go_and_clean_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    samples = lid.learn(docs)
    r = random.Random(1)
    clean = [x["text"] for x in docs.where(~lid.held_out() & F.col("lang").isNotNull() & (F.length("text") > 30))
             .orderBy("doc_id").limit(600).collect()]
    model = lid.Classifier(samples)
    noise = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)) for n in [2000] * 20 + [100_000] * 5]
    # as much of one language as of another, by what their dictionaries save
    mixed = []
    by = {k: b" ".join(v).decode(errors="ignore").split() for k, v in samples.items()}
    for a, b in (("en", "de"), ("fr", "es"), ("de", "fr")):
        words = [(r.choice(by[a]), r.choice(by[b])) for _ in range(9000)]
        lo, hi = 0.0, 1.0
        for _ in range(12):
            mid = (lo + hi) / 2
            text = " ".join(x if k % 1000 < 1000 * mid else y for k, (x, y) in enumerate(words))
            sizes = dict(zip(model.names, model.sizes(lid.letters(text))))
            lo, hi = (lo, mid) if sizes[a] < sizes[b] else (mid, hi)
        mixed.append(text)
    kinds = [("clean", t) for t in clean] + [("noise", t) for t in noise] + [("mixed", t) for t in mixed]
    frame = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(kinds)], "doc_id long, text string").repartition(8)
    rejected = {x["doc_id"]: x["rejected"] for x in lid.language_id(frame, samples).collect()}
    gone = {kind: [rejected[k] for k, (q, _) in enumerate(kinds) if q == kind] for kind in ("clean", "noise", "mixed")}
    assert all(gone["noise"]) and all(gone["mixed"])
    assert sum(gone["clean"]) <= 0.03 * len(clean)
    kept = {x["doc_id"] for x in lid.keep_identified(frame, samples).collect()}
    assert kept == {k for k, no in rejected.items() if not no}
