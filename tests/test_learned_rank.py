"""The learned reranker: better than word overlap on questions it hasn't seen, pool order on ties, pass-through without a model."""

import numpy as np
from pyspark.sql import functions as F

from docketry.operators import learned_rank
from docketry.plans.base import Tables
from docketry.plans.retrieval import ranked_features


def mrr(rows, rank):
    first = rows.where("relevant").groupBy("qid").agg(F.min(rank).alias("r"))
    return rows.select("qid").distinct().join(first, "qid", "left").agg(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0)))).first()[0]


def test_better_than_overlap_on_new_questions(spark):
    t = Tables(spark, "/root/testdata/sf0.1")
    model = learned_rank.fit(ranked_features(t, 25))
    rows = ranked_features(t).cache()
    learned = mrr(learned_rank.rerank(rows, model), "final")
    overlap = mrr(learned_rank.rerank(rows, [0.0, 0.0, 1.0, 0.0, 0.0]), "final")
    print("mrr", learned, overlap, model)
    assert learned > overlap


def test_fit_is_the_maximum(spark):
    rng = np.random.default_rng(2)
    rows = [(q, d, bool(d % 4 == 0), *(rng.normal(size=5) + (d % 4 == 0) * np.array([1.0, 0, 0.5, 0, 0])).tolist()) for q in range(40) for d in range(20)]
    table = spark.createDataFrame(rows, "qid long, doc long, relevant boolean, dense_n double, bm25_n double, overlap double, dense double, brevity double").repartition(4)
    w = np.array(learned_rank.fit(table))
    pairs = np.array([np.array(a[3:]) - np.array(b[3:]) for a in rows for b in rows if a[0] == b[0] and a[2] and not b[2]])
    gradient = (pairs / (1 + np.exp(pairs @ w))[:, None]).sum(axis=0) - learned_rank.PENALTY * w
    assert np.abs(gradient).max() < 1e-6 and w[0] > 0.5 and abs(w[3]) < 0.3


def test_ties_and_no_model(spark):
    rows = spark.createDataFrame([(1, 10, 2, 0.5, True), (1, 11, 1, 0.5, False), (1, 12, 3, 0.9, False), (2, 13, 1, None, False)], "qid long, doc long, hrank int, overlap double, relevant boolean").withColumns({c: F.lit(0.0) for c in ("dense_n", "bm25_n", "dense", "brevity")})
    order = lambda df: [r.doc for r in df.orderBy("qid", "final").collect()]
    assert order(learned_rank.rerank(rows, [0.0, 0.0, 1.0, 0.0, 0.0])) == [12, 11, 10, 13]
    assert order(learned_rank.rerank(rows, None)) == [11, 10, 12, 13]
    assert learned_rank.fit(rows.where("NOT relevant")) is None
