"""A reranker learned from pairs: of one question's pool, what is relevant should score above what isn't.

Differences of features of such pairs are fitted by a logistic model; Newton steps need sums of gradients and second derivatives only,
which executors add up. A pool is bounded (RERANK_POOL rows a question), and so are its pairs. Scores are rounded, ties keep the
pool's order, and without a model the pool passes through as it is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators import retrieval as R

FEATURES = ("dense_n", "bm25_n", "overlap", "dense", "brevity")
#: Newton steps; weight of the penalty, in pairs.
STEPS, PENALTY = 8, 1.0


def features(pool: DataFrame) -> DataFrame:
    """pool(qid, doc, dl, overlap, dense, dense_n, bm25_n, ...) with brevity, without the rows of questions that have no text."""
    return pool.where("overlap IS NOT NULL").withColumn("brevity", 1 / (1 + F.log1p("dl")))


def fit(rows: DataFrame) -> list[float] | None:
    """Weights of FEATURES from rows(qid, doc, relevant, features); none where no question has both kinds."""
    row = rows.select("qid", "relevant", F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES)).alias("f"))
    good, bad = row.where("relevant").select("qid", F.col("f").alias("g")), row.where("NOT relevant").select("qid", F.col("f").alias("b"))
    pairs = R.kept(good.join(bad, "qid").select(F.zip_with("g", "b", lambda x, y: x - y).alias("d")))  # within a pool: at most RERANK_POOL squared / 4 a question
    n = len(FEATURES)
    weights = np.zeros(n)
    for _ in range(STEPS):
        margin = sum((F.lit(float(w)) * F.col("d")[k] for k, w in enumerate(weights)), F.lit(0.0))
        p = 1 / (1 + F.exp(margin))  # how wrong the pair still is
        sums = pairs.withColumn("p", p).agg(F.count("*"), *(F.sum(F.col("p") * F.col("d")[i]) for i in range(n)), *(F.sum(F.col("p") * (1 - F.col("p")) * F.col("d")[i] * F.col("d")[j]) for i in range(n) for j in range(n))).first()
        if not sums[0]:
            return None
        gradient, second = np.array(sums[1 : n + 1]) - PENALTY * weights, np.array(sums[n + 1 :]).reshape(n, n) + PENALTY * np.eye(n)
        move = np.linalg.solve(second, gradient)
        weights = weights + move
        if np.abs(move).max() < 1e-9:
            break
    return weights.tolist()


def rerank(rows: DataFrame, weights: list[float] | None, order: str = "hrank", k: int | None = None) -> DataFrame:
    """rows with rerank and final (1, 2, ...): by the model's score, ties and a missing model by the pool's order."""
    score = F.lit(None).cast("double") if weights is None else F.round(sum((F.lit(w) * F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c, w in zip(FEATURES, weights, strict=True)), F.lit(0.0)), 9)
    scored = rows.withColumn("rerank", score)
    return R.top_k(scored, k or R.RERANK_POOL, F.desc_nulls_last("rerank"), F.asc(order), rank="final")
