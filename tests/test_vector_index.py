"""The inverted-file index: recall, exactness with every list, pruning, odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketry.operators import retrieval, vector_index
from docketry.operators.vector_index import VectorIndex


def vectors(spark, n=3000, dim=32):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, dim))
    rows = [(k, (centres[k % 40] + 0.6 * rng.normal(size=dim)).tolist(), k % 7) for k in range(n)]
    rows += [(n + k, centres[0].tolist(), 9) for k in range(700)]  # a large group of copies
    rows += [(9000, [0.0] * dim, 1), (9001, None, 1), (None, centres[1].tolist(), 1)]
    return spark.createDataFrame(rows, "doc long, embedding array<float>, label int").repartition(4)


def questions(rows):
    return rows.where("doc % 50 = 0").select(F.col("doc").alias("qid"), "embedding")


def test_recall_and_exactness(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 256)
    monkeypatch.setattr(vector_index, "BLOCK", 20)
    rows = vectors(spark)
    index = VectorIndex.build(rows, f"{tmp_path}/index")
    best = retrieval.top_k(retrieval.dense_scores(questions(rows), rows, 100), 100, F.desc("dense"), F.asc("doc"))
    want = {(r.qid, r.doc): (r.dense, r["rank"]) for r in best.collect()}
    got = {(r.qid, r.doc): (r.dense, r["rank"]) for r in index.search(questions(rows), 100, every=True).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()} and all(abs(v[0] - want[k][0]) < 2e-6 for k, v in got.items())
    # any row of the same score will do: copies tie
    floor = {}
    for (q, _), (score, _) in want.items():
        floor[q] = min(floor.get(q, 9), score)
    found = index.search(questions(rows), 100).collect()
    assert sum(r.dense >= floor[r.qid] - 1e-6 for r in found) >= 0.9 * len(want)
    assert len(found) == len(want)


@pytest.mark.parametrize(("sf", "k"), [("sf0.01", 200), ("sf0.1", 200), ("sf0.1", 10)])
def test_recall_on_embeddings(spark, tmp_path, sf, k):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc"), "embedding")
    index = VectorIndex.build(rows, f"{tmp_path}/{sf}", k)
    best = retrieval.top_k(retrieval.dense_scores(questions(rows), rows, k), k, F.desc("dense"), F.asc("doc")).select("qid", "doc")
    shared = index.search(questions(rows), k).select("qid", "doc").intersect(best).count()
    print(sf, k, index.least, len(index.centres), shared / best.count())
    assert shared >= 0.9 * best.count()


def test_unasked_lists_stay_closed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "OVER", 1)
    monkeypatch.setattr(vector_index, "RECALL", 0.0)
    rows = vectors(spark)
    index = VectorIndex.build(rows, f"{tmp_path}/index", lists=30)
    found = index.search(rows.where("doc = 3").select(F.col("doc").alias("qid"), "embedding"), 5, where=F.col("label") == 3)
    assert {r.doc for r in found.join(rows, "doc").where("label <> 3").select("doc").collect()} == set() and found.count() == 5
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    assert "EqualTo(label,3)" in plan
    assert "struct<doc:bigint,codes:binary" in plan.replace("label:int,", "")  # codes are scanned without vectors


def test_empty(spark, tmp_path):
    rows = vectors(spark).limit(0)
    index = VectorIndex.build(rows, f"{tmp_path}/none")
    assert index.search(questions(vectors(spark)), 5).count() == 0
    full = VectorIndex.build(vectors(spark), f"{tmp_path}/full")
    assert full.search(questions(rows), 5).count() == 0


def test_grid(spark, monkeypatch):
    """Any dealing into blocks and lots gives the same rows, of equal scores the smaller ids."""
    rows = vectors(spark, 400)
    want = sorted(map(tuple, retrieval.dense_scores(questions(rows), rows).collect()))
    monkeypatch.setattr(retrieval, "BLOCK", 5)
    monkeypatch.setattr(retrieval, "LOT", 90)
    assert sorted(map(tuple, retrieval.dense_scores(questions(rows), rows).collect())) == want
    kept = retrieval.top_k(retrieval.dense_scores(questions(rows), rows, 7), 7, F.desc("dense"), F.asc("doc"))
    whole = retrieval.top_k(retrieval.dense_scores(questions(rows), rows), 7, F.desc("dense"), F.asc("doc"))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, whole.collect()))


def _sizes(keep):
    """In place of a cell's products: how many questions and vectors meet."""

    def run(asked, rows):
        return pa.table({"qid": pa.array([asked.num_rows], pa.int64()), "doc": pa.array([rows.num_rows], pa.int64()), "dense": [0.0]})

    return run


def test_cells_of_all_scores_are_small(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SIDE", 64)
    rows = vectors(spark).where("doc IS NOT NULL AND embedding IS NOT NULL")
    whole = sorted(map(tuple, retrieval.top_k(retrieval.dense_scores(questions(rows), rows), 50, F.desc("dense"), F.asc("doc")).collect()))
    assert whole == sorted(map(tuple, retrieval.top_k(retrieval.dense_scores(questions(rows), rows, 50), 50, F.desc("dense"), F.asc("doc")).collect()))
    monkeypatch.setattr(retrieval, "_cell", _sizes)
    cells = retrieval.dense_scores(questions(rows), rows).collect()
    assert max(r.qid * r.doc for r in cells) < 3 * 64**2 and sum(r.qid * r.doc for r in cells) == questions(rows).count() * rows.count()


def test_short_lists_share_cells(spark, tmp_path, monkeypatch):
    """Many lists, few cells: what a cell gives out is bounded by the cells' number, not the lists'."""
    monkeypatch.setattr(vector_index, "PART", 500)
    rows = vectors(spark).where("doc IS NOT NULL AND embedding IS NOT NULL")
    index = VectorIndex.build(rows, f"{tmp_path}/index", lists=300)
    cells = index._cells([at for at in range(len(index.centres)) if index.sizes[at]])
    held = {}
    for at, first, n in cells:
        for c in range(first, first + n):
            held[c] = held.get(c, 0) + index.sizes[at] / n
    assert max(held.values()) <= 500 and len(held) <= 2 * -(-rows.count() // 500) + 1 and sum(held.values()) == rows.count()
    best = retrieval.top_k(retrieval.dense_scores(questions(rows), rows, 60), 60, F.desc("dense"), F.asc("doc"))
    want = {(r.qid, r.doc): r["rank"] for r in best.collect()}
    got = index.search(questions(rows), 60, every=True)
    assert {(r.qid, r.doc): r["rank"] for r in got.collect()} == want
    assert "v#" not in got._jdf.queryExecution().optimizedPlan().toString()  # no pairs with vectors on them
