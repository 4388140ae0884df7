"""Near-duplicates of the pipeline against all pairs compared, on similarity alone."""

import random

import pytest

import corpus_pipeline
from docketry.llm import similar
from tests.llm.cases import TEXTS, documents, empty
from tests.llm.test_pipeline import brute_kept


def edited(words, share, rng):
    return " ".join(f"x{rng.randrange(10**9)}" if rng.random() < share else w for w in words)


def families():
    """Copies of long and short texts, edited lightly (similar) and more (not similar, but with near fingerprints of words)."""
    rng, out = random.Random(5), []
    for n in (12, 40, 90, 400, 2000):
        for _ in range(6):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            out += [" ".join(words)] + [edited(words, share, rng) for share in (0.005, 0.015, 0.02, 0.03, 0.06, 0.1)]
    rng.shuffle(out)
    return dict(enumerate(out))


def kept(docs):
    return {r.doc_id for r in docs.where("doc_id IS NOT NULL").collect()}


def test_stage_keeps_one_of_what_is_similar(spark):
    for texts in (TEXTS, families()):
        docs = documents(spark, texts)
        out = corpus_pipeline.drop_near_duplicates(spark, docs, None)
        assert kept(out) == brute_kept(texts) and out.columns == docs.columns
    assert similar.keep_one(empty(spark)).collect() == []


@pytest.mark.parametrize(("run", "piece"), [(4096, 1 << 22), (5, 60)])
def test_large_class_in_pieces(spark, run, piece):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    texts = {k: edited(words, 0.01 if k % 2 else 0.03, rng) for k in range(120)}
    root = {k: k for k in texts}
    for a, b in similar.links(documents(spark, texts), run, piece).collect():
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    assert {k for k in texts if root[k] == k} == brute_kept(texts)
