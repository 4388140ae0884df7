"""Near-duplicates and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from docketry.llm import similar, simhash, suffix_dedup
from docketry.llm.common import components
from tests.llm.cases import TEXTS, documents, empty


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps):
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    values = np.array([fps[k] for k in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 4):
            a, b = find(i), find(ids[j])
            root[max(a, b)] = min(a, b)
    return {k: find(k) for k in fps}


def test_fingerprints_and_classes(spark):
    fps = {k: brute_fingerprint(t) for k, t in TEXTS.items()}
    want = brute_classes(fps)
    got = simhash.classes(documents(spark)).collect()
    assert len(got) == len(TEXTS) + 1
    assert all((r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id]) for r in got)
    assert simhash.classes(empty(spark)).collect() == []
    clash = documents(spark).selectExpr("doc_id", "text", "'x' AS fingerprint", "7 AS component_id", "text AS fp")
    assert sorted(map(tuple, simhash.classes(clash).collect())) == sorted(map(tuple, got))


def test_keep_one_finds_edited_copies(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = {0: " ".join(words), 5: " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))}
    for k in (1, 2):
        edited = list(words)
        for i in range(20 * k, 400, 50):
            edited[i] = f"x{k}{i}"
        texts[k] = " ".join(edited)
    assert {r.doc_id for r in similar.keep_one(documents(spark, texts, repeated=False)).where("doc_id IS NOT NULL").collect()} == {0, 5}


@pytest.mark.parametrize("run", [4096, 7])
def test_links_of_a_large_group(spark, run):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 3)
    fps = sorted({int(base[rng.integers(3)]) ^ sum({1 << int(b) for b in rng.integers(0, 63, rng.integers(0, 6))}) for _ in range(900)})
    want = brute_classes(dict(enumerate(fps)))
    rows = spark.createDataFrame([(f, k) for k, f in enumerate(fps)], "fp long, node long")
    found = {r.node: r.root for r in components(simhash.links(rows, run)).collect()}
    assert {k: found.get(k, k) for k in want} == want


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (7, 3), (4, 7), (100, 9), (8, 9)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 4: 1, 8: 8, 9: 8, 100: 8}
    assert components(edges.limit(0)).collect() == []


def brute_repeats(texts):
    first = {}
    for k in sorted(texts):
        for i in range(len(texts[k]) - 49):
            first.setdefault(texts[k][i : i + 50], k)
    out = {}
    for k, data in texts.items():
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 49):
            if first[data[i : i + 50]] < k:
                gone[i : i + 50] = True
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[k] = (len(data), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("heavy", "buckets"), [(1 << 17, None), (2, 5)])
def test_repeats(spark, heavy, buckets):
    want = brute_repeats({k: (t or "").encode() for k, t in TEXTS.items()})
    got = suffix_dedup.digests(documents(spark), heavy, buckets).collect()
    assert len(got) == len(TEXTS) + 1
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
    assert sum(v[1] for v in want.values()) > 1000


def test_repeats_empty_and_columns(spark):
    assert suffix_dedup.digests(empty(spark)).collect() == []
    docs = documents(spark)
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.where("doc_id IS NOT NULL").count()
    by = {r.doc_id: r for r in kept.collect()}
    assert by[0].text == TEXTS[0] and by[1].text == "" and by[1].n_chars == 0 and by[8].b == 8 and by[8].rest == "r"


def test_long_texts_are_dealt_in_blocks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 64)
    data = np.frombuffer(("abcdefghij" * 40 + "xyz" * 50).encode(), np.uint8)
    whole = suffix_dedup.anchors(data, np.array([len(data)]))
    assert whole[3].sum() == len(data) - 49
    assert suffix_dedup.anchors(data[:49], np.array([49]))[3].sum() == 0


def test_rows_of_one_id_with_different_texts(spark):
    """Each row is judged by itself, against smaller ids alone."""
    first, second = TEXTS[7], TEXTS[0]
    rows = [(1, first), (5, second), (5, first + " more"), (5, first + " more"), (9, second + " " + first), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.digests(docs).collect())
    want = []
    for k, t in rows:
        data, smaller = (t or "").encode(), [(u or "").encode() for j, u in rows if j < k]
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 49):
            if any(data[i : i + 50] in u for u in smaller):
                gone[i : i + 50] = True
        want.append((k, len(data), int(gone.sum()), hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
    assert got == sorted(want)


def test_ids_of_one_residue_are_spread():
    """Multiples of any number of buckets don't share one."""
    for step in (64, 1 << 20, 10**6):
        held = np.bincount(suffix_dedup._doc_bucket(np.arange(4096, dtype=np.int64) * step, 64), minlength=64)
        assert held.max() < 3 * held.mean()


def test_spark_and_numpy_deal_alike(spark):
    docs = documents(spark)
    got = suffix_dedup.digests(docs.selectExpr("doc_id * 64 AS doc_id", "text"), 1 << 17, 7)
    assert {r.n_bytes for r in got.collect()} == {len((t or "").encode()) for t in TEXTS.values()}
