"""The pipeline against a brute-force version: each stage again in plain Python, on all documents, with the library's ids."""

import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from docketry.llm import byte_bpe, language, packing, quality_lines, registry
from docketry.llm.common import stored, table
from tests.conftest import SF


def test_registered():
    found = registry.queries()
    assert {name.split("_")[0] for name in found} == {f"op{n}" for n in range(1, 14)}
    assert set(registry.oracle_sql()) == {"op12_lexical_search", "op13_fill_middle"}


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(texts):
    """The smallest doc_id of each class: sets of 5-word shingles with a similarity of 0.8 or more, all compared with all."""
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {k: shingles(t) for k, t in texts.items()}
    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {k for k in texts if find(k) == k}


def brute_without_repeats(texts):
    first, out = {}, {}
    data = {k: t.encode() for k, t in texts.items()}
    for k in sorted(data):
        for i in range(len(data[k]) - 49):
            first.setdefault(data[k][i : i + 50], k)
    for k, d in data.items():
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 49):
            if first[d[i : i + 50]] < k:
                gone[i : i + 50] = True
        out[k] = np.frombuffer(d, np.uint8)[~gone].tobytes().decode(errors="ignore")
    return out


def test_run(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    scorer = language.Scorer(language.dictionaries(docs))
    texts = {k: t for k, t in texts.items() if not scorer.score(t)[2]}
    field = quality_lines.fit(docs.where(docs.doc_id.isin(list(texts))), labels)
    texts = {k: t for k, t in texts.items() if field.documents([t])[0] >= quality_lines.GOOD_AT}
    kept = brute_kept(texts)
    texts = brute_without_repeats({k: t for k, t in texts.items() if k in kept})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
    kept = docs.collect()
    assert {r.doc_id: r.text for r in kept} == texts and all(r.n_chars == len(r.text) for r in kept)
    assert len(texts) > 100

    library = Tokenizer.from_file(byte_bpe.default_vocabulary())
    ids = {k: [*library.encode(t, add_special_tokens=False).ids, 0] for k, t in texts.items()}
    found, held = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        found[r.doc_id].append((r.piece, r.start, r.length))
        held[r.sequence_id].append((r.offset, r.length))
    assert set(found) == set(texts)
    for k, pieces in found.items():
        pieces.sort()
        assert [p for p, _, _ in pieces] == list(range(len(pieces)))
        assert [s for _, s, _ in pieces] == [sum(n for _, _, n in pieces[:i]) for i in range(len(pieces))]
        assert sum(n for _, _, n in pieces) == len(ids[k])
    for slots in held.values():
        slots.sort()
        assert [o for o, _ in slots] == [sum(n for _, n in slots[:i]) for i in range(len(slots))]
        assert sum(n for _, n in slots) <= packing.CAPACITY
    assert len(held) <= 1.02 * sum(map(len, ids.values())) / packing.CAPACITY + 1
