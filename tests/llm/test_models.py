"""Classifiers, chat roles and media: counts against brute force, held-out accuracy, structure."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np

from docketry.llm import language, media_sniff, quality_lines, quality_rules
from docketry.llm.common import table
from tests.llm.cases import TEXTS, documents, empty, labels


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, repeated = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] >= 2:
            repeated |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_rules(spark):
    got = quality_rules.judge(documents(spark), labels(spark)).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        counts = brute_counts(TEXTS[r.doc_id] or "")
        assert tuple(r)[1:6] == counts
        assert r.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(empty(spark), labels(spark).limit(0)).collect() == []


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality_rules.FEATURES)))
    y = ((x[:, 2] + 0.3 * x[:, 0] + 0.1 * rng.random(3000)) < 0.7).astype(float)
    trees = quality_rules.grow(x, y)
    assert ((trees.quality(x) > 0.5) == y).mean() > 0.95
    for f in np.flatnonzero(quality_rules.DIRECTIONS < 0):
        probe = np.repeat(x[:200], 20, 0)
        probe[:, f] = np.tile(np.linspace(0, 1, 20), 200)
        assert (np.diff(trees.margin(probe).reshape(200, 20), axis=1) <= 1e-9).all()


def test_line_field_marginals():
    rng = np.random.default_rng(0)
    field = quality_lines.Field(rng.normal(size=quality_lines.FEATURES), rng.normal(size=(2, 2)), 1.0, 0.0)
    texts = ["one\ntwo!! X\n\nfour", "", "a | b\nc"]
    x, _, n = quality_lines.line_features(texts)
    good, pairs, z = field.marginals(x, n)
    at, total_pairs, log_z = 0, np.zeros((2, 2)), 0.0
    for m in n:
        e = np.stack((np.zeros(m), x[at : at + m] @ field.weights), 1)
        paths = [[int(c) for c in np.binary_repr(k, m)] for k in range(1 << m)]
        scores = np.array([sum(e[t, s] for t, s in enumerate(p)) + sum(field.chain[a, b] for a, b in zip(p, p[1:])) for p in paths])
        w = np.exp(scores - np.logaddexp.reduce(scores))
        assert np.allclose(good[at : at + m], [sum(w[k] for k, p in enumerate(paths) if p[t]) for t in range(m)])
        for k, p in enumerate(paths):
            for a, b in zip(p, p[1:]):
                total_pairs[a, b] += w[k]
        log_z += np.logaddexp.reduce(scores)
        at += m
    assert np.allclose(pairs, total_pairs) and np.isclose(z, log_z)


def test_lines_held_out(spark):
    docs, known = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    truth = {r.doc_id: r.quality for r in known.collect()}
    rows = [r for r in quality_lines.score(docs, known).collect() if r.held_out and r.doc_id in truth]
    assert len(rows) > 50 and sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows) > 0.9


def test_the_lines_gradient():
    """The gradient that training climbs, by moving each weight a little."""
    rng = np.random.default_rng(1)
    n = np.array([3, 1, 4])
    x, length, y = rng.normal(size=(8, quality_lines.FEATURES)), rng.random(8) + 0.5, np.array([1.0, 0.0, 0.0])

    def likelihood(theta):
        field = quality_lines.Field(theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2], theta[-1])
        p = field.scaled(quality_lines.aggregate(field.marginals(x, n)[0], length, n))
        return float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())

    theta = np.concatenate((rng.normal(size=quality_lines.FEATURES + 4) / 4, (1.5, -0.2)))
    field = quality_lines.Field(theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2], theta[-1])
    whole = quality_lines.aggregate(field.marginals(x, n)[0], length, n)
    miss = y - field.scaled(whole)
    share = length / np.repeat(np.add.reduceat(length, np.cumsum(n) - n), n)
    pull = 1e-4 * share * np.repeat(miss * field.slope / (whole * (1 - whole)), n)
    (up, pairs_up, _), (down, pairs_down, _) = field.marginals(x, n, pull), field.marginals(x, n, -pull)
    found = np.concatenate((x.T @ (up - down), (pairs_up - pairs_down).ravel())) / 2e-4
    for k in (0, 5, 17, len(theta) - 6, len(theta) - 4, len(theta) - 3):
        step = np.zeros_like(theta)
        step[k] = 1e-5
        assert np.isclose(found[k], (likelihood(theta + step) - likelihood(theta - step)) / 2e-5, rtol=1e-3, atol=1e-6)


def test_lines_of_half_good_documents(spark):
    """Documents put together of a good and a bad one: the field tells the halves apart."""
    docs, known = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    field = quality_lines.fit(docs, known)
    rows = docs.join(known, "doc_id").where("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2 AND length(text) > 300").select("doc_id", "text", "quality").orderBy("doc_id").collect()
    good, bad = ([r.text for r in rows if r.quality == q and r.text.count("\n") >= 2][:60] for q in (1, 0))
    apart = 0
    for a, b in zip(good, bad):
        x, length, n = quality_lines.line_features([a + "\n" + b])
        m, k = field.marginals(x, n)[0], a.count("\n") + 1
        apart += np.average(m[:k], weights=length[:k]) > 0.5 > np.average(m[k:], weights=length[k:])
    assert len(bad) >= 20 and apart / min(len(good), len(bad)) > 0.85


def test_lines_odd_cases(spark):
    got = quality_lines.score(documents(spark), labels(spark)).collect()
    assert len(got) == len(TEXTS) + 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1
    assert quality_lines.score(empty(spark), labels(spark).limit(0)).collect() == []
    assert quality_lines.keep_good(documents(spark), labels(spark)).columns == documents(spark).columns


def test_language(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in language.identify(docs).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows) > 0.95


def test_language_odd_cases(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 and got[k].rejected for k in (3, 4, 5))
    assert all(r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    assert language.identify(empty(spark)).collect() == []
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and not {3, 4, 5} & {r.doc_id for r in kept.collect()}


def test_media(spark):
    got = media_sniff.digests(documents(spark)).collect()
    assert len(got) == len(TEXTS) + 1
    kinds = set()
    for r in got:
        payload = media_sniff.payload_of(TEXTS[r.doc_id] or "")
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.n_bytes == len((TEXTS[r.doc_id] or "").encode()) and r.payload_bytes % 576 == 0
        kind = media_sniff.KINDS[zlib.crc32(payload) % 3]
        stored = media_sniff.wrap(kind, payload)
        levels = list(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == f"{kind};corrected={int(kind != 'png')};{kind}@0:{len(stored)};mean={sum(levels) / len(levels):.4f};max={max(levels)}"
        kinds.add(kind)
    assert len(kinds) == 3
    assert media_sniff.digests(empty(spark)).collect() == []


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\x00\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02\x01\xff\x00\x02\xff\xd9"


def test_sniffing():
    payload = media_sniff.payload_of("some text BM and RIFF and GIF87a")
    wav, bmp, png = (media_sniff.wrap(k, payload) for k in media_sniff.KINDS)
    found = media_sniff.sniff(b"junk" + png + b"??" + wav + bmp + GIF + JPEG + b"tail")
    assert [k for k, *_ in found] == ["png", "wav", "bmp", "gif", "jpeg"] and {d for *_, d in found} == {0}
    assert [n for _, _, n, _ in found] == [len(png), len(wav), len(bmp), len(GIF), len(JPEG)]
    assert all(media_sniff.samples(k, media_sniff.wrap(k, payload)) == payload for k in media_sniff.KINDS)
    broken = png[:40] + b"!" + png[41:]
    assert media_sniff.sniff(broken) == [] and media_sniff.sniff(wav[:-1]) == [] and media_sniff.sniff(b"") == []
    junk = b"JUNK" + struct.pack("<I", 4) + b"abcd"
    late = wav[:4] + struct.pack("<I", len(wav) - 8 + len(junk)) + b"WAVE" + junk + wav[12:]  # a chunk before the format
    assert [(k, n) for k, _, n, _ in media_sniff.sniff(late)] == [("wav", len(late))]
    n, long_header = 14 + 124 + 8 * 4, struct.pack("<IiiHHIIiiII", 124, 2, -4, 1, 24, 0, 0, 0, 0, 0, 0) + bytes(84)
    assert [(k, m) for k, _, m, _ in media_sniff.sniff(struct.pack("<2sIII", b"BM", n, 0, 138) + long_header + bytes(32))] == [("bmp", n)]


def test_media_within_media():
    inner = b"......" + GIF + b"...." + JPEG
    outer = media_sniff.wrap("wav", inner + b"\xff" * (576 - len(inner)))
    assert [(k, d) for k, _, _, d in media_sniff.sniff(b"x" + outer + GIF)] == [("wav", 0), ("gif", 1), ("jpeg", 1), ("gif", 0)]


def test_carving(spark):
    wav = media_sniff.wrap("wav", media_sniff.payload_of("a"))
    held = media_sniff.wrap("bmp", (b"..." + GIF).ljust(576, b"\xff"))
    rows = [(1, "gif", bytearray(b"??" + wav + held), "x", 7, 5.0), (2, "wav", None, "y", 8, 6.0), (3, "wav", bytearray(b"nothing"), "z", 9, 7.0), (4, "wav", bytearray(wav), "w", 1, 1.0), (4, "wav", bytearray(wav), "w", 1, 1.0)]
    media = spark.createDataFrame(rows, "id int, declared string, media binary, kind string, spans int, sha256 double")  # names that clash
    found = {r.id: r for r in media_sniff.inspect(media).collect()}
    assert (found[1].kind, found[1].kind_in, found[1].spans_in, found[4].kind, found[4].corrected, found[2].kind, found[2].spans) == (None, "x", 7, "wav", False, None, [])
    cut = sorted((r.id, r.start, r.kind, r.depth, bytes(r.bytes), r.sha256) for r in media_sniff.carve(media).collect())
    gif = 2 + len(wav) + 1078 + 3
    want = [(1, 2, "wav", 0, wav), (1, 2 + len(wav), "bmp", 0, held), (1, gif, "gif", 1, GIF), (4, 0, "wav", 0, wav), (4, 0, "wav", 0, wav)]
    assert cut == [(*w, hashlib.sha256(w[4]).hexdigest()) for w in want]
    assert media_sniff.carve(media).columns == ["id", "declared", "kind_in", "spans", "sha256_in", "kind", "start", "length", "depth", "bytes", "sha256"]
    assert media_sniff.carve(media.limit(0)).collect() == []


def test_language_is_the_smallest(spark):
    """Each verdict again with fresh compressors, block by block, and the ties and narrow margins."""
    import zstandard

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = language.dictionaries(docs)
    langs = list(texts)

    def sizes(text):
        data = language.letters(text).encode()
        blocks = [data[k : k + 1024] for k in range(0, len(data), 1024)]
        if len(blocks) > 1 and len(blocks[-1]) < 256:
            blocks[-2:] = [blocks[-2] + blocks[-1]]
        out = []
        for lang in langs:
            words = zstandard.ZstdCompressionDict(texts[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=3)
            out.append(sum(len(zstandard.ZstdCompressor(dict_data=words, level=3, write_checksum=False, write_content_size=False, write_dict_id=False).compress(b)) for b in blocks))
        return out

    want = {r.doc_id: r.text for r in docs.where("doc_id % 10 = 3").collect()}
    for r in language.identify(docs).where("doc_id % 10 = 3").collect():
        if not re.search(r"[^\W\d_]", want[r.doc_id] or ""):
            assert (r.lang_pred, r.rejected) == ("und", True)
            continue
        found = sizes(want[r.doc_id])
        best, second = sorted(found)[:2]
        assert r.lang_pred == langs[found.index(best)] and r.rejected == (1 - best / second < language.MARGIN)
    tie = language.Scorer({"aa": b"one two three " * 20, "bb": b"one two three " * 20})
    assert tie.score("one two three") == ("aa", 0.5, True)
    clash = docs.selectExpr("doc_id", "text", "lang", "1 AS score", "'x' AS lang_pred", "true AS rejected").limit(20)
    assert language.keep_identified(clash).columns == clash.columns and language.identify(clash, texts).columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]


def test_rules_kept_held_out(spark):
    """The verdict of texts that weren't learned from."""
    docs, known = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rows = quality_rules.judge(docs, known).join(known, "doc_id").where("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2 AND NOT base_failed").collect()
    assert len(rows) > 300 and sum(r.kept == bool(r.quality) for r in rows) / len(rows) > 0.95
