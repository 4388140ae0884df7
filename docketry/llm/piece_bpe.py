"""SentencePiece ids of whole texts for merge-type (BPE) vocabularies, by a score-ordered agenda of adjacent symbol pairs.

The text is normalised as the model says (identity, spaces as U+2581, one before the text), cut into segments that no piece
of the vocabulary crosses, and each segment is merged: an agenda holds every adjacent pair whose union is a piece, the best
score first (of equal scores the leftmost); taking a pair puts its union's pairs with both neighbours on the agenda.
Symbols that are no piece become byte pieces. Segments repeat, and a worker keeps those it has merged (bounded, cleared when
full). In every Arrow batch the sentencepiece library encodes and decodes all texts too: where it differs, its ids and text are the
result and the row says so (`differs`).

Rows without doc_id are no documents. Null texts are empty: begin and end ids alone. A very long text is encoded whole. Repeated rows are
encoded each. Columns other than doc_id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docketry.llm.common import slices, texts_of

SPACE = "▁"
CACHE_SEGMENTS = 1_000_000
_LONGEST_KEPT = 64
_ODD_SPACE = re.compile(f"[ {SPACE}](?:[ {SPACE}]|$)|^[ {SPACE}]")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceBpe:
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        if n > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        plain = [k for k in range(n) if not (lib.is_control(k) or lib.is_unknown(k) or lib.is_byte(k) or lib.is_unused(k))]
        self.ids = {lib.id_to_piece(k): k for k in plain}
        self.scores = {piece: lib.get_score(k) for piece, k in self.ids.items()}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        self.inside = {piece[k : k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        # a segment is a run of spaces and what follows up to the next space, if no piece goes on over such a place
        self.simple = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if self.simple else re.compile("(?s).+")
        self.surface = [b""] * n
        for piece, k in self.ids.items():
            self.surface[k] = piece.replace(SPACE, " ").encode()
        for b, k in enumerate(self.bytes):
            self.surface[k] = bytes([b])
        self.words: dict[str, bytes] = {}
        self.segments: dict[str, bytes] = {}

    def merge(self, text: str) -> bytes:
        """Ids of one segment, as little-endian 16-bit integers."""
        scores = self.scores
        symbols: list[str | None] = list(text)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for k in range(n - 1):
            score = scores.get(text[k : k + 2])
            if score is not None:
                agenda.append((-score, k, text[k : k + 2]))
        heapq.heapify(agenda)
        while agenda:
            _, k, union = heapq.heappop(agenda)
            left = symbols[k]
            if left is None:
                continue
            right = after[k]
            if right >= n or len(left) + len(symbols[right]) != len(union) or left + symbols[right] != union:
                continue
            symbols[k], symbols[right] = union, None
            after[k] = right = after[right]
            if right < n:
                before[right] = k
                score = scores.get(both := union + symbols[right])
                if score is not None:
                    heapq.heappush(agenda, (-score, k, both))
            left = before[k]
            if left >= 0:
                score = scores.get(both := symbols[left] + union)
                if score is not None:
                    heapq.heappush(agenda, (-score, left, both))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                k = self.ids.get(s)
                if k is None:
                    out += [self.bytes[b] for b in s.encode()]
                else:
                    out.append(k)
        return np.array(out, "<u2").tobytes()

    def _segment(self, text: str) -> bytes:
        """A segment, further cut between letters that no piece has side by side."""
        words, inside, start, out = self.words, self.inside, 0, []
        for k in range(1, len(text) + 1):
            if k == len(text) or text[k - 1 : k + 1] not in inside:
                word, start = text[start:k], k
                found = words.get(word)
                if found is None:
                    found = self.merge(word)
                    if len(word) <= _LONGEST_KEPT:
                        if len(words) >= CACHE_SEGMENTS:
                            words.clear()
                        words[word] = found
                out.append(found)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """The library's ids of the whole text with begin and end, as unsigned 32-bit integers."""
        if not text:
            return np.array([self.begin, self.end], "<u4")
        if self.simple and not _ODD_SPACE.search(text):  # one space before each segment: kept without it
            segments, kept = text.replace(SPACE, " ").split(" ") if SPACE in text else text.split(" "), self.segments
            for segment in set(segments).difference(kept):
                if len(kept) >= CACHE_SEGMENTS and len(segments) < CACHE_SEGMENTS // 2:
                    kept.clear()
                    return self.encode(text)
                kept[segment] = self._segment(SPACE + segment)
            out = map(kept.__getitem__, segments)
        else:
            out = map(self._segment, self.cut.findall(SPACE + text.replace(" ", SPACE)))
        middle = np.frombuffer(b"".join(out), "<u2").astype("<u4")
        return np.concatenate((np.array([self.begin], "<u4"), middle, np.array([self.end], "<u4")))

    def decode(self, ids: np.ndarray) -> str:
        """The library's text of the ids: surfaces joined, without the space that encoding puts before the text."""
        data = b"".join(map(self.surface.__getitem__, ids.tolist()))
        try:
            text = data.decode()
        except UnicodeDecodeError:  # bytes that are no UTF-8: as the library replaces them
            return self.library.decode(ids.tolist())
        return text[1:] if text[:1] == " " and len(ids) > 1 and self.library.id_to_piece(int(ids[1]))[:1] == SPACE else text


@cache
def piece_bpe(path: str) -> PieceBpe:
    """One per worker process and model."""
    return PieceBpe(path)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def checked(bpe: PieceBpe, doc_ids: list[int], texts: list[str]) -> Iterator[tuple[int, np.ndarray, str, bool]]:
    """(doc_id, ids, decoded text, whether the library, which is asked for every row, had others: then they are the library's)."""
    for doc_id, text in zip(doc_ids, texts, strict=True):
        ids = bpe.encode(text)
        decoded = bpe.decode(ids)
        theirs = bpe.library.encode(text, add_bos=True, add_eos=True)
        back = bpe.library.decode(theirs)
        differs = theirs != ids.tolist() or back != decoded
        yield (doc_id, np.array(theirs, "<u4"), back, True) if differs else (doc_id, ids, decoded, False)


def _runs(docs: DataFrame, model: str | None, schema: str, row) -> DataFrame:
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = piece_bpe(path)
        for batch in slices(batches):
            collecting = gc.isenabled()
            gc.disable()  # the dictionaries hold no cycles
            out = [row(*found) for found in checked(bpe, batch["doc_id"].to_pylist(), batch["text"].to_pylist())]
            if collecting:
                gc.enable()
            yield pa.RecordBatch.from_pylist(out)

    return texts_of(docs).mapInArrow(run, schema)


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids, decoded, differs: the ids with begin and end, and the text they decode to."""
    return _runs(docs, model, "doc_id long, ids array<int>, decoded string, differs boolean", lambda d, ids, text, differs: {"doc_id": d, "ids": ids.astype(np.int32), "decoded": text, "differs": differs})


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, the SHA-256 of the ids and of the decoded text, and differs."""
    return _runs(docs, model, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, differs boolean", lambda d, ids, text, differs: {"doc_id": d, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(text.encode()).hexdigest(), "differs": differs})
