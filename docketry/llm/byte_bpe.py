"""Ids of a byte-level BPE vocabulary, from the tokenizers library, with its work kept per distinct piece of text.

A text is cut before each space that a non-space follows: the vocabulary's own pattern always cuts there, so the ids of
the whole text are those of the parts, one after the other. Parts repeat a great deal: Arrow cuts a batch of texts and numbers
its distinct parts, each worker keeps the ids of parts it has seen, and the library is asked only for new ones. What is kept
is bounded: when the young generation is full the old one goes, and what is asked for again comes back from it.
"""

from __future__ import annotations

import gc
import os
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

END_ID = 0
#: Texts that are encoded together: the more, the more of their parts are the same.
BATCH = 1024
#: What a worker keeps at most of either generation: ids of parts, and of the pieces that they are made of (about 200 bytes each).
CACHE_PARTS, CACHE_WORDS = 200_000, 50_000
#: The vocabulary's pattern on ASCII without control characters other than tab, line feed and return.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
#: The pattern itself, used on text of ASCII and Latin letters, where every Unicode version has the same classes.
_LATIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e]*[\x21-\x7e]\Z")
_LATIN_TEXT = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f]*[\x21-\x7e\xa1-\u024f]\Z")
_ODD_SPACE = re.compile(r" (?!\S)")
_CUT = re.compile(r" (?=\S)")
_BLANK = " \t\n\r"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Kept(dict):
    """A bounded dictionary of two generations."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.old = most, {}

    def find(self, keys: list[str]) -> list[bytes | None]:
        found = list(map(self.get, keys))
        if self.old and None in found:
            old = self.old.get
            for k, value in enumerate(found):
                if value is None and (value := old(keys[k])) is not None:
                    found[k] = self[keys[k]] = value
        return found

    def turn(self) -> None:
        """To be called between batches."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class ByteBpe:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model, self.pre = self.library.model, self.library.pre_tokenizer
        self.bare = Tokenizer(self.model)
        self.letters = _byte_letters()
        self.codes = np.array([ord(self.letters[b]) for b in range(256)], "<u2")
        used = Counter(c for token in self.library.get_vocab(with_added_tokens=False) for c in set(token))
        # a byte that no text has that is cut here, and whose letter is in its own token alone
        self.mark = next((chr(b) for b in range(1, 9) if used[self.letters[b]] == 1 and self.bare.token_to_id(self.letters[b]) is not None), None)
        self.mark_id = self.bare.token_to_id(self.letters[ord(self.mark)]) if self.mark else None
        self.words = Kept(CACHE_WORDS)  # the library's ids of one piece of the vocabulary's pattern
        self.parts = Kept(CACHE_PARTS)  # of a part, without the space before it

    def _pieces(self, joined: str) -> list[str]:
        """The vocabulary's pattern over parts that follow one another, each with its space."""
        if joined.isascii():
            return _ASCII.findall(joined)
        return _LATIN.findall(joined)

    def _tokenized(self, pieces: list[str]) -> list[bytes]:
        """The library's ids of each piece. Pieces go to its model joined by a letter that is in no token but its own, so that
        no merge goes over it."""
        if self.mark is None:
            return [b"".join([t.id.to_bytes(2, "little") for t in self.model.tokenize("".join([self.letters[b] for b in p.encode()]))]) for p in pieces]
        out: list[bytes] = []
        for k in range(0, len(pieces), 2048):
            raw = np.frombuffer(self.mark.join(pieces[k : k + 2048]).encode(), np.uint8)
            letters = self.codes[raw].tobytes().decode("utf-16-le")
            ids = np.array(self.bare.encode_batch_fast([letters], add_special_tokens=False)[0].ids, "<u2")
            cut = 2 * np.flatnonzero(ids == self.mark_id)
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *(cut + 2).tolist()], [*cut.tolist(), len(data)], strict=True)]
        return out

    def _words(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces of the vocabulary's pattern: one with a space before it is a part of its own."""
        spaced = [p for p in pieces if p[0] == " " and p[1:] and p[1] not in _BLANK]
        found = dict(zip(spaced, self.parts.find([p[1:] for p in spaced]), strict=True))
        other = list(pieces.difference(found))
        found.update(zip(other, self.words.find(other), strict=True))
        new = [p for p, value in found.items() if value is None]
        for piece, value in zip(new, self._tokenized(new), strict=True):
            found[piece] = value
            if piece[0] == " " and piece[1:] and piece[1] not in _BLANK:
                self.parts[piece[1:]] = value
            else:
                self.words[piece] = value
        return found

    def _learn(self, new: list[str]) -> None:
        """Keeps the ids of new parts, each with the space that stands before it."""
        whole: list[str] = []
        plain: list[str] = []
        latin: list[str] = []
        for p in new:
            if p.isascii():
                if p.isalpha():
                    whole.append(p)
                elif _PLAIN.match(p):
                    plain.append(p)
                else:
                    self.parts[p] = self._alone(" " + p)
            elif not _LATIN_TEXT.match(p):
                self.parts[p] = self._alone(" " + p)
            elif p.isalpha():
                whole.append(p)
            else:
                latin.append(p)
        self.parts.update(zip(whole, self._tokenized([" " + p for p in whole]), strict=True))
        for group in (plain, latin):
            pieces = self._pieces(" " + " ".join(group)) if group else []
            found = self._words(set(pieces))
            sizes, ids, k = list(map(len, pieces)), list(map(found.__getitem__, pieces)), 0
            for part in group:
                left, first = len(part) + 1, k
                while left > 0:
                    left -= sizes[k]
                    k += 1
                self.parts[part] = ids[first] if k == first + 1 else b"".join(ids[first:k])

    def _alone(self, text: str) -> bytes:
        """Ids of a text by the library's own cut."""
        return b"".join([np.array([t.id for t in self.model.tokenize(piece)], "<u2").tobytes() for piece, _ in self.pre.pre_tokenize_str(text)])

    def _parts(self, distinct: list[str]) -> list[bytes]:
        found = self.parts.find(distinct)
        if None in found:
            missing = [k for k, value in enumerate(found) if value is None]
            self._learn([distinct[k] for k in missing])
            for k in missing:
                found[k] = self.parts[distinct[k]]
        return found

    def _cut_encode(self, cut: pa.LargeListArray) -> list[np.ndarray]:
        """Ids of texts that are cut into parts; all but a text's first part have lost the space before them."""
        flat, first = cut.flatten(), cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        coded = flat.dictionary_encode()
        number = coded.indices.to_numpy().astype(np.int64)
        heads = flat.take(pa.array(first)).to_pylist()
        values = self._parts(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        number[first] = len(values) + np.arange(len(first))
        values += [self._alone(head) if head else b"" for head in heads]
        size = np.fromiter(map(len, values), np.int64, len(values)) >> 1
        start, n = np.cumsum(size) - size, size[number]
        ends = np.cumsum(n)
        ids = np.frombuffer(b"".join(values), "<u2")[np.repeat(start[number] - (ends - n), n) + np.arange(int(ends[-1]))]
        last = np.append(first[1:], len(number)) - 1
        return [ids[a:b] for a, b in zip((ends[first] - n[first]).tolist(), ends[last].tolist(), strict=True)]

    def encode_arrays(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of each whole text, as unsigned 16-bit integers; an empty text has none."""
        collecting = gc.isenabled()
        gc.disable()  # the dictionaries hold no cycles, and walking them is most of the time
        try:
            out: list[np.ndarray] = [np.empty(0, np.uint16)] * len(texts)
            plain, odd = [], []
            for k, t in enumerate(texts):
                if any(token in t for token in self.special):
                    out[k] = np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint16)
                elif t:
                    (odd if _ODD_SPACE.search(t) else plain).append(k)
            if plain:
                for k, ids in zip(plain, self._cut_encode(pc.split_pattern(pa.array([texts[k] for k in plain], pa.large_string()), " ")), strict=True):
                    out[k] = ids
            if odd:
                for k, ids in zip(odd, self._cut_encode(pa.array([_CUT.split(texts[k]) for k in odd], pa.large_list(pa.large_string()))), strict=True):
                    out[k] = ids
            self.parts.turn()
            self.words.turn()
            return out
        finally:
            if collecting:
                gc.enable()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """As encode_arrays, in little-endian bytes."""
        return [ids.astype("<u2", copy=False).tobytes() for ids in self.encode_arrays(texts)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@cache
def byte_bpe(path: str) -> ByteBpe:
    """One per worker process and vocabulary."""
    return ByteBpe(path)
