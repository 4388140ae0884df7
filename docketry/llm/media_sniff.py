"""Media columns: signature sniffing, type correction and carving.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over a value. At each hit the format's
validator walks the structure and gives its length, or refuses; what passes is a medium. A medium at the value's start
gives the value's type, whatever was declared; further ones are embedded, in the value (depth 0) or within another medium (one
deeper than that). Of two that would overlap without one being in the other, the one that starts first stays.

`store` wraps a text's bytes as the 8-bit samples of a WAV, BMP or PNG (by the CRC of the payload), `inspect` sniffs a
binary column, `carve` cuts every medium out into a row of its own. Rows without doc_id are no documents. Null texts are empty; null media
have no type and no spans; a very long text is one long medium. Repeated rows are stored each. Columns of a table that have the name of
one that is added get `_in` after it. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docketry.llm.common import slices, texts_of

UNIT = 576
WIDTH = 24
FILL = b"\xff"
#: Magic bytes of the formats, and how far before them the medium begins.
MAGIC = {
    "bmp": (b"BM", 0),
    "gif": (b"GIF8", 0),
    "jpeg": (b"\xff\xd8\xff", 0),
    "png": (b"\x89PNG\r\n\x1a\n", 0),
    "wav": (b"RIFF", 0),
}


def _png(data: bytes, at: int) -> int:
    """Length of the PNG at `at`, or 0: every chunk whole and with its CRC, IHDR first, IEND last."""
    pos, first = at + 8, True
    while pos + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, pos)
        end = pos + 12 + n
        if end > len(data) or first != (kind == b"IHDR") or zlib.crc32(data[pos + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return 0
        if kind == b"IEND":
            return end - at
        pos, first = end, False
    return 0


def _wav(data: bytes, at: int) -> int:
    if data[at + 8 : at + 12] != b"WAVE" or len(data) < at + 44:
        return 0
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return 0
    pos, seen = at + 12, set()
    while pos + 8 <= end:
        kind, n = struct.unpack_from("<4sI", data, pos)
        seen.add(kind)
        pos += 8 + n + n % 2
    return end - at if pos == end and {b"fmt ", b"data"} <= seen else 0


#: Lengths of the picture headers; the first has shorter fields.
BMP_HEADERS = (12, 40, 52, 56, 64, 108, 124)


def _bmp(data: bytes, at: int) -> int:
    if len(data) < at + 26:
        return 0
    n, _, start, header = struct.unpack_from("<IIII", data, at + 2)
    if header not in BMP_HEADERS or len(data) < at + 14 + header or n > len(data) - at:
        return 0
    width, height, planes, bits = struct.unpack_from("<HHHH" if header == 12 else "<iiHH", data, at + 18)
    packed, size = struct.unpack_from("<II", data, at + 30) if header > 12 else (0, 0)
    body = size if packed in (1, 2) else (width * bits + 31) // 32 * 4 * abs(height)
    return n if planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and height and 14 + header <= start and start + body <= n else 0


def _gif(data: bytes, at: int) -> int:
    if data[at + 4 : at + 6] not in (b"7a", b"9a") or len(data) < at + 13:
        return 0
    table = lambda flags: 3 << (flags & 7) + 1 if flags & 128 else 0
    pos = at + 13 + table(data[at + 10])
    while pos < len(data):
        if data[pos] == 0x3B:
            return pos + 1 - at
        if data[pos] == 0x21:
            pos += 2
        elif data[pos] == 0x2C and pos + 10 <= len(data):
            pos += 11 + table(data[pos + 9])
        else:
            return 0
        while pos < len(data) and data[pos]:
            pos += 1 + data[pos]
        pos += 1
    return 0


def _jpeg(data: bytes, at: int) -> int:
    pos = at + 2
    while pos + 4 <= len(data) and data[pos] == 0xFF:
        marker = data[pos + 1]
        if marker == 0xD9:
            return pos + 2 - at
        n = struct.unpack_from(">H", data, pos + 2)[0]
        if n < 2 or not 0xC0 <= marker <= 0xFE:
            return 0
        pos += 2 + n
        if marker == 0xDA:  # entropy-coded: up to the next marker that is no stuffed byte or restart
            while (pos := data.find(b"\xff", pos)) >= 0 and pos + 1 < len(data) and (data[pos + 1] == 0 or 0xD0 <= data[pos + 1] <= 0xD7):
                pos += 2
            if pos < 0:
                return 0
    return pos + 2 - at if data[pos : pos + 2] == b"\xff\xd9" else 0


VALIDATORS: dict[str, Callable[[bytes, int], int]] = {"bmp": _bmp, "gif": _gif, "jpeg": _jpeg, "png": _png, "wav": _wav}


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, (magic, back) in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic) - 1 + back))
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[tuple[str, int, int, int]]:
    """(type, start, length, depth) of every medium whose structure is confirmed, in order."""
    spans: list[tuple[str, int, int, int]] = []
    around: list[int] = []  # where the media that are open end
    for start, kind in sorted((last - back, kind) for last, (kind, back) in _automaton().iter(data.decode("latin-1"))):
        while around and around[-1] <= start:
            around.pop()
        n = VALIDATORS[kind](data, start)
        if n and (not around or start + n <= around[-1]):
            spans.append((kind, start, n, len(around)))
            around.append(start + n)
    return spans


def samples(kind: str, data: bytes) -> bytes:
    """The 8-bit samples of a medium that `wrap` made."""
    if kind == "wav":
        return data[44 : 44 + struct.unpack_from("<I", data, 40)[0]]
    if kind == "bmp":
        return data[struct.unpack_from("<I", data, 10)[0] :]
    pos, parts = 8, []
    while pos < len(data):
        n, chunk = struct.unpack_from(">I4s", data, pos)
        if chunk == b"IDAT":
            parts.append(data[pos + 8 : pos + 8 + n])
        pos += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(-1, WIDTH + 1)
    return rows[:, 1:].tobytes()


def payload_of(text: str) -> bytes:
    data = text.encode()
    return data + FILL * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def wrap(kind: str, payload: bytes) -> bytes:
    """The payload as 8-bit samples: mono sound, or grey picture rows of WIDTH."""
    n, rows = len(payload), len(payload) // WIDTH
    if kind == "wav":
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + payload
    if kind == "bmp":
        grey = b"".join(bytes((k, k, k, 0)) for k in range(256))
        return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 1078 + n, 0, 1078, 40, WIDTH, -rows, 1, 8, 0, n, 2835, 2835, 256, 0) + grey + payload
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


KINDS = ("wav", "bmp", "png")


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared, media: each whole text as a medium; all are declared PNG, as a careless crawler would."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            media = [wrap(KINDS[zlib.crc32(p) % len(KINDS)], p) for p in map(payload_of, texts)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(["png"] * len(texts)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "declared", "media"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary")


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("depth", pa.int32())]))


def _renamed(media: DataFrame, added: tuple[str, ...]) -> DataFrame:
    """The table with `_in` after names that are added."""
    taken = {c.lower() for c in (*media.columns, *added)}
    for c in media.columns:
        if c.lower() in added:
            new = c + "_in"
            while new.lower() in taken:
                new += "_in"
            taken.add(new.lower())
            media = media.withColumnRenamed(c, new)
    return media


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def inspect(media: DataFrame) -> DataFrame:
    """All columns of a table with `declared` and `media`, and: kind (of the medium at the start, null if none), corrected
    (whether it isn't the declared one), spans (kind, start, length, depth of every medium)."""
    media = _renamed(media, ("kind", "corrected", "spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sniff(m) if m is not None else [] for m in batch["media"].to_pylist()]
            kinds = [s[0][0] if s and s[0][1] == 0 else None for s in found]
            wrong = [k is not None and k != d for k, d in zip(kinds, batch["declared"].to_pylist(), strict=True)]
            spans = [[{"kind": k, "start": a, "length": n, "depth": d} for k, a, n, d in s] for s in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.string()), pa.array(wrong, pa.bool_()), pa.array(spans, _SPAN)], [*batch.schema.names, "kind", "corrected", "spans"])

    return media.mapInArrow(run, f"{_fields(media)}, kind string, corrected boolean, spans array<struct<kind:string,start:long,length:long,depth:int>>")


def carve(media: DataFrame) -> DataFrame:
    """A row for every medium in a table with `media`: the row's other columns, and kind, start, length, depth, bytes and sha256 of the medium."""
    media = _renamed(media, ("kind", "start", "length", "depth", "bytes", "sha256"))
    others = [c for c in media.columns if c != "media"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for k, data in enumerate(batch["media"].to_pylist()):
                if data is None or not (found := sniff(data)):
                    continue
                cut = [data[a : a + n] for _, a, n, _ in found]
                kind, start, length, depth = zip(*found, strict=True)
                same = [pa.concat_arrays([batch[c].slice(k, 1)] * len(found)) for c in others]
                yield pa.RecordBatch.from_arrays([*same, pa.array(kind), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(depth, pa.int32()), pa.array(cut, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in cut])], [*others, "kind", "start", "length", "depth", "bytes", "sha256"])

    own = _fields(media.select(*others))
    return media.select(*others, "media").mapInArrow(run, f"{own}{', ' * bool(own)}kind string, start long, length long, depth int, bytes binary, sha256 string")


def digests(docs: DataFrame) -> DataFrame:
    """Per document: the payload as read back from the medium that is carved out of the stored value, and what sniffing found."""
    carved = carve(inspect(store(docs))).where("start = 0 AND depth = 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for r in batch.to_pylist():
                back = samples(r["kind"], r["bytes"])
                levels = np.frombuffer(back, np.uint8)
                spans = "+".join(f"{'>' * s['depth']}{s['kind']}@{s['start']}:{s['length']}" for s in r["spans"])
                feature = f"{r['kind_in']};corrected={int(r['corrected'])};{spans};mean={levels.mean():.4f};max={levels.max()}"
                rows.append({"doc_id": r["doc_id"], "n_bytes": r["n_bytes"], "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-32:]), "media_bytes": r["length"], "media_sha256": r["sha256"], "feature": feature})
            yield pa.RecordBatch.from_pylist(rows)

    return carved.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
