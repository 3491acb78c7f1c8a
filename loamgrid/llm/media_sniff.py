"""Op 6: media columns judged by their bytes instead of their declared type.

One Aho-Corasick automaton over the magic numbers of the known formats finds
every place where a medium may begin.  A validator for each format then walks the
structure from there and returns the medium's length, or nothing if
headers, chunk lengths or checksums don't hold.  A medium at byte 0 sets the type of
the column, whatever was declared; valid media further in are carved out.
The outermost medium wins: places inside one that is already carved are skipped,
but what stands inside the medium at byte 0 is listed.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.shared import table
from loamgrid.llm.words import slices

UNIT = 64
RATE = 8000


class Content:
    """Bytes, with what several walks over them share: places of marks, and where chains of parts lead.

    A chain's parts depend on where they stand, not on the medium that they are reached from, so a place
    that a walk has passed is not walked again: all walks together take time in proportion to the bytes.
    """

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.marks: dict[bytes, list[int]] = {}
        self.ends: dict[tuple, int | None] = {}

    def after(self, mark: bytes, at: int) -> int:
        """The first place from ``at`` on where the expression ``mark`` matches, or the end."""
        if mark not in self.marks:
            self.marks[mark] = [m.start() for m in re.finditer(mark, self.data, re.DOTALL)]
        i = bisect_left(self.marks[mark], at)
        return self.marks[mark][i] if i < len(self.marks[mark]) else len(self.data)

    def chain(self, kind: str, at: int, part: Callable[[bytes, int], tuple[int, bool] | None]) -> int | None:
        """The end of the chain of parts at ``at``; ``part`` gives a part's end and whether it is the last, or None if it is broken."""
        passed, end = [], None
        while (kind, at) not in self.ends:
            passed.append((kind, at))
            found = part(self.data, at)
            if found is None:
                break
            at, last = found
            if last:
                end = at
                break
        else:
            end = self.ends[kind, at]
        self.ends.update(dict.fromkeys(passed, end))
        return end


def _riff(c: Content, at: int) -> int | None:
    """RIFF: chunks that fill the stated length exactly; WAVE needs a format before its data, WEBP an image."""
    data = c.data
    if len(data) < at + 20 or data[at : at + 4] != b"RIFF":
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    first = b"fmt " if data[at + 8 : at + 12] == b"WAVE" else b"VP8"
    if end > len(data) or end < at + 12:
        return None

    def chunk(data: bytes, i: int) -> tuple[int, bool] | None:
        if i + 8 > end:
            return None
        after = i + 8 + struct.unpack_from("<I", data, i + 4)[0]
        after += after - at & 1
        return (after, after == end) if after <= end else None

    # the chunks before the first wanted one are few in real files: a format or extended header leads
    lead = data[at + 12 : at + 16]
    return end - at if lead.startswith(first) and c.chain(f"riff{at & 1}:{end}", at + 12, chunk) == end else None


def _png_chunk(data: bytes, i: int) -> tuple[int, bool] | None:
    if i + 12 > len(data):
        return None
    size, kind = struct.unpack_from(">I4s", data, i)
    end = i + 12 + size
    if not kind.isalpha() or end > len(data) or zlib.crc32(memoryview(data)[i + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
        return None
    return end, kind == b"IEND"


def _png(c: Content, at: int) -> int | None:
    """PNG: IHDR of 13 bytes first, every chunk with its CRC, IEND last."""
    end = c.chain("png", at + 8, _png_chunk) if c.data[at + 8 : at + 16] == b"\0\0\0\x0dIHDR" else None
    return end and end - at


def _gif_run(data: bytes, i: int) -> tuple[int, bool] | None:
    """Blocks of up to 255 bytes, an empty one last."""
    if i >= len(data):
        return None
    return i + 1 + data[i], not data[i]


def _gif(c: Content, at: int) -> int | None:
    """GIF: colour tables, extension and image blocks, then the trailer."""
    data = c.data
    if len(data) < at + 13:
        return None

    def block(data: bytes, i: int) -> tuple[int, bool] | None:
        if i >= len(data) or data[i] not in b";,!" or (data[i] == 0x2C and i + 10 > len(data)):
            return None
        if data[i] == 0x3B:
            return i + 1, True
        i += 2 if data[i] == 0x21 else 11 + (3 << (data[i + 9] & 7) + 1 if data[i + 9] & 0x80 else 0)
        end = c.chain("gif run", i, _gif_run)
        return end and (end, False)

    start = at + 13 + (3 << (data[at + 10] & 7) + 1 if data[at + 10] & 0x80 else 0)
    end = c.chain("gif", start, block)
    return end - at if end and end > start + 1 and data.find(b",", start, end) >= 0 else None


def _jpeg(c: Content, at: int) -> int | None:
    """JPEG: segments with lengths, one start of scan at least, then the end marker."""

    def segment(data: bytes, i: int) -> tuple[int, bool] | None:
        if i + 2 > len(data) or data[i] != 0xFF:
            return None
        kind = data[i + 1]
        if kind == 0xD9:
            return i + 2, True
        if kind == 0xFF:
            return i + 1, False
        size = struct.unpack_from(">H", data, i + 2)[0] if i + 4 <= len(data) else 0
        if kind == 1 or 0xD0 <= kind <= 0xD8 or size < 2:
            return None
        i += 2 + size
        return (c.after(rb"\xff[^\x00\xd0-\xd7]", i) if kind == 0xDA else i), False

    end = c.chain("jpeg", at + 2, segment)
    return end - at if end and c.after(rb"\xff\xda", at) < end else None


def _bmp(c: Content, at: int) -> int | None:
    """BMP: file size and pixel offset agree with the header, the known header sizes only."""
    if len(c.data) < at + 26:
        return None
    size, reserved, start, header = struct.unpack_from("<IIII", c.data, at + 2)
    fits = header in (12, 40, 52, 56, 64, 108, 124) and not reserved and 14 + header <= start <= size <= len(c.data) - at
    return size if fits else None


def _ogg_page(data: bytes, i: int) -> tuple[int, bool] | None:
    n = data[i + 26] if i + 27 <= len(data) else 0
    if data[i : i + 5] != b"OggS\0" or i + 27 + n > len(data):
        return None
    end = i + 27 + n + sum(data[i + 27 : i + 27 + n])
    return (end, bool(data[i + 5] & 4)) if end <= len(data) else None


def _ogg(c: Content, at: int) -> int | None:
    """Ogg: consecutive pages of which the first begins and the last ends a stream."""
    end = c.chain("ogg", at, _ogg_page) if len(c.data) > at + 5 and c.data[at + 5] & 2 else None
    return end and end - at


def _flac_block(data: bytes, i: int) -> tuple[int, bool] | None:
    if i + 4 > len(data):
        return None
    return i + 4 + int.from_bytes(data[i + 1 : i + 4], "big"), bool(data[i] >> 7)


def _flac(c: Content, at: int) -> int | None:
    """FLAC: the stream information and all metadata blocks, then a frame's sync code; it ends with the bytes."""
    end = c.chain("flac", at + 4, _flac_block) if c.data[at + 4 : at + 5] in (b"\0", b"\x80") and c.data[at + 5 : at + 8] == b"\0\0\x22" else None
    return len(c.data) - at if end and c.data[end : end + 2] in (b"\xff\xf8", b"\xff\xf9") else None


def _pdf(c: Content, at: int) -> int | None:
    """PDF: a version, a cross-reference offset, and the end mark."""
    end = c.after(b"%%EOF", at)
    if end == len(c.data) or not (c.data[at + 5 : at + 6].isdigit() and c.data[at + 6 : at + 7] == b"."):
        return None
    return end + 5 - at if c.after(b"startxref", at) < end else None


def _gzip(c: Content, at: int) -> int | None:
    """GZIP: a sound header, then the stream unpacks and its checksum and length hold."""
    data, i = c.data, at + 10
    flags = data[at + 3] if len(data) > i else 0xFF
    if flags & 0xE0:
        return None
    if flags & 4:
        i += 2 + int.from_bytes(data[i : i + 2], "little")
    for bit in (8, 16):
        i = c.after(rb"\x00", i) + 1 if flags & bit else i
    i += 2 if flags & 2 else 0
    if i >= len(data) or data[i] & 6 == 6:
        return None
    unpack, sums, size = zlib.decompressobj(-15), 0, 0
    try:
        while i < len(data) and not unpack.eof:
            rest = data[i : i + 65536]
            i += len(rest)
            while rest and not unpack.eof:
                out = unpack.decompress(rest, 1 << 20)
                sums, size, rest = zlib.crc32(out, sums), size + len(out), unpack.unconsumed_tail
    except zlib.error:
        return None
    i -= len(unpack.unused_data)
    return i + 8 - at if unpack.eof and data[i : i + 8] == struct.pack("<II", sums, size & 0xFFFFFFFF) else None


#: Magic number, its distance from the medium's start, type, validator.
FORMATS = (
    (b"WAVE", 8, "audio/wav", _riff),
    (b"WEBP", 8, "image/webp", _riff),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"BM", 0, "image/bmp", _bmp),
    (b"OggS", 0, "audio/ogg", _ogg),
    (b"fLaC", 0, "audio/flac", _flac),
    (b"%PDF-", 0, "application/pdf", _pdf),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
)


#: From the last byte of a magic number back to the medium's start.
_LEAD = [len(magic) - 1 + back for magic, back, *_ in FORMATS]


class Sniffer:
    def __init__(self) -> None:
        self.find = ahocorasick.Automaton()
        for number, (magic, *_) in enumerate(FORMATS):
            self.find.add_word(magic.decode("latin-1"), number)
        self.find.make_automaton()

    def media(self, data: bytes) -> list[tuple[int, int, str]]:
        """Start, length and type of every valid medium: the one at byte 0 and the outermost behind its start."""
        spots = [(end - _LEAD[number], number) for end, number in self.find.iter(data.decode("latin-1"))]
        found, free, content = [], 0, Content(data)
        spots.sort()
        for at, number in spots:
            if at < free:
                continue
            *_, kind, check = FORMATS[number]
            if size := check(content, at):
                found.append((at, size, kind))
                free = at + size if at else 1
        return found


def wav(payload: bytes) -> bytes:
    """Bytes as the samples of a mono 8-bit WAVE file; an even number keeps its chunks unpadded."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def wav_samples(data: bytes) -> bytes:
    """The data chunk of a WAVE file that the validator accepts."""
    i = 12
    while data[i : i + 4] != b"data":
        i += 8 + struct.unpack_from("<I", data, i + 4)[0]
        i += i & 1
    return data[i + 8 : i + 8 + struct.unpack_from("<I", data, i + 4)[0]]


_SNIFFED = "media_type string, valid boolean, media_bytes long, embedded array<struct<start:long,length:long,media_type:string>>"
_EMBEDDED = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("media_type", pa.string())]))


def _sniff(key: str, content: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for batch in batches:
            for part in slices(batch, content):
                kinds, valid, sizes, inner = [], [], [], []
                for declared, value in zip(part.column("declared_type").to_pylist(), part.column(content), strict=True):
                    data = value.as_py() or b""
                    found = sniffer.media(data)
                    own = found[0] if found and not found[0][0] else None
                    kinds.append(own[2] if own else declared)
                    valid.append(own is not None)
                    sizes.append(own[1] if own else 0)
                    inner.append([{"start": a, "length": n, "media_type": k} for a, n, k in found if a])
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), part.column("declared_type"), pa.array(kinds, pa.string()), pa.array(valid, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(inner, _EMBEDDED)],
                    names=[key, "declared_type", "media_type", "valid", "media_bytes", "embedded"],
                )

    return run


def sniff_media(media: DataFrame, key: str = "doc_id", content: str = "content", declared: str = "declared_type") -> DataFrame:
    """Key, declared type, corrected type, validity, length and embedded media of a binary column.

    Only the three named columns are read.  Null or empty content is not valid and keeps its declared
    type, as does content without a valid medium at byte 0.  Repeated rows stay.
    """
    media = media.select(F.col(key).cast("long").alias(key), F.col(declared).cast("string").alias("declared_type"), F.col(content).cast("binary").alias(content))
    return media.mapInArrow(_sniff(key, content), f"{key} long, declared_type string, {_SNIFFED}")


_STORED = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sniffer = Sniffer()
    for batch in batches:
        for part in slices(batch):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                raw = (text.as_py() or "").encode()
                stored = wav(raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT)))
                found = sniffer.media(stored)
                (_, size, kind), inner = found[0], found[1:]
                payload = wav_samples(stored[:size])
                feature = f"{kind};{size};{len(payload) / RATE:.3f}s;" + ",".join(f"{k}@{a}+{n}" for a, n, k in inner)
                rows.append((doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _STORED, strict=True)], schema=_STORED)


def store_texts(docs: DataFrame) -> DataFrame:
    """Each text as a WAVE file: digests of the file and of what is read back from it, and its sniffed features.

    ``docs`` needs doc_id and text; other columns are ignored.  A null text counts as empty; an empty
    one is stored as 64 zero bytes.  Repeated rows stay.  ``feature`` lists the sniffed type, length and duration,
    then any media embedded in the text.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _store, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op6_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents"))
