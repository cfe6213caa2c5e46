"""Media columns: signature sniffing of binary values.

An Aho-Corasick automaton locates the magic bytes of all formats in one pass over a value. A validator per format then
confirms structure and length from the place of each hit, which rejects magic bytes that only look like media. A hit at
the start corrects the declared type; others are embedded media and can be carved out.

Defined results: a null value has no type, no length and nothing embedded; an empty value likewise; a value whose
structure no validator confirms keeps a null sniffed type. Repeated rows are sniffed one by one; empty tables give no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import picked

# Magic bytes of the formats.
MAGIC = {
    "audio/wav": b"RIFF",
    "image/png": b"\x89PNG\r\n\x1a\n",
    "image/jpeg": b"\xff\xd8\xff",
    "image/gif": b"GIF8",
    "image/bmp": b"BM",
    "audio/midi": b"MThd",
    "application/gzip": b"\x1f\x8b\x08",
    "application/pdf": b"%PDF-",
}
PDF_END = b"%%EOF"
RATE = 8000  # samples a second of stored payloads
Found = tuple[str, int, int]  # type, offset, length


def wav_length(b: bytes, at: int, _ends: list[int]) -> int:
    """Chunks must fill the length that the header states, with a format before the data."""
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end, place, form = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, False
    if end > len(b):
        return 0
    while place + 8 <= end:
        kind, size = struct.unpack_from("<4sI", b, place)
        if place + 8 + size > end:
            return 0
        if kind == b"fmt ":
            if size < 16:
                return 0
            form = True
        elif kind == b"data":
            return end - at if form else 0
        place += 8 + size + size % 2
    return 0


def png_length(b: bytes, at: int, _ends: list[int]) -> int:
    """Chunks with right checksums from the header chunk to the end chunk."""
    place = at + 8
    while place + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, place)
        end = place + 12 + size
        if end > len(b) or (place == at + 8) != (kind == b"IHDR"):
            return 0
        if zlib.crc32(memoryview(b)[place + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return 0
        if kind == b"IEND":
            return end - at
        place = end
    return 0


def jpeg_length(b: bytes, at: int, _ends: list[int]) -> int:
    """Marker segments up to the scan, then entropy-coded bytes up to the end marker."""
    place = at + 2
    while place + 2 <= len(b) and b[place] == 0xFF:
        marker = b[place + 1]
        if marker == 0xD9:
            return place + 2 - at
        if place + 4 > len(b):
            return 0
        size = struct.unpack_from(">H", b, place + 2)[0]
        if size < 2:
            return 0
        place += 2 + size
        if marker == 0xDA:
            while (place := b.find(b"\xff", place)) >= 0 and place + 1 < len(b) and (b[place + 1] == 0 or 0xD0 <= b[place + 1] <= 0xD7):
                place += 2
            if place < 0:
                return 0
    return 0


def _gif_blocks(b: bytes, place: int) -> int:
    while place < len(b) and b[place]:
        place += 1 + b[place]
    return place + 1 if place < len(b) else -1


def gif_length(b: bytes, at: int, _ends: list[int]) -> int:
    """Header, colour tables, extension and image blocks up to the trailer."""
    if b[at + 4 : at + 6] not in (b"7a", b"9a") or len(b) < at + 13:
        return 0
    flags, place = b[at + 10], at + 13
    place += 3 * (2 << (flags & 7)) if flags & 0x80 else 0
    while 0 <= place < len(b):
        if b[place] == 0x3B:
            return place + 1 - at
        if b[place] == 0x21:
            place = _gif_blocks(b, place + 2)
        elif b[place] == 0x2C and place + 10 < len(b):
            flags = b[place + 9]
            place = _gif_blocks(b, place + 11 + (3 * (2 << (flags & 7)) if flags & 0x80 else 0))
        else:
            return 0
    return 0


def bmp_length(b: bytes, at: int, _ends: list[int]) -> int:
    """Stated size, reserved zeros, a known header size and one plane."""
    if len(b) < at + 30:
        return 0
    size, reserved, start, header = struct.unpack_from("<IIII", b, at + 2)
    planes = struct.unpack_from("<H", b, at + 26)[0]
    good = not reserved and header in (40, 52, 56, 108, 124) and planes == 1 and 14 + header <= start <= size <= len(b) - at
    return size if good else 0


def midi_length(b: bytes, at: int, _ends: list[int]) -> int:
    """A header chunk of six bytes and as many track chunks as it states."""
    if len(b) < at + 14 or struct.unpack_from(">I", b, at + 4)[0] != 6:
        return 0
    tracks, place = struct.unpack_from(">H", b, at + 10)[0], at + 14
    for _ in range(tracks):
        if b[place : place + 4] != b"MTrk" or place + 8 > len(b):
            return 0
        place += 8 + struct.unpack_from(">I", b, place + 4)[0]
    return place - at if tracks and place <= len(b) else 0


def gzip_length(b: bytes, at: int, _ends: list[int]) -> int:
    """A member that unpacks with the right checksum."""
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return 0
    stream, place = zlib.decompressobj(31), at
    try:
        while not stream.eof and place < len(b):
            stream.decompress(b[place : place + 65536])
            place += 65536
    except zlib.error:
        return 0
    return min(place, len(b)) - len(stream.unused_data) - at if stream.eof else 0


def pdf_length(b: bytes, at: int, ends: list[int]) -> int:
    """A version after the magic bytes, and the last end mark of the value."""
    if not b[at + 5 : at + 8].replace(b".", b"", 1).isdigit() or not ends or ends[-1] < at + 8:
        return 0
    return ends[-1] + len(PDF_END) - at


VALIDATORS: dict[str, Callable[[bytes, int, list[int]], int]] = {
    "audio/wav": wav_length,
    "image/png": png_length,
    "image/jpeg": jpeg_length,
    "image/gif": gif_length,
    "image/bmp": bmp_length,
    "audio/midi": midi_length,
    "application/gzip": gzip_length,
    "application/pdf": pdf_length,
}


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, magic in [*MAGIC.items(), ("", PDF_END)]:
        found.add_word(magic.decode("latin-1"), (kind, len(magic)))
    found.make_automaton()
    return found


def media_in(body: bytes, located) -> list[Found]:
    """Confirmed media in order of their offsets; media inside others of the list follow them."""
    hits, ends = [], []
    for last, (kind, size) in located.iter(body.decode("latin-1")):
        (hits if kind else ends).append((kind, last + 1 - size) if kind else last + 1 - size)
    found = ((kind, at, VALIDATORS[kind](body, at, ends)) for kind, at in sorted(hits, key=lambda h: h[1]))
    return [f for f in found if f[2]]


ITEM = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
SNIFFED_COLUMNS = ("sniffed", "length", "corrected", "embedded")
SNIFFED = "sniffed string, length long, corrected boolean, embedded array<struct<type:string,offset:long,length:long>>"


def _sniff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    located = automaton()
    for batch in batches:
        sniffed, lengths, corrected, embedded = [], [], [], []
        for declared, body in zip(batch.column("declared").to_pylist(), batch.column("body").to_pylist()):
            found = media_in(body, located) if body else []
            own = found[0] if found and found[0][1] == 0 else None
            sniffed.append(own and own[0])
            lengths.append(own and own[2])
            corrected.append(own is not None and own[0] != declared)
            embedded.append([{"type": k, "offset": at, "length": n} for k, at, n in found if (k, at, n) != own])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                batch.column("body"),
                pa.array(sniffed, pa.string()),
                pa.array(lengths, pa.int64()),
                pa.array(corrected, pa.bool_()),
                pa.array(embedded, ITEM),
            ],
            names=["id", "body", "sniffed", "length", "corrected", "embedded"],
        )


def sniff(media: DataFrame, id: str, declared: str, body: str) -> DataFrame:
    """`id`, `body`, sniffed type, its confirmed length, whether the declared type differs, embedded media."""
    rows = picked(media, id=id, declared=declared, body=body)
    out = rows.mapInArrow(_sniff, f"id {rows.schema['id'].dataType.simpleString()}, body binary, {SNIFFED}")
    return out.select(F.col("id").alias(id), F.col("body").alias(body), "sniffed", "length", "corrected", "embedded")


def carve(sniffed: DataFrame, id: str, body: str) -> DataFrame:
    """One row per embedded medium: `id`, type, offset, length, its bytes."""
    rows = sniffed.select(F.col(id), F.col(body).alias("_body"), F.explode("embedded").alias("_found"))
    cut = F.expr("substring(_body, cast(_found.offset + 1 as int), cast(_found.length as int))")
    return rows.select(id, "_found.type", "_found.offset", "_found.length", cut.alias("media"))


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """One channel of unsigned 8-bit samples."""
    pad = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def samples(body: bytes, length: int) -> tuple[int, int, int, memoryview]:
    """Channels, rate, bits and sample bytes of a confirmed WAV value."""
    place, form = 12, (0, 0, 0)
    while place + 8 <= length:
        kind, size = struct.unpack_from("<4sI", body, place)
        if kind == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body, place + 8)
            form = channels, rate, bits
        elif kind == b"data":
            return *form, memoryview(body)[place + 8 : place + 8 + size]
        place += 8 + size + size % 2
    raise ValueError("no data chunk")


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
        bodies = [wav(b + b"\0" * (-len(b) % 64 if b else 64)) for b in raw]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([len(b) for b in raw], pa.int64()), pa.array(bodies, pa.binary())],
            names=["id", "n_bytes", "body"],
        )


def store_texts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's bytes, filled with zeros to a positive multiple of 64, as a WAV value: `id`, n_bytes, body.
    A null text counts as empty."""
    rows = picked(docs, id=id, text=text)
    out = rows.mapInArrow(_store, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, body binary")
    return out.withColumnRenamed("id", id)


def described(kind: str | None, body: bytes, length: int, embedded: int) -> tuple[bytes, str]:
    """The payload read back, and its features: type, form, number of embedded media, and peak, mean and root mean square
    of the samples around their middle, and zero crossings."""
    if kind != "audio/wav":
        return b"", f"type={kind or 'unknown'}"
    channels, rate, bits, data = samples(body, length)
    wave = np.frombuffer(data, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((wave[1:] < 0) != (wave[:-1] < 0)))
    n = max(1, len(wave))
    peak = int(np.abs(wave).max(initial=0))
    mean, power = round(int(wave.sum()) / n, 6), round((int((wave * wave).sum()) / n) ** 0.5, 6)
    parts = {"type": kind, "channels": channels, "rate": rate, "bits": bits, "samples": len(wave), "peak": peak, "mean": mean, "rms": power, "crossings": crossings, "embedded": embedded}
    return bytes(data), ";".join(f"{k}={v}" for k, v in parts.items())


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        columns = [batch.column(c).to_pylist() for c in ("sniffed", "body", "length", "embedded")]
        for kind, body, length, embedded in zip(*columns):
            body = body or b""
            payload, feature = described(kind, body, length or 0, len(embedded or ()))
            values = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(body), hashlib.sha256(body).hexdigest(), feature
            for c, v in zip(out, values):
                out[c].append(v)
        kept = [batch.column(c) for c in SNIFFED_COLUMNS]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *kept, *map(pa.array, out.values())], names=["id", *SNIFFED_COLUMNS, *out])


def read_back(sniffed: DataFrame, id: str, body: str) -> DataFrame:
    """Digests and features of sniffed values, from the stored bytes alone, beside what `sniff` found."""
    rows = sniffed.select(F.col(id).alias("id"), F.col(body).alias("body"), *SNIFFED_COLUMNS)
    out = rows.mapInArrow(
        _read_back,
        f"id {rows.schema['id'].dataType.simpleString()}, {SNIFFED}, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string",
    )
    return out.withColumnRenamed("id", id)
