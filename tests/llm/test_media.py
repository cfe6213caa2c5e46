import gzip
import hashlib
import struct
import zlib

from frames import docs
from meterlake.llm import media
from meterlake.llm.queries import op5_media


def png():
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = zlib.compress(b"\0\x11\0\x22")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", rows) + chunk(b"IEND", b"")


def bmp():
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0"


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"!\xf9\4\0\0\0\0\0" + b",\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
JPEG = b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\3\1data\xff\0more\xff\xd0end\xff\xd9"
MIDI = b"MThd\0\0\0\6\0\0\0\1\0`MTrk\0\0\0\4\0\xff/\0"
PDF = b"%PDF-1.4\nsome objects\n%%EOF"
SAMPLES = {
    "audio/wav": media.wav(b"abc"),
    "image/png": png(),
    "image/jpeg": JPEG,
    "image/gif": GIF,
    "image/bmp": bmp(),
    "audio/midi": MIDI,
    "application/gzip": gzip.compress(b"text " * 50),
    "application/pdf": PDF,
}
COLUMNS = "k long, said string, b binary, body string"


def test_types_lengths_and_corrections(spark):
    rows = [(i, "text/plain" if i % 2 else kind, bytearray(b), "clash") for i, (kind, b) in enumerate(SAMPLES.items())]
    found = {r.k: r for r in media.sniff(spark.createDataFrame(rows, COLUMNS), "k", "said", "b").collect()}
    for i, (kind, b) in enumerate(SAMPLES.items()):
        assert (found[i].sniffed, found[i].length, found[i].corrected) == (kind, len(b), bool(i % 2)), kind


def test_damaged_values_are_not_confirmed():
    located = media.automaton()
    for kind, b in SAMPLES.items():
        assert media.media_in(b, located)[0] == (kind, 0, len(b))
        assert not [f for f in media.media_in(b[:-1], located) if f[1] == 0], kind
    assert media.media_in(b"RIFF BM GIF89a %PDF-x MThd and words" * 50, located) == []
    broken = bytearray(png())
    broken[30] ^= 1
    assert media.media_in(bytes(broken), located) == []


def test_embedded_media_are_carved_whole(spark):
    body = b"noise BM" + b"".join(b + b"--" for b in SAMPLES.values() if b is not PDF)
    sniffed = media.sniff(spark.createDataFrame([(1, None, bytearray(body), None)], COLUMNS), "k", "said", "b")
    carved = [(r.type, bytes(r.media)) for r in media.carve(sniffed, "k", "b").orderBy("offset").collect()]
    assert carved == [(k, b) for k, b in SAMPLES.items() if b is not PDF]


def test_nulls_empty_values_and_tables(spark):
    rows = [(None, None, None, None), (1, "x", bytearray(b""), None), (1, "x", bytearray(b""), None)]
    found = media.sniff(spark.createDataFrame(rows, COLUMNS), "k", "said", "b").collect()
    assert [(r.sniffed, r.length, r.corrected, r.embedded) for r in found] == [(None, None, False, [])] * 3
    assert media.sniff(spark.createDataFrame([], COLUMNS), "k", "said", "b").collect() == []
    assert media.store_texts(docs(spark, [])).collect() == []


def test_payloads_come_back_whole(spark, folder):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op5_media(spark, folder).collect()
    assert len(rows) == len(texts)
    same = {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        stored = media.wav(payload)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(stored))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(stored).hexdigest()
        assert (r.sniffed, r.length, r.corrected, r.n_embedded) == ("audio/wav", len(stored), True, 0)
        assert r.feature.startswith("type=audio/wav;") and same.setdefault(raw, r.feature) == r.feature


def test_empty_texts_are_stored(spark):
    rows = media.store_texts(docs(spark, [(1, None), (2, ""), (3, "x" * 64)])).collect()
    assert [(r.n_bytes, len(r.body)) for r in rows] == [(0, 108), (0, 108), (64, 108)]
