import functools
import random
import struct
import zlib

import pytest

from frames import docs
from meterlake.llm import packing
from meterlake.llm.queries import op2_packing, tokenizer_path

TEXTS = [
    "Plain words, and more of them.",
    " leading and  double  spaces\tand tabs \n new\n\nlines\r\nend ",
    "été naïve façon\nstraße über\n",
    "a<|endoftext|> b <|endoftext|>",
    "\n\nfirst\nsecond third\n\n",
    "x y  z don't we'll 123 4567 ...!?",
    "",
    None,
    "word " * 400,
    "tail space ",
    "\n",
]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def direct(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [0]


def whole(pieces, length):
    """Checks the pieces of every document and the sequences; ids by document."""
    found = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids = list(struct.unpack(f"<{p.length}I", bytes(p.ids)))
        assert p.start == len(found.setdefault(p.doc_id, []))
        found[p.doc_id] += ids
    assert all(p.doc_tokens == len(found[p.doc_id]) for p in pieces)
    at = 0
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert (p.sequence_id, p.offset) == divmod(at, length) and p.offset + p.length <= length
        at += p.length
    return found


@pytest.mark.parametrize("length", [7, 1024])
def test_pieces_hold_every_id_once(spark, length):
    rows = list(enumerate(TEXTS))
    frame = docs(spark, rows).repartition(3).selectExpr("*", "'q' as place", "1 as ids")
    pieces = packing.pack(frame, tokenizer_path(), length)
    assert whole(pieces.collect(), length) == {i: direct(t) for i, t in rows}
    total = sum(len(direct(t)) for _, t in rows)
    packed = sorted(packing.sequences(pieces).collect())
    assert [r.n_tokens for r in packed] == [length] * (total // length) + [total % length] * (total % length > 0)
    assert all(len(r.ids) == 4 * r.n_tokens for r in packed)


def test_random_texts_keep_the_ids_of_the_tokenizer():
    rng = random.Random(2)
    parts = ["the", "Été", " ", "  ", "\n", "\n\n", "\t", ".", "'s", "12", "ß", " ", "\x1c", "!!", "<|", "汉字", "\r\n", "\x85", "\xa0", "ªº²¼", "ǅɐ", "\u2028", "<|endoftext|>", "I'LL", "\0", "ÿĀ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(1500)]
    encoder = packing.Encoder(tokenizer_path(), 0)
    assert encoder.core is not None
    for t, got in zip(texts, encoder.batch(texts)):
        assert list(struct.unpack(f"<{len(got) // 2}H", got)) == direct(t), repr(t)


def test_repeated_rows_null_ids_and_no_rows(spark):
    pieces = packing.pack(docs(spark, [(1, "a b"), (1, "a b"), (None, None)]), tokenizer_path()).collect()
    assert sorted((p.doc_id or 0, p.length) for p in pieces) == [(0, 1), (1, 3), (1, 3)]
    assert packing.pack(docs(spark, []), tokenizer_path()).collect() == []
    assert packing.sequences(packing.pack(docs(spark, []), tokenizer_path())).collect() == []


def test_query_packs_the_whole_table(spark, folder):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    pieces = op2_packing(spark, folder).collect()
    at = 0
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert (p.sequence_id, p.offset) == divmod(at, 1024)
        at += p.length
        ids = direct(rows[p.doc_id])[p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
    assert at == sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    assert {p.doc_id for p in pieces} == set(rows)
