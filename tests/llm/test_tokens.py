"""Token ids: against the libraries, and files read back."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bitpack, piece
from tidemark.llm.queries import PIECE_MODEL, WORD_TOKENIZER, tokenizer_file

ODD = ["", " ", "  ", "a  b", " lead", "trail ", "tab\tx\r\n", "▁▁x", "éèü 漢字 😀́ é", "a" * 3000, " " * 77, "\n\n x", "the the" * 50, "<0x41> <s> </s><unk>", " x　y", "12345 12", "aaaaaaa bbbb abababab", "x\u0000w", " ́", "'s it's don't", "<|endoftext|>x <|startoftext|>", "İstanbul ΑΣ ſ ǅ K", "\x1c\x1d\x85 z", "Ça-và, ÀÉ!! ß×÷ x'"]


def made_up(n, seed=1):
    r = random.Random(seed)
    plain = ["".join(r.choice("abcdehlotn  .,\n▁ÀéZ'") for _ in range(r.randint(1, 60))) for _ in range(n)]
    wild = ["".join(chr(r.choice([r.randint(32, 0x2FF), r.randint(0x300, 0xD7FF), r.randint(0x1F300, 0x1F700)])) for _ in range(r.randint(1, 30))) for _ in range(n)]
    signs = ["".join(r.choice("ab éÀß  .,..!?|<>-_#$%&*()[]{}0123456789\n;:=+~^`@/\\\"") for _ in range(r.randint(1, 50))) for _ in range(n)]
    return ODD + plain + wild + signs


def corpus(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECE_MODEL))


def test_pieces_are_the_librarys(spark, sf, library):
    tool = piece.Pieces(tokenizer_file(PIECE_MODEL))
    texts = made_up(800) + [t for _, t in corpus(spark, sf)]
    for low in range(0, len(texts), 100):
        part = texts[low : low + 100]
        ours, theirs = tool.encode(part), library.encode(part, add_bos=True, add_eos=True)
        assert [x.tolist() for x in ours] == theirs
        assert [tool.model.decode(x) for x in ours] == [library.decode(x) for x in theirs]


def test_decode_of_any_ids(library):
    tool, r = piece.Pieces(tokenizer_file(PIECE_MODEL)), random.Random(2)
    for _ in range(2000):
        ids = [r.randrange(32000) if r.random() < 0.5 else r.randrange(262) for _ in range(r.randint(0, 9))]
        assert tool.model.decode(np.array(ids, dtype=int)) == library.decode(ids), ids


def test_a_full_cache_changes_nothing(monkeypatch):
    texts = made_up(100)
    want = [x.tolist() for x in piece.Pieces(tokenizer_file(PIECE_MODEL)).encode(texts)]
    monkeypatch.setattr(piece, "CACHE_WORDS", 20)
    small = piece.Pieces(tokenizer_file(PIECE_MODEL))
    assert [small.encode([t])[0].tolist() for t in texts] == want
    full = bitpack.Encoder(tokenizer_file(WORD_TOKENIZER))
    monkeypatch.setattr(bitpack, "CACHE_WORDS", 20)
    monkeypatch.setattr(bitpack, "CACHE_RUNS", 10)
    small = bitpack.Encoder(tokenizer_file(WORD_TOKENIZER))
    assert [small([t])[0].tolist() for t in texts] == [x.tolist() for x in full(texts)]


def test_op6(spark, sf, library):
    rows = [*corpus(spark, sf), (9001, None), (9002, ""), (9001, "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumnRenamed("x", "x")
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, piece.digest(df, tokenizer_file(PIECE_MODEL)).collect())) == sorted(want)
    full = piece.encode_texts(df, tokenizer_file(PIECE_MODEL)).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in full) == sorted((w[0], w[1]) for w in want)
    assert piece.digest(df.limit(0), tokenizer_file(PIECE_MODEL)).count() == 0


def test_words_are_the_librarys(spark, sf):
    tool = bitpack.Encoder(tokenizer_file(WORD_TOKENIZER))
    texts = made_up(1500) + [t for _, t in corpus(spark, sf)]
    want = [e.ids for e in tool.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tool(texts)] == want


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.data())
def test_packing_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, (1 << bits) - 1), max_size=300)), "<u4")
    packed = bitpack.pack(ids, bits)
    assert len(packed) == (len(ids) * bits + 7) // 8
    assert (bitpack.unpack(packed, len(ids), bits) == ids).all()


def test_fewest_bits():
    assert [bitpack.bits_for(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    with pytest.raises(ValueError):
        bitpack.pack(np.array([4], "<u4"), 2)


def test_file_random_access():
    r = np.random.default_rng(0)
    lengths = [0, 1, 5000, 0, 17, 9000]
    ids = r.integers(0, 30000, sum(lengths)).astype("<u4")
    f = bitpack.PackedFile(io.BytesIO(bitpack.encode_file(np.arange(6), np.array(lengths), ids, 15, block=100)))
    ends = np.cumsum(lengths)
    for i, n in enumerate(lengths):
        assert (f.doc(i) == ids[ends[i] - n : ends[i]]).all()
    assert [(d, x.tolist()) for d, x in f.documents(step=50)] == [(i, ids[ends[i] - n : ends[i]].tolist()) for i, n in enumerate(lengths)]
    assert (f.slice(4999, 5003) == ids[4999:5003]).all()


def test_op4(spark, sf):
    rows = [*corpus(spark, sf), (9001, None), (9002, ""), (-5, "x"), (3, "tie"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    tool = bitpack.Encoder(tokenizer_file(WORD_TOKENIZER))
    ids = [(d, np.append(x, 2).astype("<u4")) for (d, _), x in zip(rows, tool([t or "" for _, t in rows]), strict=True)]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].astype("<u2").tobytes()))
    want, at = [], 0
    for d, x in ids:
        want.append((d, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    got = sorted(map(tuple, bitpack.round_trip(df, tokenizer_file(WORD_TOKENIZER)).collect()), key=lambda r: r[1])
    assert got == want
    assert bitpack.round_trip(df.limit(0), tokenizer_file(WORD_TOKENIZER)).count() == 0


def test_files_of_many_parts(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one = bitpack.write_ids(df, tokenizer_file(WORD_TOKENIZER), f"file://{tmp_path}/a", 2)
    many = bitpack.write_ids(df, tokenizer_file(WORD_TOKENIZER), f"file://{tmp_path}/b", 2, file_ids=5000)
    assert many.count() > one.count()
    assert sorted(map(tuple, bitpack.read_ids(many, "file:///").collect())) == sorted(map(tuple, bitpack.read_ids(one, "file:///").collect()))


def test_long_unbroken_words():
    """Words of 10^5 characters, as the library has them and without a merge a round."""
    import random
    import string
    import time

    import sentencepiece

    path = tokenizer_file(PIECE_MODEL)
    lib, tool, r = sentencepiece.SentencePieceProcessor(model_file=path), piece.Pieces(path), random.Random(4)
    alphabets = [string.ascii_lowercase, string.ascii_letters + string.digits + "+/", "etaoinsr", "a", "=", " ", "é漢한e"]
    for letters in alphabets:
        text = "".join(r.choices(letters, k=100_000))
        began = time.perf_counter()
        got = tool.encode([text])[0].tolist()
        assert time.perf_counter() - began < 8
        assert got == lib.encode(text, add_bos=True, add_eos=True)


def test_one_by_one_is_the_rounds_result():
    path = tokenizer_file(PIECE_MODEL)
    model = piece.pieces(path).model
    for word in ["▁international", "▁aaaaabaaab", "▁The", "xqzj", "▁"]:
        sym = [int(model.symbol[ord(c)]) for c in word]
        assert model._one_by_one(sym) == model.words([word])[0].tolist()
