import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

from strandflow.llm import bpe, bpe_codec, packing, token_counts
from strandflow.llm.queries import ENGLISH, MULTI
from tests.llm.helpers import ROWS, fixture

PATH = bpe.tokenizer_file(MULTI)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_every_character_is_split_as_the_library_does(library):
    enc, text = bpe.encoder(PATH), lambda c: f"a{c}b1{c}2 {c}!{c}'s{c}"
    for c in [*range(0x3000), *range(0x3000, 0xD800, 7), *range(0xE000, 0x110000, 23)]:
        assert ids_of(enc.encode(text(chr(c)))) == library.encode_ordinary(text(chr(c))), hex(c)


def test_long_pre_tokens_merge_as_the_library_does(library):
    rnd = random.Random(5)
    for n in (1, 2, 30, 1025, 2500):
        raw = "".join(rnd.choice("thaeé") for _ in range(n)).encode()
        assert bpe.encoder(PATH).merge(raw) == library._encode_single_piece(raw)


@pytest.mark.parametrize("chunk,overlap", [(bpe_codec.CHUNK, bpe_codec.OVERLAP), (64, 16), (40, 8)])
def test_round_trip_in_chunks(spark, library, chunk, overlap):
    rows = ROWS if chunk > 1000 else [(i, (t or "")[:900], a, b) for i, t, a, b in ROWS] + [(50, "a  \n" * 90 + "'ll" * 50, "en", "a")]
    encoded = bpe_codec.encode_documents(fixture(spark, rows), PATH, chunk, overlap, (bpe_codec.LOCAL, 256) if chunk > 1000 else (24, 8))
    got = sorted(((r.doc_id, bytes(r.ids), bytes(r.data)) for r in bpe_codec.decode_documents(encoded, PATH).collect()), key=repr)
    want = sorted(((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in rows), key=repr)
    assert got == want


def test_ids_without_bytes(spark, tmp_path):
    ranks = tmp_path / "gap.tiktoken"
    ranks.write_text("YQ== 0\nYg== 2\n")
    rows = spark.createDataFrame([(1, bytearray(np.array([0, 1, 2], "<u4").tobytes())), (2, None)], "doc_id long, ids binary")
    assert {r.doc_id: bytes(r.data) for r in bpe_codec.decode_documents(rows, str(ranks)).collect()} == {1: b"ab", 2: b""}
    beyond = spark.createDataFrame([(1, bytearray(np.array([3], "<u4").tobytes()))], "doc_id long, ids binary")
    with pytest.raises(Exception, match="IndexError"):
        bpe_codec.decode_documents(beyond, str(ranks)).collect()


def test_texts_in_local_chunks(library):
    rnd, enc = random.Random(6), bpe.encoder(PATH)
    parts = ["the", " ", "   ", "'ll", "'s", "1", "é", "\n", "!", " word", "漢字", "x" * 30, "\r\n\n"]
    for i in range(400):
        text = "".join(rnd.choice(parts) for _ in range(rnd.choice((0, 9, 40, 300))))
        for chunk, overlap in ((16, 8), (40, 10), (64, 64)):
            assert ids_of(bpe_codec.encode_chunks(text, enc, chunk, overlap)) == library.encode_ordinary(text), (i, chunk)
    for n in range(2040, 2320):
        text = ("some words, " * 400)[:n]
        assert ids_of(bpe_codec.encode_chunks(text, enc)) == library.encode_ordinary(text)


def test_edits_by_counting_anew(library):
    rnd, enc = random.Random(11), bpe.encoder(PATH)
    alphabet = ["the", " ", "  ", "'", "s", "ll", "1", "é", "\n", "!", "word", " word", "漢"]
    for _ in range(400):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.choice((0, 1, 5, 60, 900))))
        edits, at = [], 0
        while at <= len(text) and rnd.random() < 0.8:
            start = rnd.randint(at, len(text))
            stop = min(len(text), start + rnd.choice((0, 1, 3, 40)))
            edits.append((start, stop, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 4)))))
            at = stop + rnd.choice((0, 1, 2, 30))
        tree = token_counts.CountTree(text, enc)
        assert tree.total == len(library.encode_ordinary(text))
        tree.edit(edits)
        for s, e, put in reversed(edits):
            text = text[:s] + put + text[e:]
        assert tree.text == text and tree.total == len(library.encode_ordinary(text)), edits
        assert all((tree.sums[i] == tree.sums[2 * i] + tree.sums[2 * i + 1]).all() for i in range(1, tree.width))


def test_edits_touch_little(spark, library):
    text = "plain words stand here and there. " * 3000
    tree = token_counts.CountTree(text, bpe.encoder(PATH))
    assert 0 < tree.edit([(50_000, 50_004, "other")]) < 100
    out = token_counts.count_after_edits(fixture(spark), PATH).collect()
    assert len(out) == len(ROWS)
    for r in out:
        assert r.n_tokens_after == len(library.encode_ordinary(r.text))
    assert next(r for r in out if r.doc_id == 14).n_edits == 3


def test_given_edits(spark, library):
    d = spark.createDataFrame([(1, "hello world", [(0, 5, "goodbye")]), (2, None, None)], "doc_id long, text string, edits array<struct<start:int,stop:int,put:string>>")
    out = {r.doc_id: r for r in token_counts.count_after_edits(d, PATH, None).collect()}
    assert out[1].text == "goodbye world" and out[1].n_tokens_after == len(library.encode_ordinary("goodbye world")) and out[2].n_tokens_after == 0


def test_packing(spark, sf):
    tok = Tokenizer.from_file(bpe.tokenizer_file("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    ranks = bpe.tokenizer_file(ENGLISH)
    real = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [r for r in [*ROWS, *[(1000 + i, *x) for i, *x in real]] if r[0] != 5]
    cut = packing.pieces(fixture(spark, rows), ranks, with_ids=True)
    out = packing.pack(cut).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        parts = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and [x for r in parts for x in ids_of(r.ids)] == ids
        assert all(r.length == 1024 for r in parts[1:]) and all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in parts)
        assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    total = sum(r.length for r in out)
    assert len(bins) <= 1.03 * -(-total // 1024)
    whole = packing.sequences(packing.pack(cut)).collect()
    assert sum(len(r.ids) for r in whole) == 4 * total
    assert packing.pack(packing.pieces(fixture(spark).limit(0), ranks)).count() == 0


def test_best_fit_closes_the_fullest():
    b = packing.BestFit(capacity=10, open_bins=2)
    assert [b.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # bin 1 (free 3) closes for bin 2
    assert b.place(3) == (0, 6) and b.place(2) == (2, 8)
    assert sha256(b"").hexdigest()
