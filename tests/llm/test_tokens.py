import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm import dac_codes, sentencepiece_codec as sp
from docweave.llm.queries import tokenizer_file

ODD = ["", " ", "  a", "a  b   c ", "x\n\n y", "日本語 🎉 \x00", "<s> </s> <0x41>", "é́ü ß", "\t x\r\n", "a" * 3000, "€ a €b", "<|ENDOFTEXT|> <|endoftext|>. x", "it's 'S ÀÉ.\xa0x, İ. ﬁ."]


@pytest.fixture(scope="module")
def codec():
    return sp.Codec(tokenizer_file("piece_bpe_32k.model"))


def test_ids_equal_the_librarys(codec):
    for x, mine, other in zip(ODD, codec.encode(ODD), codec.reference(ODD), strict=True):
        assert mine.tolist() == other, repr(x)
        assert codec.decode(mine) == x.encode()
    assert not codec.unequal


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab é\n .,▁日"), max_size=40), max_size=5))
def test_any_text_is_at_parity(texts):
    codec = sp.codec_of(tokenizer_file("piece_bpe_32k.model"))
    assert [x.tolist() for x in codec.encode(texts)] == codec.reference(texts)


def _message(number, kind, value):
    head = bytes([number << 3 | kind])
    return head + (bytes([len(value)]) + value if kind == 2 else value)


def test_unigram_model_with_scores_and_bytes(tmp_path):
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256)), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -3.5, 1), ("▁ab", -4.0, 1), ("▁a", -4.0, 1), ("ba", -5.0, 1)]
    raw = b"".join(_message(1, 2, _message(1, 2, p.encode()) + _message(2, 5, struct.pack("<f", s)) + _message(3, 0, bytes([k]))) for p, s, k in pieces)
    trainer = _message(3, 0, b"\x01") + bytes([35 << 3 & 0x7F | 0x80, 35 << 3 >> 7]) + b"\x01" + bytes([40 << 3 & 0x7F | 0x80, 40 << 3 >> 7]) + b"\x00"
    raw += _message(2, 2, trainer) + _message(3, 2, _message(1, 2, b"identity") + _message(3, 0, b"\x01") + _message(4, 0, b"\x00"))
    path = tmp_path / "u.model"
    path.write_bytes(raw)
    model = sentencepiece.SentencePieceProcessor(model_file=str(path))
    mine = sp.Codec(str(path))
    assert mine.model.kind == sp.UNIGRAM
    texts = ["ab", "abab ba", "a b  ab", "", "abc é"]
    assert [x.tolist() for x in mine.encode(texts)] == model.encode(texts)


def test_documents_with_nulls_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "ab cd", 5), (None, None, 6), (1, "ab cd", 5), (2, "", 7)], "doc_id long, text string, ids int")
    rows = sp.encode_documents(docs, tokenizer_file("piece_bpe_32k.model")).collect()
    assert sorted(r.in_ids for r in rows) == [5, 5, 6, 7]
    assert sorted((r.doc_id or -1, r.n_tokens) for r in rows) == [(-1, 0), (1, 2), (1, 2), (2, 0)] or len(rows) == 4
    assert all(r.parity and r.round_trip for r in rows)
    back = sp.decode_ids(sp.encode_documents(docs, tokenizer_file("piece_bpe_32k.model"), keep=["doc_id"]), tokenizer_file("piece_bpe_32k.model")).collect()
    assert sorted(r.decoded for r in back) == ["", "", "ab cd", "ab cd"]
    assert sp.encode_documents(docs.limit(0), tokenizer_file("piece_bpe_32k.model"), keep=["doc_id"]).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=1500))
def test_codes_give_any_id(ids):
    a = np.array(ids, np.uint32)
    seg = dac_codes.Segment(dac_codes.encode_ids(np.array([7]), np.array([len(a)]), a))
    assert seg.decode().tolist() == ids
    assert [seg[i] for i in range(0, len(ids), 13)] == ids[::13]
    with pytest.raises(IndexError):
        seg[len(ids)]


def test_words_are_encoded_as_whole_texts_are():
    enc = dac_codes.encoder_of(tokenizer_file("word_bpe_49k.json"))
    for x, raw in zip(ODD, enc.encode(ODD), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == enc.tokenizer.encode(x, add_special_tokens=False).ids, repr(x)


def test_segments_read_back(spark):
    import zlib

    texts = {3: "b c", 1: "a, a", 2: None, 9: "", 5: "x" * 500}
    docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()] + [(1, "a, a", 1)], "doc_id long, text string, start int")
    for size in (1_000_000, 3):
        got = dac_codes.read_documents(dac_codes.write_segments(docs, tokenizer_file("word_bpe_49k.json"), segment_ids=size)).orderBy("start").collect()
        assert [r.doc_id for r in got] == [1, 1, 2, 3, 5, 9]
        enc, at = dac_codes.encoder_of(tokenizer_file("word_bpe_49k.json")).tokenizer, 0
        for r in got:
            ids = np.array([*enc.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
            at += len(ids)
    assert dac_codes.read_documents(dac_codes.write_segments(docs.limit(0), tokenizer_file("word_bpe_49k.json"))).count() == 0


def test_words_go_to_the_tokenizer_where_the_merges_alone_differ(tmp_path):
    """A file that doesn't lower-case: its words keep their capitals, so none may take the short way."""
    import json

    with open(tokenizer_file("word_bpe_49k.json")) as f:
        spec = json.load(f)
    spec["normalizer"] = None
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    enc = dac_codes.WordEncoder(str(path))
    assert not enc.direct and dac_codes.encoder_of(tokenizer_file("word_bpe_49k.json")).direct
    texts = ["Some words, And More. ÉTÉ", "plain ones"]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [enc.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_very_long_text_and_many_segments(spark):
    rows = [(i, f"word{i % 7} " * (i % 50)) for i in range(400)] + [(1000, "many words in one text " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = dac_codes.read_documents(dac_codes.write_segments(docs, tokenizer_file("word_bpe_49k.json"), partitions=5, segment_ids=500)).orderBy("doc_id").collect()
    enc, at = dac_codes.encoder_of(tokenizer_file("word_bpe_49k.json")).tokenizer, 0
    for r, (i, x) in zip(got, sorted(rows), strict=True):
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(enc.encode(x, add_special_tokens=False).ids) + 1)
        at += r.n_tokens
