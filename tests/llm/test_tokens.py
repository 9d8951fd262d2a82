import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keystrata.llm import bitpack, token_counts

MODEL, VOCABULARY = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "a \n b", "▁", "a▁ b", "a ▁b", "<s> </s> <0x0A>", "x <|endoftext|> y", "a  <|endoftext|>  b", "don't you'll", "é ü 中文 字", "\x00 \x1c a", "a b   c", "a  b", "tab\t x", "1234 5 67", "!! ?? ...", "a" * 3000, "word " * 500]


def direct_pieces(texts):
    import sentencepiece

    return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(texts)]


def direct_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(VOCABULARY).encode_batch(texts, add_special_tokens=False)]


def test_pieces_equal_the_library_on_odd_texts():
    assert token_counts.counter(MODEL).count(ODD) == direct_pieces(ODD)


def test_tokens_of_vocabulary_files_equal_the_library():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(public_tokenizers.path(name))
        assert token_counts.counter(public_tokenizers.path(name)).count(ODD) == [len(model.encode(x, add_special_tokens=False).ids) for x in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab .,'\n\t é▁<|>1 　")), max_size=40), max_size=8))
def test_cutting_is_exact(texts):
    assert token_counts.counter(MODEL).count(texts) == direct_pieces(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in bitpack.encoder(VOCABULARY).encode(texts)] == direct_ids(texts)


def test_ids_equal_the_library_on_odd_texts():
    assert [np.frombuffer(x, "<u4").tolist() for x in bitpack.encoder(VOCABULARY).encode(ODD)] == direct_ids(ODD)


def test_counts_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in token_counts.token_counts(docs, MODEL).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r, n in zip(rows, direct_pieces([r.text for r in rows]), strict=True):
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len(r.text.encode()), n > 4096)


def test_counts_of_odd_rows(odd_docs, no_docs):
    rows = token_counts.token_counts(odd_docs, MODEL).collect()
    assert len(rows) == 8 and {(r.doc_id, r.n_tokens) for r in rows} >= {(2, 0), (3, 0)}
    assert token_counts.token_counts(no_docs, MODEL).collect() == []


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=200), st.data())
def test_packing_round_trip(width, values, data):
    ids = np.array([v & ((1 << width) - 1) for v in values], np.uint32)
    packed = bitpack.pack(ids, width)
    assert len(packed) == -(-len(ids) * width // 8)
    start = data.draw(st.integers(0, len(ids)))
    count = data.draw(st.integers(0, len(ids) - start))
    assert bitpack.unpack(packed, width, start, count).tolist() == ids[start : start + count].tolist()


def test_width():
    assert [bitpack.width_of(n) for n in (1, 2, 3, 4, 5, 32_000, 50_257, 65_536, 65_537)] == [1, 1, 2, 2, 3, 15, 16, 16, 17]
    with pytest.raises(ValueError):
        bitpack.pack(np.array([4]), 2)


def test_files_hold_the_ids(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    path = bitpack.write_packed(docs, str(tmp_path / "packed"), VOCABULARY)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    ids = [[*x, 2] for x in direct_ids([r.text for r in rows])]
    got = sorted(bitpack.packed_documents(spark, path).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, row, x in zip(got, rows, ids, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row.doc_id, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += len(x)
    flat = [i for x in ids for i in x]
    for at, n in ((0, 5), (1234, 77), (start - 3, 3), (start // 2, 5000)):
        assert bitpack.read_span(spark, path, at, n).tolist() == flat[at : at + n]


def test_packed_odd_rows(odd_docs, no_docs):
    rows = bitpack.packed_digest(odd_docs, VOCABULARY).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [1, 2, 3, 4, 5, 5, 6, None]
    ids = [[*x, 2] for x in direct_ids([r.text or "" for r in sorted(odd_docs.collect(), key=lambda r: r.doc_id or 99)])]
    assert [r.ids_crc32 for r in rows] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    assert [r.start for r in rows] == [0, *np.cumsum([len(x) for x in ids])[:-1]]
    assert [r.n_tokens for r in rows][1:3] == [1, 1]
    assert bitpack.packed_digest(no_docs, VOCABULARY).collect() == []


def test_a_chunk_is_kept_once(monkeypatch):
    """Chunks are numbered when first met, ids kept once for each, and forgetting them changes nothing."""
    texts, e = ["some words, some more words", "more words again: some\n", "none", ""], bitpack.Encoder(VOCABULARY)
    want = direct_ids(texts)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == want
    kinds = {" " + c for t in texts for c in t.split(" ")[1:]}
    assert len(e.known) == len(e.ends) - 1 == len(kinds) and len(e.flat) == sum(map(len, direct_ids(sorted(kinds))))
    monkeypatch.setattr(bitpack, "REMEMBERED", 2)
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts[1:])] == want[1:] and len(e.known) < len(kinds)
