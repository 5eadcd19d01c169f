"""BPE against the tokenizers library and round trips."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm.bpe import LONG_PIECE, Codec, digests, encode_decode, op2_bpe, read_vocabulary, tokenizer_file

SPECIAL = ["<|endoftext|>", "<|startoftext|>", "'s", "'ll", "’t", "İ", "Σ", "ß", "é", "\x1c", "\x85", "\xa0", "中", "😀", "Ⅷ"]


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file()), Codec(read_vocabulary(tokenizer_file()))


def agree(both, text):
    library, codec = both
    want = library.encode(text, add_special_tokens=False).ids
    ids, decoded = codec.roundtrip(text)
    assert np.frombuffer(ids, np.int32).tolist() == want
    assert decoded == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=6), st.sampled_from(SPECIAL)), max_size=12).map("".join))
def test_any_text_encodes_as_the_library_does(both, text):
    agree(both, text)


@pytest.mark.parametrize("text", ["", " ", "a", "thein" * LONG_PIECE, "ab" * 3000, "é" * 5000, "!" * 2000, "x<|endoftext|>y"])
def test_long_and_odd_texts(both, text):
    agree(both, text)


def test_every_code_point(both):
    library, codec = both
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 5000):
        text = " ".join(f":{chr(c)}a{chr(c)}1{chr(c)}" for c in points[start : start + 5000])
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codec.roundtrip(text)[0], np.int32).tolist() == want, hex(points[start])


def test_every_pair_of_a_letter_and_a_mark(both):
    letters, marks = [*range(0x41, 0x5B), *range(0xC0, 0x180), *range(0x370, 0x400)], [*range(0x300, 0x370), 0x1E2EC]
    agree(both, " ".join(f"{chr(c)}{chr(m)}b" for c in letters for m in marks))


def test_query_and_cases(spark, data, both):
    rows = {r["doc_id"]: r for r in op2_bpe(spark, data).collect()}
    texts = dict(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    assert set(rows) == set(texts)
    for k, t in texts.items():
        ids = both[0].encode(t, add_special_tokens=False).ids
        assert rows[k]["n_tokens"] == len(ids) and rows[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[k]["decoded_sha256"] == hashlib.sha256(both[0].decode(ids, skip_special_tokens=False).encode()).hexdigest()
    odd = spark.createDataFrame([(1, None, "own"), (1, "", None), (None, "some words", "x")], "doc_id long, text string, token_ids string")
    out = digests(encode_decode(odd, tokenizer_file())).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r["n_tokens"], r["ids_sha256"] == empty, r["decoded_sha256"] == empty) for r in out) == [(0, True, True), (0, True, True), (2, False, False)]
    assert digests(encode_decode(odd.limit(0), tokenizer_file())).count() == 0
