import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_paths import DATA
from tokenizers import Tokenizer

from chronoframe.llm import token_count
from chronoframe.llm.queries import op11_token_counts

ODD = ["", " ", "\n", "a", "it's 'SAT' we'll CAN'T", "x́ é̀ ́", "ΣΑΣ ΟΔΟΣ σς", "İstanbul ŞİŞLİ", "한글 한",
       "<|endoftext|>", "a<|startoftext|>b <|ENDoftext|>", "1234567 12e5 ½ Ⅷ ٣٤", "a\tb\r\nc\x0bd\x0ce\x1cf\x85g\xa0h i　j",
       "漢字かな交じり文", "क्षि বাংলা কো", "👩‍👩‍👧 🏳️‍🌈", "</w> w</w>x", "ﬁ ﬃ Å Å", "!!!???...--- '' ''s", "\x00\x01 ﻿ �", "'S 'T'Re", "ÀÉÎõü ẞ ß",
       "q" * 3000, "-" * 5000 + "a" * 100, "ab " * 4000, "İ̇", "नि़", "a‍b", "𝔘𝔫𝔦 𐐀𐐁"]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def own():
    return token_count.Counter(None, token_count.whole_tokens())


def count(plain, text):
    return len(plain.encode(text or "", add_special_tokens=False).ids)


def test_whole_tokens_are_proved(plain):
    whole = token_count.whole_tokens()
    assert len(whole) > 20_000
    assert all(count(plain, s) == 1 for s in list(whole)[::37])


def test_odd_texts(plain, own):
    assert own.count(ODD) == [count(plain, t) for t in ODD]
    assert own.count(ODD) == [count(plain, t) for t in ODD]            # from the cache


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(ODD[:24]), st.sampled_from(["the", "The", "'s", "don't", "!"])), max_size=8),
       st.sampled_from([" ", "", "\n", "  "]))
def test_any_text(plain, own, parts, gap):
    text = gap.join(parts)
    assert own.count([text]) == [count(plain, text)]


def test_small_cache(plain, documents, monkeypatch):
    monkeypatch.setattr(token_count, "CACHE_UNITS", 50)
    small = token_count.Counter(None, token_count.whole_tokens())
    texts = [r.text or "" for r in documents.limit(40).collect()]
    for t in texts:
        assert small.count([t]) == [count(plain, t)]


def test_query_against_the_library(spark, plain):
    out = op11_token_counts(spark, DATA)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    got = sorted(tuple(r) for r in out.collect())
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), n := count(plain, r.text), n > 2048) for r in docs)
    assert got == want and any(r[3] for r in got)


def test_messy_and_empty(messy, nothing, plain):
    got = token_count.count_tokens(messy, limit=3).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(
        ((r.doc_id, count(plain, r.text)) for r in messy.collect()), key=str)
    assert token_count.count_tokens(nothing, limit=3).collect() == []
    with pytest.raises(ValueError):
        token_count.count_tokens(messy, tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
