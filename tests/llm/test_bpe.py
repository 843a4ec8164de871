"""BPE against the tokenizers library: equal ids and texts."""

import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tracelake.llm.bpe import WordBpe, encode_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", " ", "Hello, World! don't I'LL", "<|endoftext|> a<|startoftext|>b <|end", "Éçà ΑΣ ΣΑΣ İ ß ǅ", "x" * 700 + "abc" * 90, "a\x1cb \x85c　d", "é ́e 123 ½ ①", "  lead\n\n trail  ", "日本語 テキスト", "word " * 5000]


@pytest.fixture(scope="module")
def both():
    return WordBpe(PATH), Tokenizer.from_file(PATH)


def ids(bpe, text):
    return np.frombuffer(bpe.encode([text])[0], "<u4").tolist()


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_and_text(both, text):
    bpe, library = both
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(bpe, text) == want
    assert bpe.decode(bpe.encode([text])[0]) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=60))
def test_any_latin_text(both, text):
    assert ids(both[0], text) == both[1].encode(text, add_special_tokens=False).ids


def test_every_code_point_between_letters(both):
    """All planes; of the long runs of ideographs, syllables and beyond every 97th."""
    runs = lambda c: 0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A0 or c >= 0x20000
    texts = [f"a{chr(c)}b!" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (not runs(c) or c % 97 == 0)]
    want = both[1].encode_batch(texts, add_special_tokens=False)
    got = both[0].encode(texts)
    assert [t for t, w, g in zip(texts, want, got) if w.ids != np.frombuffer(g, "<u4").tolist()] == []


def test_marks_in_any_order(both):
    rng = random.Random(11)
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    marks = [c for c in every if unicodedata.category(chr(c))[0] == "M"]
    kinds = (marks, every, range(32, 127), range(0xC0, 0x250))
    texts = ["".join(chr(rng.choice(rng.choice(kinds))) for _ in range(rng.randrange(1, 14))) for _ in range(20_000)]
    texts += ["a\u1ab1\u08d2", "a\u0331\u0d3b", "\U00011935\U00011930", "\u0558\u088f\u1c89\ua7cb\U00010940"]
    want = both[1].encode_batch(texts, add_special_tokens=False)
    assert [t for t, w, g in zip(texts, want, both[0].encode(texts)) if w.ids != np.frombuffer(g, "<u4").tolist()] == []


def test_memo_limit_changes_nothing(both, monkeypatch):
    from tracelake.llm import bpe as module

    monkeypatch.setattr(module, "MEMO", 3)
    small = WordBpe(PATH)
    assert [small.encode([t])[0] for t in TEXTS] == [both[0].encode([t])[0] for t in TEXTS]
    assert len(small) <= 3


def test_operator_keeps_rows_nulls_and_clashing_names(spark):
    rows = [(1, "Hi there", "x"), (1, "Hi there", "y"), (None, None, "z"), (3, "", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumnRenamed("ids", "n_tokens")
    found = encode_documents(df, PATH, decode=True).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in found) == [(0, 0, ""), (1, 2, "hi</w> there</w>"), (1, 2, "hi</w> there</w>"), (3, 0, "")]
    assert encode_documents(df.limit(0), PATH).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_marks_after_words_are_pieces_of_their_own(both):
    """A word is learned once, whatever mark follows it."""
    from tracelake.llm.bpe import _pieces

    text = "Été, été. été! Été it's, a... b.' c., d.\x0be. <|endoftext|>, x.\t1. ́. ŉ, ..\n"
    assert set(_pieces("been, been. been: been")) == {"been", ",", ".", ":"}
    assert ids(WordBpe(PATH), text) == both[1].encode(text, add_special_tokens=False).ids


def test_marks_at_words_ends_are_pieces_of_their_own(both):
    """A word is learned once, whatever run of marks follows it; the ids stay those of the whole text."""
    from tracelake.llm.bpe import _pieces

    text = "Erer,### éle$$$ don't!! a$b x###y z%%% \n<|end.&& <|endoftext|>.** 12*** q,,"
    assert _pieces(text) == ["Erer", ",###", "éle", "$$$", "don't", "!!", "a$b", "x###y", "z", "%%%", "<|end", ".&&", "<|endoftext|>.**", "12***", "q,,"]
    for some in (text, text + " ", text.replace("<|", "")):
        assert ids(both[0], some) == both[1].encode(some, add_special_tokens=False).ids
