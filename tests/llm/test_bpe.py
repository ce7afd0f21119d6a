from __future__ import annotations

import numpy as np
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skyquarry.llm import bpe
from skyquarry.llm.packing import vocabulary

from .conftest import bag, rows

PATH = vocabulary("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
FAST, PLAIN = bpe.WordBpe(PATH, True), bpe.WordBpe(PATH, False)


def expected(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), LIBRARY.decode(ids, skip_special_tokens=False)


def test_query_rows(docs, empty, extra):
    want = sorted(((i, *expected(t or "")) for i, t in rows()), key=repr)
    assert bag(bpe.encode(docs, PATH), "doc_id", "ids", "decoded") == want
    assert bag(bpe.encode(extra, PATH), "doc_id", "ids", "decoded") == want
    assert bpe.encode(empty, PATH).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abcdeéèßñΣσ'sIİ .,<|>\x85\x1c end", max_size=40)))
@example("ΑΣ ΣΑΣ <|startoftext|><|ENDOFTEXT|>\x1c'LL")
def test_equals_the_library(text):
    want = expected(text)
    assert (FAST.encode(text), FAST.decode(FAST.encode(text))) == want
    assert PLAIN.encode(text) == want[0]


def test_other_scripts_go_through_forced_boundaries_too():
    texts = ["مرحبا بالعالم 123", "שלום עולם", "नमस्ते दुनिया", "สวัสดีชาวโลก ๑๒", "🤷🏽‍♂️ → ok 👍👍", "Привет, мир → ΑΣ", "한국어 中文 かな", "ａｂｃ ǅ ﬁ Ⅻ ½", "a\u0301 \u1e9b\u0323 <|endoftext|> \u200d"]
    for text in [*texts, " ".join(texts)]:
        assert (FAST.encode(text), FAST.decode(FAST.encode(text))) == expected(text)
        assert PLAIN.encode(text) == expected(text)[0]


def test_fragments_are_independent():
    assert PLAIN.consistent()
    for word in ("zxqj", "ß", "èçß", "internationalization"):
        assert b"".join(FAST.fragments_of(word.encode())) == word.encode()
    assert any(len(FAST.fragments_of(w.encode())) > 1 for w in ("èçß", "ñß", "éèê"))


def test_memory_is_bounded():
    own = bpe.Memory(lambda k: k * 2, 10)
    assert [own[i] for i in range(100)] == [2 * i for i in range(100)]
    assert len(own) + len(own.older) <= 20
    own = bpe.Memory(lambda k: k * 2, 10, lambda k: k < 5)
    assert [own[i] for i in (3, 7, 3)] == [6, 14, 6] and set(own) == {3}
    words = ["x" * n for n in (10, 64, 65, 5000)]
    assert [FAST.known[w] for w in words] == [FAST.encode_word(w) for w in words]
    assert all(len(w) <= 64 for w in FAST.known)
