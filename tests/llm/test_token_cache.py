"""Token ids: what is remembered is bounded, frequent words stay, and the ids are the library's."""

import numpy as np

from plait.llm import tokens


def test_frequent_words_are_made_once_and_the_rest_is_forgotten():
    t = tokens.ChunkTokenizer(tokens.default_path(), limit=16)
    made, make = [], t.words.make
    t.words.make = lambda w: made.append(w) or make(w)
    for i in range(60):
        text = f"Often, it's déjà-vu\tword{i}x\n new{i}y. l" + "o" * 100 + "ng Āȳ!'s _'t\r3.14 don'tx"
        assert np.frombuffer(t.encode(text), "<u4").tolist() == t.whole.encode(text, add_special_tokens=False).ids
        assert all(len(c) <= c.limit and len(c.older) <= c.limit for c in (t.words, t.pieces, t.chunks))
    assert made.count("often,") == made.count("déjà-vu") == 1
    assert made.count("l" + "o" * 100 + "ng") == 60  # too long to be kept


def test_chunks_of_other_texts_are_remembered_alike():
    t = tokens.ChunkTokenizer(tokens.default_path(), limit=8)
    made, make = [], t.chunks.make
    t.chunks.make = lambda c: made.append(c) or make(c)
    for i in range(30):
        text = f"你好 often 新{i}\n<|x|> a{i}"
        assert np.frombuffer(t.encode(text), "<u4").tolist() == t.whole.encode(text, add_special_tokens=False).ids
    assert made.count("你好") == 1 and len(t.chunks) <= 8
