"""Ids of a whole text column: words cut on bytes, each different one looked up once."""

import numpy as np
import pyarrow as pa
import pytest

from ledgernet.llm import tokens
from ledgernet.llm.registry import BYTE_VOCABULARY, WORD_VOCABULARY, vocabulary

ROWS = ["skipped", None, "", "   ", "\n\n a", "a\n", "x ***", "naïve.***  \r\n", "it's &&& don't's", "b''s a'", "a  b.,c\t\ty z   ",
        "wide　space and more", "<|endoftext|>.<|endoftext|>", "日本語 テキスト。", "é.é*%$# &a", "x" * 200 + ". y"]


def plain(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(BYTE_VOCABULARY))
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def column_ids(encode, column):
    out = []
    for i, j, ids, counts in encode.encode_column(column):
        assert i == len(out) and len(counts) == j - i
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]]
    return out


@pytest.mark.parametrize("together", [8_000_000, 30])
def test_column_is_plain_tokenizer(monkeypatch, together):
    monkeypatch.setattr(tokens, "WORD_BYTES", together)
    encode = tokens.WordTokenizer(vocabulary(BYTE_VOCABULARY), 20)
    assert column_ids(encode, pa.array(ROWS).slice(1)) == plain(ROWS[1:])
    assert column_ids(encode, pa.array([None, ""])) == [[], []]
    assert list(encode.encode_column(pa.array([], pa.string()))) == []


def test_each_word_of_a_column_is_looked_up_once(monkeypatch):
    encode = tokens.WordTokenizer(vocabulary(BYTE_VOCABULARY), 1000)
    asked, look_up = [], encode._look_up
    monkeypatch.setattr(encode, "_look_up", lambda words, whole: (asked.extend(words), look_up(words, whole))[1])
    rows = ["one two.*** three; two"] * 50
    assert column_ids(encode, pa.array(rows)) == plain(rows)
    assert sorted(asked) == [" three", " two", ".***", ";", "one"]


def test_folding_vocabularies_are_refused():
    with pytest.raises(ValueError):
        list(tokens.WordTokenizer(vocabulary(WORD_VOCABULARY), 10).encode_column(pa.array(["A b"])))
