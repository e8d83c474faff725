import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import numpy as np

from tidewell.llm import tokens
from tidewell.llm.tokens import PieceEncoder

ODD = [
    "", " ", "  a  b ", " lead", "trail ", "x \n y", "\n x", "\nx", "x\n", "a\n\nb", "a\n\n b.", "a \nb", "a.\nb\tc\n\td", "\x00a", "a<|endoftext|>b <|startoftext|>", "a <|endof|> b",
    "İstanbul Σας ΟΔΟΣ", "éa 你好,世界 🙂 ok\n\n x\ty\r\n", "it's IT'S ''s 'sab \x1c\x1d\x85\xa0z", "naïve—“q” 12345 x²³", "é decomposed é", "we'll don't I'VE",
]
NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
CODES = {n: PieceEncoder(public_tokenizers.path(n)) for n in NAMES}
LIBRARY = {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in NAMES}


def same(name, text):
    got = np.frombuffer(CODES[name].ids(text), "<u4").tolist()
    assert got == LIBRARY[name].encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name", NAMES)
def test_odd_texts(name):
    for text in ODD:
        same(name, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Zé\n\t\r.,'s1²—你🙂Σ́\x00\x85\xa0<|>"))))
def test_any_text(text):
    for name in NAMES:
        same(name, text)


def test_full_tables_change_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 3)
    code = PieceEncoder(public_tokenizers.path(NAMES[0]))
    text = "many different words, none of them kept for long.\nAnd a second line"
    assert np.frombuffer(code.ids(text), "<u4").tolist() == LIBRARY[NAMES[0]].encode(text, add_special_tokens=False).ids
    assert len(code.chunks) <= 3 and len(code.cache) <= 3
