"""Own encoder against the tokenizers library, and exact round trips."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import bpe
from geoloom.llm.queries import TOKENIZERS

PATH = os.path.join(TOKENIZERS, "word_bpe_49k.json")
tokenizers = pytest.importorskip("tokenizers")
if not os.path.exists(PATH):
    pytest.skip("no vocabulary files here", allow_module_level=True)


@pytest.fixture(scope="module")
def both():
    library = tokenizers.Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    return bpe.PairIndexBpe(PATH), library


def ids(packed):
    return np.frombuffer(packed, dtype="<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text("aAb'sSΣςσİé ́<|>endoftxart\x85\x1c \t1½中한글ß!!", max_size=60)))
def test_same_as_the_library(both, text):
    own, library = both
    packed = own.encode([text])[0]
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(packed) == want
    assert own.decode(packed) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["<|endoftext|>a<|startoftext|> b", "aaaaaaaaaaaaa aa a", "<|STARTOFTEXT|>", "I'Ve we'll", "", "!" * 300, "thththth" * 200])
def test_special_and_repeated(both, text):
    own, library = both
    assert ids(own.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids


def test_store_can_be_emptied(both, monkeypatch):
    own = bpe.PairIndexBpe(PATH)
    monkeypatch.setattr(bpe, "STORE_BYTES", 20)
    first = own.encode(["some words here", "and there"])
    assert own.encode(["some words here", "and there"]) == first


def test_rows(both, docs, rows):
    _, library = both
    got = bpe.bpe_round_trip(docs, PATH).collect()
    want = []
    for r in rows:
        own = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], own, len(own), library.decode(own, skip_special_tokens=False)))
    assert sorted(((g.id, ids(bytes(g.ids)), g.n_tokens, g.decoded) for g in got), key=repr) == sorted(want, key=repr)


def test_empty_table(no_docs):
    assert bpe.bpe_round_trip(no_docs, PATH).collect() == []


def test_other_kinds_are_refused():
    with pytest.raises((ValueError, TypeError, KeyError)):
        bpe.PairIndexBpe(os.path.join(TOKENIZERS, "byte_bpe_50k.json"))
