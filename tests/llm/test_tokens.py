import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from matchloom.llm.packing import best_fit_decreasing
from matchloom.llm.tokens import encoder, pack, unpack

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700))
def test_pack_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert (unpack(pack(ids)) == ids).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text("aB's.,!é\u0301\u0338 1-='", max_size=40)), max_size=6))
def test_encoding_by_words_equals_whole_texts(texts):
    check_encoding(texts)


def check_encoding(texts):
    whole = Tokenizer.from_file(PATH)
    ids, counts = encoder(PATH)(pa.array(texts, pa.string()), 1)
    want = [whole.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert ids.tolist() == sum(want, [])
    assert counts.tolist() == [len(w) for w in want]


def test_encoding_of_marks_and_special_strings():
    check_encoding(["It's\tthe <|endoftext|> é ́x ΣΑΣ　ab\x1cc", "", None, "x" * 5000, "a" + "b " * 3000, " !!'s'S ''re"])


@given(st.lists(st.integers(1, 64), max_size=200))
def test_best_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    window, offset = best_fit_decreasing(lengths, 64)
    used = {}
    open_windows = []
    for n, w, at in zip(lengths, window, offset):
        fits = [used[x] for x in open_windows if used[x] + n <= 64]
        # the fullest window that fits, or a new one only if none fits
        assert at == (max(fits) if fits else 0)
        if not fits:
            open_windows.append(w)
        assert used.get(w, 0) == at
        used[w] = at + n
    assert all(v <= 64 for v in used.values())
