"""Every row is held against the sentencepiece library, whatever its length."""

import copy

import pytest

from docketry.llm import piece_bpe

TEXTS = ["", "a", "b c", "a longer text than the others", "  odd   spaces ", "日本語 😀 \x01"]


@pytest.mark.parametrize("wrong", TEXTS)
def test_a_wrong_row_of_any_length_is_found_and_mended(wrong):
    bpe = piece_bpe.piece_bpe(piece_bpe.default_model())
    right = list(piece_bpe.checked(bpe, list(range(len(TEXTS))), TEXTS))
    assert [r[0] for r in right] == list(range(len(TEXTS))) and not any(r[3] for r in right)
    broken = copy.copy(bpe)
    broken.encode = lambda text: bpe.encode(text + " x" if text == wrong else text)
    got = list(piece_bpe.checked(broken, list(range(len(TEXTS))), TEXTS))
    assert [r[3] for r in got] == [t == wrong for t in TEXTS]
    assert all(a[1].tolist() == b[1].tolist() and a[2] == b[2] for a, b in zip(got, right, strict=True))  # the library's stand in
