"""Language ID on long runs of letters and long pieces."""

import math

import numpy as np
import pytest

language_id = pytest.importorskip("vicinity.llm.language_id")
PIECES = ["^", "a", "b", "ab", "abcdefghijkl"]


def model():
    return language_id.Model(["x", "y"], PIECES, np.log(np.array([[0.3, 0.3], [0.2, 0.3], [0.2, 0.1], [0.1, 0.2], [0.2, 0.1]])))


def test_letters_that_no_piece_covers():
    assert np.allclose(model().score("\u10d0" * 47), math.log(0.3) + 47 * math.log(language_id.CHARACTER))
    sums, n, letters = model().score_texts(["\u10d0" * 100 + " ab", "ab", "\u10d0" * 100])
    assert np.allclose(sums[0], sums[1] + sums[2]) and n.tolist() == [2, 1, 1] and letters.tolist() == [102, 2, 100]


def test_script_that_one_language_uses():
    m = language_id.Model(["x", "y"], ["^", "\u10d0"], np.log(np.array([[0.5, 0.9999], [0.5, 1e-9]])))
    got = m.score("\u10d0" * 100)
    assert np.allclose(got, [101 * math.log(0.5), math.log(0.9999) + 100 * math.log(1e-9)])


def test_long_words_are_not_cut():
    word = "ab" * 40
    chain = {0: 1.0, 1: 0.2}  # sums over segmentations of a prefix of the word, in exact steps
    for j in range(2, 81):
        chain[j] = chain[j - 1] * 0.2 + (chain[j - 2] * 0.1 if j % 2 == 0 else 0)
    assert language_id.units(word) == [word]
    assert np.isclose(model().score(word)[0], math.log(0.3) + math.log(chain[80]))
    assert np.isclose(model()._log_score("abab")[0], model().score("abab")[0])


def test_expected_counts_of_long_words():
    into = np.zeros(len(PIECES))
    model().expected("ab" + "\u10d0" * 60, 0, 2.0, into)
    assert np.allclose(into, [2.0, 2 * 0.04 / 0.14, 2 * 0.04 / 0.14, 2 * 0.1 / 0.14, 0.0])


def test_long_pieces_stay():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    assert max(map(len, language_id.pieces_of(public_tokenizers.path("piece_bpe_32k.model")))) > 8
