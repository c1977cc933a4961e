"""Texts longer than the hashing chunk give the same hashes as in one piece."""

import numpy as np
import pyarrow as pa

from tonemill.llm.common import gram_hashes, gram_starts, hash_words, text_arrays, words_of
from tonemill.llm.substring_dedup import squeezed


def test_chunks_do_not_matter():
    texts = [" ".join(f"w{i % 97}" for i in range(3000)), None, "", " lead and trail \n", "x" * 5000, "no", "space"]
    words = words_of(pa.array(texts))
    assert np.array_equal(hash_words(words), hash_words(words, chunk=50))
    assert np.diff(words.first).tolist() == [3000, 0, 0, 3, 1, 1, 1]
    same = words_of(pa.array(["a bb a", "a", "bb"]))
    h = hash_words(same)
    assert h[0] == h[2] == h[3] and h[1] == h[4] and h[0] != h[1]


def test_grams_stay_in_their_row():
    words = words_of(pa.array(["a b c d", "e f", "", "g h i"]))
    at, count = gram_starts(words.first, 3)
    assert (at.tolist(), count.tolist()) == ([0, 1, 6], [2, 0, 0, 1])
    assert len(gram_hashes(hash_words(words), 3)[at]) == 3


def test_lower_case_is_ascii_only():
    one, other = (hash_words(words_of(pa.array([t]), lower=True)) for t in ("ABC É", "abc É"))
    assert np.array_equal(one, other)
    assert hash_words(words_of(pa.array(["É"]), lower=True))[0] != hash_words(words_of(pa.array(["é"]), lower=True))[0]


def test_single_spaces():
    words = squeezed(*text_arrays(pa.array([" a \t b", "c\n\nd ", "e"])))
    assert [bytes(words.body[i:j]) for i, j in zip(words.start, words.end, strict=True)] == [b"a", b"b", b"c", b"d", b"e"]
    assert b"  " not in words.body.tobytes()
    assert np.diff(words.first).tolist() == [2, 2, 1]
