"""Hashes of words that are made by arrays, and places of cells, against plain Python."""

import random

import numpy as np

from framesift.llm import common
from framesift.llm.substring_dedup import _placed


def test_equal_words_and_no_others_have_equal_hashes():
    r = random.Random(5)
    word = lambda n: bytes(r.choice(b"ab\x00\xc3\xa9\x7f\xff\x1f\x0e\x08!") for _ in range(n))
    known = [word(r.choice([1, 2, 3, 8, 63, 64, 65, 200])) for _ in range(300)] + [b"", b"ab", b"ba", word(3 * common.PIECE)]
    space = lambda: bytes(r.choice(b" \t\n\v\f\r") for _ in range(r.randint(1, 3)))
    texts = [b"", b" \n", b"x"]
    for n in (1, 10, 5000, 30000):  # the last ones are longer than a step, so words lie across its borders
        texts.append(b"".join(r.choice(known[:-1]) + space() for _ in range(n)).strip() + space() * (n % 3))
    texts += [known[-1], known[-1][:-1] + b"?", b"y " + known[-1]]
    hashes, sizes = common.hashed_words(texts)
    words = [w for t in texts for w in t.split()]
    assert sizes.tolist() == [len(t.split()) for t in texts]
    assert len(hashes) == len(words)
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes.tolist()))
    assert len(set(seen.values())) == len(seen)
    assert [len(x) for x in common.hashed_words([])] == [0, 0] and [len(x) for x in common.hashed_words([b""])] == [0, 1]


def test_places_of_cells():
    r = np.random.default_rng(5)
    for most in (1, 50, 1 << 40, 1 << 63):
        for n in (0, 1, 2, 1000):
            cells = r.integers(0, most, n, dtype=np.uint64)
            found, place = _placed(cells)
            assert (found == np.unique(cells)).all() and (found[place] == cells).all()
