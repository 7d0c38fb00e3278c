"""The labeller's word vectors cover whole lines."""

import numpy as np

from sievewright.llm.labeller import vectors


def test_every_word_of_a_line_counts():
    start = " ".join(f"w{i}" for i in range(40))
    a, b, c = vectors([start, start + " one more", start + " two less"], [set()] * 3)
    assert not np.array_equal(a, b) and not np.array_equal(b, c)


def test_long_lines_stay_finite():
    x = vectors([" ".join(f"w{i}" for i in range(30_000)), "word " * 30_000], [set()] * 2)
    assert np.isfinite(x).all() and np.abs(x[0]).max() < 10
