"""Toxicity: no word is left out of the kernel."""

import numpy as np

from spectraloom.llm.toxicity import Model, Settings


def test_every_word_is_scored_by_the_kernel():
    marks = ["abcdefgh", "garden"]
    m = Model(Settings(), 0.5, marks, np.array([1.0, -0.5]), -0.9, np.ones(4))
    words = ["abcdefgh", "xaxbxcx", "gardener", "qqq", "orange", "awbwwc"]
    assert np.allclose(m.word_scores(words), np.maximum(m._kernel(words) @ m.alpha + m.bias, -2.0))
    assert m.word_scores(["qqq"])[0] == -0.9 and m.word_scores(["awbwwc"])[0] > -0.9
