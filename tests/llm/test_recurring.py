"""Which grams of a text recur, a whole chunk of texts at a time."""

import numpy as np
import pyarrow as pa

from barlens.llm.recurring import _among, _in_text


def test_grams_are_looked_up_in_their_own_text():
    lists = pa.array([[9, 9, 9], [5, -7], [], [5], [8]], pa.list_(pa.int64())).slice(1, 3)
    text = np.array([0, 0, 0, 1, 2, 2])
    grams = np.array([5, -7, 8, 5, 5, -7], np.int64).view(np.uint64)
    assert _among(_in_text(grams, text), lists).tolist() == [True, True, False, False, True, False]
    assert not _among(_in_text(grams, text), pa.array([[], [], []], pa.list_(pa.int64()))).any()
