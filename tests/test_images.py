"""Image primitives that are called for each cell: windows against brute force, matrices of small images made once."""

import numpy as np
import pytest

from gradeloom.functions import images as M


@pytest.mark.parametrize("height, width", [(1, 5), (6, 1), (2, 2), (3, 4), (1, 1)])
def test_windows(height, width):
    mask = np.random.default_rng(height * 7 + width).random((13, 17)) < 0.6
    for flip, (up, left) in ((False, (height // 2, width // 2)), (True, (height - 1 - height // 2, width - 1 - width // 2))):
        found, many = M._windows(mask, height, width, flip)
        for y in range(13):
            for x in range(17):
                part = mask[max(0, y - up) : y - up + height, max(0, x - left) : x - left + width]
                assert (found[y, x], np.broadcast_to(many, mask.shape)[y, x]) == (part.sum(), part.size)


def test_matrices_of_small_images_are_made_once():
    assert M._gaussian(100, 15) is M._gaussian(100, 15) and M._gaussian(300, 15) is not M._gaussian(300, 15)
    assert M._resizing(48, 192) is M._resizing(48, 192)
