"""Chunk numbers: unlike for any two chunks, and never one for two."""

import pandas as pd
import pytest

from leadsmith.llm import chunks as C


def test_numbers_differ_between_partitions_and_places():
    places = [(0, 0), (1, 0), (1 << 16, 0), ((1 << 16) + 1, 0), ((1 << 24) - 1, (1 << 15) - 1), (0, 1), (0, (1 << 15) - 1)]
    numbers = {C.chunk_number(part, place, check) for part, place in places for check in (0, 0xFFFFFFFF)}
    assert len(numbers) == 2 * len(places)
    assert all(0 <= n < 1 << 63 for n in numbers)


@pytest.mark.parametrize("part, place", [(1 << 24, 0), (0, 1 << 15)])
def test_chunks_beyond_the_numbers_fail(part, place):
    with pytest.raises(OverflowError, match="has no number"):
        C.chunk_number(part, place, 0)


@pytest.mark.parametrize("rows", [0, 2])
def test_a_chunk_is_one_row(rows):
    with pytest.raises(RuntimeError, match="another order"):
        C.only(pd.DataFrame({"chunk": [7] * rows}))
    assert C.only(pd.DataFrame({"chunk": [7]}))["chunk"] == 7
