"""Characters in a row are numbered without a sort, whatever the script."""

import numpy as np
import pytest

from wicker.llm import perplexity


def windows(text, order=4):
    return np.concatenate(list(perplexity.grams(text, order)))


def test_rows_of_few_characters_are_not_sorted(monkeypatch):
    rows = windows("The whole of it, and then some; " * 500)
    monkeypatch.setattr(np, "unique", None)
    at, which = perplexity._distinct(rows)
    assert (rows[at][which] == rows).all() and len(at) == len(set(map(tuple, rows.tolist())))


@pytest.mark.parametrize("order", [1, 2, 4, 6])
@pytest.mark.parametrize("dense", [0, 1 << 21])
def test_numbers_of_rows_in_any_script(monkeypatch, order, dense):
    monkeypatch.setattr(perplexity, "DENSE", dense)
    draw = np.random.default_rng(5)
    for least, most, n in ((97, 100, 3000), (0x4E00, 0x9FFF, 2000), (0, 0xD7FF, 500), (0x1F300, 0x10FFFF, 800), (97, 98, 1)):
        rows = windows("".join(map(chr, draw.integers(least, most, n))), order)
        at, which = perplexity._distinct(rows)
        assert (rows[at][which] == rows).all() and len(at) == len(set(map(tuple, rows.tolist()))) and set(which) == set(range(len(at)))


def test_no_rows():
    at, which = perplexity._distinct(np.zeros((0, 4), np.uint32))
    assert len(at) == len(which) == 0
