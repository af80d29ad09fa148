"""Ranks of the suffixes of a sequence of names, without a step a place."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from repurchase.llm import suffix


@pytest.mark.parametrize("packed", [True, False])
def test_ranks_of_suffixes(packed):
    before, suffix._PACKED = suffix._PACKED, suffix._PACKED if packed else 1

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.integers(1, 3), max_size=90))
    def check(body):
        s = [*body, 0]
        order = sorted(range(len(s)), key=lambda i: s[i:])
        assert suffix._sort_names(np.unique(s, return_inverse=True)[1])[order].tolist() == list(range(len(s)))

    try:
        check()
    finally:
        suffix._PACKED = before


def test_long_repeats():
    """One name, and copies of a long run, that are told apart by their ends."""
    run = np.random.default_rng(3).integers(1, 50, 5000)
    for body in (np.ones(40_000, int), np.tile(run, 8)):
        s = np.r_[body, 0]
        rank = suffix._sort_names(s)
        order = np.argsort(rank)
        a, b = order[:-1], order[1:]
        assert sorted(rank.tolist()) == list(range(len(s)))
        # Each suffix is below the next one: by its first name, or by the rank of what follows.
        assert np.all((s[a] < s[b]) | ((s[a] == s[b]) & (rank[np.minimum(a + 1, len(s) - 1)] < rank[np.minimum(b + 1, len(s) - 1)])))
