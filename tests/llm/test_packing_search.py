"""The local search ends in a local optimum: no move or exchange is left that raises the squared fill."""

import itertools

import numpy as np
import pytest

from quillcount.llm import packing


def step_left(bins, lengths, capacity):
    fill = [sum(lengths[i] for i in b) for b in bins]
    for a, b in itertools.permutations(range(len(bins)), 2):
        if not fill[a] <= fill[b] < capacity:
            continue
        gives = [(i,) for i in bins[a]]
        pairs = list(itertools.combinations(bins[a], 2))
        takes = [()] + [(j,) for j in bins[b]]
        for out, back in itertools.chain(itertools.product(gives, takes), itertools.product(pairs, takes[1:]), itertools.product(gives, itertools.combinations(bins[b], 2))):
            gain = sum(lengths[i] for i in out) - sum(lengths[j] for j in back)
            if 0 < gain <= capacity - fill[b]:
                return a, b, out, back
    return None


@pytest.mark.parametrize("seed", range(8))
def test_local_optimum(seed):
    rng = np.random.default_rng(seed)
    capacity = 100
    lengths = [int(x) for x in rng.integers(18, 60, 60)]
    start = [[i] for i in range(60)] if seed % 2 else packing.best_fit(lengths, capacity)
    bins = packing.local_search(start, lengths, capacity)
    assert sorted(i for b in bins for i in b) == list(range(60)) and all(sum(lengths[i] for i in b) <= capacity for b in bins)
    assert len(bins) <= len(start) and (len(bins) == -(-sum(lengths) // capacity) or step_left(bins, lengths, capacity) is None)


def test_bins_of_many_pieces_are_exchanged():
    """120 pieces against 60: more pairs of pieces than were once looked at."""
    lengths = [1] * 120 + [2] * 60 + [7] * 10 + [130, 139]
    bins = packing.local_search([list(range(120)), list(range(120, 180)), list(range(180, 190)), [190], [191]], lengths, 200)
    assert len(bins) == 3  # 579 tokens


def test_added_tokens_are_those_of_the_file():
    pattern, ids, plain = packing.added_tokens(packing.default_vocabulary()[2])
    assert plain and ids == {"<|endoftext|>": 50256} and pattern.split("a<|endoftext|>b") == ["a", "<|endoftext|>", "b"]
