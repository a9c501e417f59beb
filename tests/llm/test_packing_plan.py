"""The configuration program: whole histograms, the share of its steps, and the knapsack against brute force."""

import math
import random

import numpy as np
import pytest

from sievekit.llm import packing


def used(plan):
    out = {}
    for config, copies in plan.configurations:
        assert copies > 0 and sum(x * n for x, n in config.items()) <= packing.CAPACITY
        for x, n in config.items():
            out[x] = out.get(x, 0) + n * copies
    return out


@pytest.mark.parametrize("seed,lengths,most", [(1, 5, 3), (2, 400, 4), (3, 1500, 60), (4, 2000, 5000)])
def test_every_piece_once(seed, lengths, most):
    rng = random.Random(seed)
    h = {x: rng.randint(1, most) for x in rng.sample(range(1, packing.CAPACITY + 1), lengths)}
    p = packing.plan(h)
    assert used(p) == h and sum(p.served.values()) == sum(h.values())


@pytest.mark.parametrize("copies", [1, 40])
def test_the_program_packs_most_pieces(copies):
    """Lengths as texts have them: most pieces come from the program, the rest costs next to nothing."""
    rng = np.random.default_rng(5)
    x = np.clip(np.rint(np.exp(rng.normal(5.6, 0.9, 12_000))), 1, packing.CAPACITY).astype(int)
    h = {int(v): int(n) * copies for v, n in zip(*np.unique(x, return_counts=True))}
    p = packing.plan(h)
    bound = math.ceil(sum(v * n for v, n in h.items()) / packing.CAPACITY)
    assert used(p) == h
    assert p.served["program"] >= 0.9 * sum(h.values())
    assert sum(c for _, c in p.configurations) <= bound * 1.001 + 1


def test_only_long_pieces_and_none():
    assert packing.plan({}).configurations == []
    assert used(packing.plan({1025: 7, 2048: 3})) == {1025: 7, 2048: 3}
    assert sum(c for _, c in packing.plan({1: 5}).configurations) == 1


def test_knapsack():
    rng = np.random.default_rng(6)
    for _ in range(20):
        cap = 24
        price = np.full(cap + 1, -np.inf)
        at = rng.choice(np.arange(1, cap + 1), 5, replace=False)
        price[at] = rng.random(5) * at
        best, choice = packing.knapsack(price, cap)
        want = np.zeros(cap + 1)
        for c in range(1, cap + 1):
            want[c] = max([want[c - 1], *[want[c - x] + price[x] for x in at if x <= c]])
        np.testing.assert_allclose(best, want)
        assert all(choice[c] == 0 or best[c] == pytest.approx(price[choice[c]] + best[c - choice[c]]) for c in range(cap + 1))
