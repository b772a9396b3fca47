"""Links of a batch, drawn together, against plain components."""

import random

import numpy as np

from plumbago.llm import simhash
from tests.llm import brute


def test_every_end_hangs_on_its_least():
    rng = random.Random(3)
    for n in (0, 1, 5, 40, 200):
        links = [(rng.randrange(60) + 2**63, rng.randrange(60) + 2**63) for _ in range(n)]
        got = dict(simhash._to_roots(np.array(links, np.uint64).reshape(-1, 2)).tolist())
        least = brute.least_reachable({x for link in links for x in link}, lambda a, b: (a, b) in links or (b, a) in links)
        assert got == {x: y for x, y in least.items() if x != y}
