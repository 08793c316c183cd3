"""Small corpora shared by the tests of this folder."""

import random


def words(n, seed=0):
    """n words of invented prose, equal for equal seeds."""
    rng = random.Random(seed)
    return [rng.choice("tor an el miv sto pra len dur ka osh".split()) + rng.choice("ba ne lo ti gru sen ar iv um ot".split()) + rng.choice(["", "s", "ing", "a", "el"]) for _ in range(n)]
