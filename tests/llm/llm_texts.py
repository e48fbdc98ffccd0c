"""Made-up texts for the tests."""

import random


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("klmnrst") + str(rng.randint(0, 99)) for _ in range(n))
