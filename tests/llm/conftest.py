import random

import pytest

WORDS = ["".join(random.Random(i).choices("abcdefghijklmnop", k=3 + i % 5)) for i in range(900)]


class Texts:
    """Made-up texts from a seed."""

    def __init__(self, seed=0):
        self.r = random.Random(seed)

    def words(self, n):
        return [self.r.choice(WORDS) for _ in range(n)]

    def text(self, n):
        out = self.words(n)
        for i in range(11, n, 12):
            out[i] += ".\n" if self.r.random() < 0.3 else "."
        return " ".join(out)

    def edited(self, text, share):
        """About ``share`` of the words replaced."""
        return " ".join(self.r.choice(WORDS) + "x" if self.r.random() < share else w for w in text.split(" "))


@pytest.fixture
def texts():
    return Texts()
