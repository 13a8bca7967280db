"""Random typed values for tests: reproducible, with a share of empty ones."""

from __future__ import annotations

import random
import string
from collections.abc import Callable, Iterator

from ..types import TYPES


class RandomData:
    """Values of a feature type. limit(n) gives n of them; reset(seed) starts again."""

    def __init__(self, ftype: str, seed: int = 42, empty: float = 0.0, draw: Callable[[random.Random], object] | None = None):
        if empty and not TYPES[ftype].nullable:
            raise ValueError(f"{ftype} has no empty values")
        self.ftype, self.empty, self.draw = ftype, empty, draw or _draw(ftype)
        self.reset(seed)

    def reset(self, seed: int) -> RandomData:
        self.random = random.Random(seed)
        return self

    def __iter__(self) -> Iterator:
        while True:
            yield None if self.random.random() < self.empty else self.draw(self.random)

    def limit(self, n: int) -> list:
        it = iter(self)
        return [next(it) for _ in range(n)]


def normal(mean: float = 0.0, std: float = 1.0) -> Callable:
    return lambda r: r.gauss(mean, std)


def uniform(lo: float, hi: float) -> Callable:
    return lambda r: r.uniform(lo, hi)


def poisson(mean: float) -> Callable:
    def draw(r: random.Random) -> float:
        n, at = 0, r.expovariate(1)
        while at < mean:
            n, at = n + 1, at + r.expovariate(1)
        return float(n)

    return draw


def log_normal(mean: float = 0.0, std: float = 1.0) -> Callable:
    return lambda r: r.lognormvariate(mean, std)


def choice(values: list) -> Callable:
    return lambda r: r.choice(values)


def _word(r: random.Random, n: int = 8) -> str:
    return "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(1, n)))


def _draw(ftype: str) -> Callable[[random.Random], object]:
    t = TYPES[ftype]
    special = {
        "Email": lambda r: f"{_word(r)}@{_word(r)}.com", "URL": lambda r: f"https://{_word(r)}.example.com/{_word(r)}", "Phone": lambda r: f"+1{r.randint(200, 999)}{r.randint(200, 999)}{r.randint(0, 9999):04d}",
        "PickList": lambda r: r.choice("ABCDE"), "ID": lambda r: f"{r.getrandbits(64):016x}", "Percent": lambda r: r.random(), "PostalCode": lambda r: f"{r.randint(0, 99999):05d}",
    }
    if ftype in special:
        return special[ftype]
    if t.family.startswith("map:"):
        base = ftype.removesuffix("Map") if ftype != "NameStats" else "Text"
        own = _draw(base)
        return lambda r: {f"k{i}": own(r) for i in range(r.randint(1, 4))}
    return {
        "binary": lambda r: r.random() < 0.5, "integral": lambda r: r.randint(-1000, 1000), "real": lambda r: r.gauss(0, 1), "date": lambda r: r.randint(0, 2_000_000_000_000),
        "text": lambda r: " ".join(_word(r) for _ in range(r.randint(1, 10))), "category": _word, "vector": lambda r: [r.gauss(0, 1) for _ in range(4)], "list": lambda r: [_word(r) for _ in range(r.randint(1, 5))],
        "datelist": lambda r: sorted(r.randint(0, 2_000_000_000_000) for _ in range(r.randint(1, 4))), "location": lambda r: [r.uniform(-90, 90), r.uniform(-180, 180), float(r.randint(1, 10))],
        "set": lambda r: sorted({r.choice("ABCDE") for _ in range(r.randint(1, 4))}), "prediction": lambda r: {"prediction": float(r.random() < 0.5)},
    }[t.family]
