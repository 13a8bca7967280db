"""Plain versions of the training-data operators, written from their definitions; slow, and for small tables only."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import combinations

from featherloom.llm import secrets

LOWER = {c: c + 32 for c in range(65, 91)}


def item_windows(text: str | None) -> list[tuple[str, ...]]:
    w = overlap_words(text)
    return [tuple(w[i : i + 8]) for i in range(max(1, len(w) - 7))] if w else []


def overlap_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def overlap(text: str | None, items: dict[str, str | None]) -> tuple[int, int, list[str]]:
    """Words, words inside occurrences, and the items that occur."""
    w = overlap_words(text)
    hit, found = set(), set()
    for item, t in items.items():
        for p in set(item_windows(t)):
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found.add(item)
    return len(w), len(hit), sorted(found)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text: str | None) -> set[tuple[str, ...]]:
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_groups(texts: dict[int, str | None], percent: int = 85) -> dict[int, int]:
    """The smallest id that links reach, for each id. Links: percent of the shingles of both are in both."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {p for own in by.values() for p in combinations(sorted(own), 2)} if len(sets) <= 1500 else set()
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


def secret_base(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end)."""
    assign = r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return sorted(out)


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def secret_spans(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    base, more = secret_base(text), []
    for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", text):
        s = m[0]
        if not re.search("[0-9]", s) or any(re.search(p, s) for p in secrets.ALLOWED):
            continue
        kind = next((k for k in secrets.CLASSES.values() if re.search(k[0], s)), None)
        if not kind:
            continue
        good = [i for i in range(len(s) - secrets.WINDOW + 1) if entropy(s[i : i + secrets.WINDOW]) >= kind[2] - 1e-9]
        if good:
            a, b = m.start() + good[0], m.start() + good[-1] + secrets.WINDOW
            if not any(x < b and a < y for x, _, y in base):
                more.append((a, 3, b))
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(base + more)]


def redacted(text: str | None) -> str | None:
    if text is None:
        return None
    out, at = "", 0
    for _, a, b in secret_spans(text):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def luhn(s: str) -> bool:
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def pii_base(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def jump(key: int, n: int) -> int:
    """Jump consistent hash of one key, as published."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def grams(text: str | None) -> Counter:
    """Letter n-grams (1 to 3) of words that are padded by a boundary on both sides."""
    out: Counter = Counter()
    text = "".join(c if c.isalpha() else "\1" for c in (text or "").lower())
    runs = [w for w in text.split("\1") if w]
    if not runs:
        return out
    line = "\1" + "\1".join(runs) + "\1"
    out.update(c for c in line if c != "\1")
    out.update(line[i : i + 2] for i in range(len(line) - 1))
    out.update(line[i : i + 3] for i in range(len(line) - 2) if line[i + 1] != "\1")
    return out


def profile(counts: Counter, size: int) -> list[str]:
    """The most frequent n-grams; ties go by the n-gram's code, short ones first."""
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:size]]


def distances(text: str | None, profiles: dict[str, list[str]], size: int) -> dict[str, float] | None:
    own = profile(grams(text), size)
    if not own:
        return None
    out = {}
    for lang, p in profiles.items():
        at = {g: i for i, g in enumerate(p)}
        out[lang] = sum(abs(at[g] - i) if g in at else size for i, g in enumerate(own)) / (len(own) * size)
    return out
