"""Personal data: patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate segments (their digits, separators, shape, check sums and surroundings), and a dynamic
programme over segments of bounded length chooses boundaries and types together. It is trained here, on a bounded number of
generated examples, by gradient ascent on the likelihood of the right segmentation.

A segment can only lie in an island: parts of the text between white space that hold a digit or an at sign, joined by
single spaces. Outside of islands nothing scores, so that decoding islands alone is decoding the whole text. A segment does not
begin or end inside of a run of letters and digits.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, islice, pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

KINDS = ["email", "ip", "card", "phone"]
#: Types of the field: no entity, the kinds of the patterns, and two that only the field finds.
LABELS = ["-", *KINDS, "ssn", "iban"]
#: Tokens in a segment.
MAX_TOKENS = 18
#: Generated training examples, and passes over them.
EXAMPLES = 800
EPOCHS = 4
SEED = 11
#: Tokens of an island that are held at a time.
BLOCK = 4096
#: Log odds against the next best reading of the island that an added span needs.
MARGIN = 2.0

_AT_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ISLAND = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@]*+[0-9@]\S*+)*+")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]", re.DOTALL)
_CUES = {
    "tel": "phone", "phone": "phone", "call": "phone", "fon": "phone", "telefon": "phone", "mobile": "phone", "fax": "phone",
    "ssn": "ssn", "social": "ssn", "security": "ssn", "iban": "iban", "account": "iban", "konto": "iban", "card": "card",
    "visa": "card", "karte": "card", "carte": "card", "mail": "email", "email": "email", "ip": "ip", "host": "ip",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, found from the at signs, so that long runs without one cost nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _AT_DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all pattern matches that pass their check, in that order."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((at, 3, m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return sorted(out)


def _bucket(n: int) -> str:
    return str(n) if n < 20 else "20+"


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def segment_features(text: str, a: int, b: int, cue: str) -> list[str]:
    """Features of text[a:b] as one segment; cue: the kind that words before the island speak of, or ''."""
    s = text[a:b]
    digits = re.sub("[^0-9]", "", s)
    n = len(digits)
    shape = re.sub("[A-Za-z]+", "a", re.sub("[0-9]+", lambda m: _bucket(len(m.group())) + "d", s))
    before, after = text[a - 1 : a], text[b : b + 1]
    whole = (not before or not (before.isalnum() or before in "@._%+-/=\"'#:")) and (not after or not (after.isalnum() or after in "@_%+=/"))
    more = bool(re.search(r"[0-9][ .-]?$", text[:a][-2:]) or re.match(r"[ .-]?[0-9]", text[b : b + 2]))
    groups = re.findall("[0-9]+", s)
    out = ["bias", f"n{_bucket(n)}", f"whole{whole}", f"more{more}", f"first{s[0] if not s[0].isalnum() else 'd' if s[0].isdigit() else 'a'}"]
    if len(shape) <= 24:
        out.append(f"shape{shape}")
    out.append("seps" + "".join(sorted({c for c in s if not c.isalnum()})))
    if "@" in s:
        tail = s.rsplit("@", 1)[1]
        out.append(f"at{s.count('@')}")
        out.append(f"mail{bool(re.fullmatch(r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}', s))}{whole}")
        out.append(f"dot{'.' in tail}")
    elif n >= 4:
        if 12 <= n <= 19:
            out.append(f"luhn{luhn(digits)}{whole and not more}")
        if len(groups) == 4 and re.fullmatch(r"[0-9]+(\s?\.\s?[0-9]+){3}", s):
            out.append(f"octets{all(len(g) <= 3 and int(g) <= 255 for g in groups)}{whole and not more}")
        if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", s):
            out.append(f"ssn{not re.match('000|666|9', s)}{whole and not more}")
        if re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", s):
            out.append(f"nanp{s[0] == '('}{whole and not more}")
        if s[0] == "+":
            out.append(f"plus{9 <= n <= 15}{whole and not more}")
        if s[:2].isalpha() and s[:2].isupper():
            out.append(f"iban{_iban(s)}{whole}")
        if cue:
            out.append(f"cue{cue}{whole and not more}")
            out.append(f"cue{cue}n{_bucket(n)}")
    return out


def cue_before(text: str, at: int) -> str:
    """The kind that one of the three words before a place speaks of."""
    for w in reversed(re.findall("[A-Za-z]+", text[max(0, at - 40) : at])[-3:]):
        if w.lower() in _CUES:
            return _CUES[w.lower()]
    return ""


def candidates(text: str, lo: int, hi: int, starts: int | None = None) -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """Token borders of an island, and (i, j, start, end) of the token ranges that may be an entity: bounded in length,
    beginning and ending like one, with an at sign or seven digits. starts: first tokens that are asked for (all)."""
    edges = [lo, *[m.end() for m in _TOKEN.finditer(text, lo, hi)]]
    digits = list(accumulate((b - a if "0" <= text[a] <= "9" else 0 for a, b in pairwise(edges)), initial=0))
    signs = list(accumulate((text[a] == "@" for a in edges[:-1]), initial=0))
    n, out = len(edges) - 1, []
    for i in range(n if starts is None else min(n, starts)):
        a = edges[i]
        c = text[a]
        if not (c.isascii() and c.isalnum() or c in "+(") or a and text[a - 1].isalnum() and c.isalnum():
            continue
        for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
            d, b = text[edges[j] - 1], edges[j]
            if d.isascii() and d.isalnum() and (digits[j] - digits[i] >= 7 or signs[j] > signs[i]) and not (b < len(text) and text[b].isalnum()):
                if digits[j] - digits[i] > 34:
                    break
                out.append((i, j, a, b))
    return edges, out


def blocks(text: str, lo: int, hi: int, size: int) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
    """(tokens, candidates that begin in them) of the parts of an island, `size` tokens each; a candidate's numbers count from
    the first token of its part, and its end may lie beyond the part."""
    while lo < hi:
        ends = [m.end() for m in islice(_TOKEN.finditer(text, lo, hi), size + MAX_TOKENS)]
        n = min(size, len(ends))
        yield n, candidates(text, lo, ends[-1], n)[1]
        lo = ends[n - 1]


class SemiCRF:
    """weights: a row for each feature, a column for each label but '-'; moves: label to label; inactive segments score 0."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves

    def ids(self, names: list[str]) -> list[int]:
        return [self.index[n] for n in names if n in self.index]

    def segments(self, text: str, lo: int, hi: int) -> tuple[int, list[tuple]]:
        """Number of tokens of an island, and its candidates (start token, end token, start, end, feature ids)."""
        edges, found = candidates(text, lo, hi)
        cue = cue_before(text, lo) if found else ""
        return len(edges) - 1, [(i, j, a, b, self.ids(segment_features(text, a, b, cue))) for i, j, a, b in found]

    def scored(self, found: list[tuple]) -> dict[int, list]:
        """For each end token the segments (start token, scores by label, start, end, feature ids)."""
        by_end: dict[int, list] = {}
        for i, j, a, b, ids in found:
            by_end.setdefault(j, []).append((i, self.weights[ids].sum(0), a, b, ids))
        return by_end

    def decode(self, text: str, lo: int, hi: int, size: int = BLOCK) -> list[tuple[int, int, int]]:
        """Best segmentation of an island: (start, end, label) of its entities, by dynamic programming.

        Tokens are taken in blocks. After each, what all open readings share is given out and forgotten, so that a long island
        is not held as a whole.
        """
        k, cue = len(LABELS), None
        first = np.full(k, -np.inf)
        first[0] = 0.0
        best: dict[int, np.ndarray] = {0: first}  # scores by label, for places that are not behind yet
        back: dict[tuple[int, int], tuple] = {}  # (place, label): (place before, label before, entity or None)
        out: list[tuple] = []
        root, at = (0, 0), 0
        for n, found in blocks(text, lo, hi, size):
            if found and cue is None:
                cue = cue_before(text, lo)
            by_start: dict[int, list] = {}
            for i, j, a, b in found:
                by_start.setdefault(i, []).append((j, a, b))
            for i in range(n):
                now = best.pop(at + i)
                stay = now + self.moves[:, 0]
                p = int(np.argmax(stay))
                best.setdefault(at + i + 1, np.full(k, -np.inf))[0] = stay[p]
                back[at + i + 1, 0] = (at + i, p, None)
                if i not in by_start:
                    continue
                come = now[:, None] + self.moves[:, 1:]
                p = np.argmax(come, 0)
                come = come[p, np.arange(k - 1)]
                for j, a, b in by_start[i]:
                    score = self.weights[self.ids(segment_features(text, a, b, cue))].sum(0)
                    then = best.setdefault(at + j, np.full(k, -np.inf))
                    total = come + score
                    for y in np.flatnonzero(total > then[1:]):
                        then[y + 1] = total[y]
                        back[at + j, int(y) + 1] = (at + i, int(p[y]), (a, b, int(y) + 1, float(score[y])))
            at += n
            last = {(j, int(y)) for j, scores in best.items() for y in np.flatnonzero(scores > -np.inf)}
            root = self._shared(last, back, root, out)
        self._shared({(at, int(np.argmax(best[at])))}, back, root, out)
        return [(a, b, y) for a, b, y, score in out if score >= MARGIN]

    @staticmethod
    def _shared(states: set[tuple[int, int]], back: dict, root: tuple[int, int], out: list) -> tuple[int, int]:
        """Append the entities of what the readings that end in `states` share; the last place of that."""
        states, kept = set(states), {}
        while len(states) > 1:
            s = max(states)
            states.remove(s)
            if s != root:
                kept[s] = back[s]
                states.add(back[s][:2])
        new = s = next(iter(states))
        own = []
        while s != root:
            before = back[s]
            if before[2]:
                own.append(before[2])
            s = before[:2]
        out += reversed(own)
        back.clear()
        back.update(kept)
        return new

    def gradient(self, n: int, found: list[tuple], right: dict[tuple[int, int], int]) -> tuple[np.ndarray, list]:
        """Expected against observed moves, and (feature ids, gradient by label) for each segment."""
        by_end = self.scored(found)
        k = len(LABELS)
        alpha = np.full((n + 1, k), -np.inf)
        alpha[0, 0] = 0.0
        for j in range(1, n + 1):
            terms = [np.r_[np.logaddexp.reduce(alpha[j - 1] + self.moves[:, 0]), np.full(k - 1, -np.inf)]]
            for i, score, *_ in by_end.get(j, ()):
                terms.append(np.r_[-np.inf, np.logaddexp.reduce(alpha[i][:, None] + self.moves[:, 1:], 0) + score])
            alpha[j] = np.logaddexp.reduce(terms, 0)
        beta = np.full((n + 1, k), -np.inf)
        beta[n] = 0.0
        for j in range(n, 0, -1):
            beta[j - 1] = np.logaddexp(beta[j - 1], self.moves[:, 0] + beta[j, 0])
            for i, score, *_ in by_end.get(j, ()):
                beta[i] = np.logaddexp(beta[i], np.logaddexp.reduce(self.moves[:, 1:] + (score + beta[j, 1:])[None], 1))
        z = np.logaddexp.reduce(alpha[n])
        moves = np.zeros((k, k))
        segs = []
        for j in range(1, n + 1):
            moves[:, 0] -= np.exp(alpha[j - 1] + self.moves[:, 0] + beta[j, 0] - z)
            for i, score, a, b, ids in by_end.get(j, ()):
                p = np.exp(alpha[i][:, None] + self.moves[:, 1:] + (score + beta[j, 1:])[None] - z)
                moves[:, 1:] -= p
                g = -p.sum(0)
                y = right.get((a, b), 0)
                if y:
                    g[y - 1] += 1
                segs.append((ids, g))
        y, j = 0, 0
        starts = {i: (e, right[(a, b)]) for e, s in by_end.items() for i, _, a, b, _ in s if (a, b) in right}
        while j < n:
            j, new = starts.get(j, (j + 1, 0))
            moves[y, new] += 1
            y = new
        return moves, segs


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng: random.Random, right: bool) -> str:
    body = _digits(rng, 15)
    last = next(str(d) for d in range(10) if luhn(body + str(d)) == right)
    s = body + last
    sep = rng.choice(["", "", " ", "-"])
    return sep.join(s[i : i + 4] for i in range(0, 16, 4))


def _iban_of(rng: random.Random) -> str:
    land, body = rng.choice(["DE", "FR", "ES", "GB"]), _digits(rng, rng.choice([18, 20]))
    check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
    s = f"{land}{check:02d}{body}"
    return s if rng.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))


def example(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated text and its entities (start, end, label)."""

    def word() -> str:
        return "".join(rng.choice(["an", "er", "the", "on", "st", "le", "ung", "que", "mi", "do"]) for _ in range(rng.randint(1, 4)))

    def filler() -> str:
        return rng.choice(
            [word, word, word, lambda: _digits(rng, rng.randint(1, 11)), lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
             lambda: f"{rng.randint(0, 23)}:{rng.randint(0, 59):02d}", lambda: f"{rng.randint(0, 99)}.{rng.randint(0, 99)}.{rng.randint(0, 99)}", lambda: f"{rng.randint(1, 9999)}.{rng.randint(0, 99):02d}",
             lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 32, 40]))), lambda: _card(rng, False), lambda: f"{rng.randint(256, 999)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 999)}",
             lambda: f"@{word()}{rng.randint(1, 99)}", lambda: f"{word()}@{word()}", lambda: _digits(rng, rng.choice([16, 20, 22])), lambda: f"{_digits(rng, 3)}-{_digits(rng, 4)}-{_digits(rng, 3)}"]
        )()

    def entity() -> tuple[str, str]:
        kind = rng.choice(LABELS[1:])
        if kind == "email":
            return f"{word()}{rng.choice(['', '.', '_'])}{rng.choice(['', str(rng.randint(0, 99)), word()])}x@{word()}{rng.choice(['', str(rng.randint(1, 9))])}.{rng.choice(['com', 'org', 'net', 'de', 'example.com'])}", kind
        if kind == "ip":
            return ".".join(str(rng.randint(0, 255)) for _ in range(4)), kind
        if kind == "card":
            return _card(rng, True), kind
        if kind == "ssn":
            return f"{rng.randint(100, 665)}-{_digits(rng, 2)}-{_digits(rng, 4)}", kind
        if kind == "iban":
            return _iban_of(rng), kind
        a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        return rng.choice([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"+{rng.randint(1, 99)}{a}{b}{c}"]), kind

    text, spans = "", []
    for _ in range(rng.randint(2, 7)):
        if rng.random() < 0.35:
            s, kind = entity()
            cue = next((w for w in rng.sample(sorted(_CUES), 8) if _CUES[w] == kind), "")
            if cue and rng.random() < 0.4:
                text += f"{cue}: " if rng.random() < 0.5 else f"{cue} "
            spans.append((len(text), len(text) + len(s), LABELS.index(kind)))
            text += s + rng.choice(["", "", ",", ".", ")", "###"]) + rng.choice([" ", " ", "\n"])
            text += word() + " "
        else:
            text += filler() + " "
    return text, spans


@lru_cache(1)
def train(examples: int = EXAMPLES, epochs: int = EPOCHS, seed: int = SEED) -> SemiCRF:
    """The field, fitted to `examples` generated texts by AdaGrad; the same arguments give the same model."""
    rng = random.Random(seed)
    data = [example(rng) for _ in range(examples)]
    islands, seen = [], {}
    for text, spans in data:
        for m in _ISLAND.finditer(text):
            right = {(a, b): y for a, b, y in spans if m.start() <= a and b <= m.end()}
            for _, _, a, b in candidates(text, *m.span())[1]:
                for name in segment_features(text, a, b, cue_before(text, m.start())):
                    seen[name] = seen.get(name, 0) + 1
            islands.append((text, *m.span(), right))
    index = {n: i for i, n in enumerate(sorted(n for n, c in seen.items() if c > 2))}
    k = len(LABELS)
    model = SemiCRF(index, np.zeros((len(index), k - 1)), np.zeros((k, k)))
    islands = [(*model.segments(text, lo, hi), right) for text, lo, hi, right in islands]
    islands = [x for x in islands if x[1]]  # the others have one reading
    gw, gm = np.full_like(model.weights, 1e-2), np.full_like(model.moves, 1e-2)
    for _ in range(epochs):
        rng.shuffle(islands)
        for n, found, right in islands:
            moves, segs = model.gradient(n, found, right)
            moves -= 1e-4 * model.moves
            gm += moves**2
            model.moves += 0.2 * moves / np.sqrt(gm)
            if segs:
                ids = np.concatenate([s[0] for s in segs]).astype(np.int64)
                g = np.repeat([s[1] for s in segs], [len(s[0]) for s in segs], 0)
                own, at = np.unique(ids, return_inverse=True)
                total = np.zeros((len(own), k - 1))
                np.add.at(total, at, g)
                total -= 1e-4 * model.weights[own]
                gw[own] += total**2
                model.weights[own] += 0.2 * total / np.sqrt(gw[own])
    return model


def find(text: str | None, model: SemiCRF) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Pattern spans, and all spans: (start, number of the label less one, end). Spans of the field that touch one of the
    patterns' are theirs already."""
    if not text:
        return [], []
    base = base_spans(text)
    # what the patterns have taken, overlapping spans drawn together: islands and spans meet it from left to right
    taken: list[list[int]] = []
    for a, _, b in base:
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    ends = [b for _, b in taken]
    added = []
    for m in _ISLAND.finditer(text):
        lo, hi = m.span()
        first = last = bisect_right(ends, lo)
        covered = 0
        while last < len(taken) and taken[last][0] < hi:
            covered += taken[last][1] - taken[last][0]
            last += 1
        if last > first and covered >= hi - lo - 6:
            continue  # nothing of note is left in it
        for a, b, y in model.decode(text, lo, hi):
            k = bisect_right(ends, a, first, last)
            if k == last or taken[k][0] >= b:
                added.append((a, y - 1, b))
    return base, sorted(base + added)


def find_pii(docs: DataFrame, text_col: str = "text", model: SemiCRF | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (columns in `keep`, or all) plus base and pii: arrays of struct(kind, start, end) in code points, ends
    exclusive, by start and then kind. base has the patterns' spans, pii those and the field's.

    Null and empty texts have none; repeated rows each get theirs; columns named base and pii give way. No shuffle.
    """
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    shared = docs.sparkSession.sparkContext.broadcast(model or train())

    def make():
        field = shared.value

        def named(spans: list) -> list[dict]:
            return [{"kind": LABELS[k + 1], "start": a, "end": b} for a, k, b in spans]

        def apply(texts: list) -> list[list]:
            found = [find(t, field) for t in texts]
            return [[named(b) for b, _ in found], [named(s) for _, s in found]]

        return apply

    return map_texts(docs, text_col, [T.StructField("base", span), T.StructField("pii", span)], make, keep)


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; the other columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(train())

    def make():
        def clean(t: str | None) -> str | None:
            if not t:
                return t
            out, at = [], 0
            for a, k, b in find(t, shared.value)[1]:
                if a >= at:
                    out += [t[at:a], f"[{LABELS[k + 1].upper()}]"]
                at = max(at, b)
            return "".join([*out, t[at:]])

        return lambda texts: [[clean(t) for t in texts]]

    return map_texts(docs, text_col, [T.StructField(text_col, T.StringType())], make).select(*[F.col(f"`{c}`") for c in docs.columns])
