import math
import random

from featherloom.llm import pii
from tests.llm.brute import pii_base


def test_patterns_against_plain_ones():
    rng = random.Random(5)
    alphabet = "0123456789012345..--++@@ab ()é\n"
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == pii_base(text), text


def test_bounded_work_on_long_runs():
    text = "a" * 200_000 + "@" + "1." * 50_000 + "+1" * 20_000 + "1-" * 50_000
    assert isinstance(pii.find(text, pii.train())[1], list)


def test_parts_with_thousands_of_zeros():
    text = f"a {'0' * 6000}.1.1.1 b 1.2.3.{'0' * 5000}7 c 1.2.3.{'9' * 5000}"
    assert [s[:2] for s in pii.base_spans(text) if s[1] == 1] == [(2, 1), (6011, 1)]
    assert pii.find(text, pii.train())[0] == pii.base_spans(text)


def test_blocks_do_not_change_the_best_segmentation():
    rng, model = random.Random(12), pii.train()
    for _ in range(150):
        text, _ = pii.example(rng)
        text = text.replace("\n", " ")
        for m in pii._ISLAND.finditer(text):
            want = model.decode(text, *m.span(), size=10**6)
            assert all(model.decode(text, *m.span(), size=k) == want for k in (1, 2, 7, 20))


def test_very_long_tokens():
    """Megabytes without white space: one number, one word with digits, and base64."""
    model = pii.train()
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rng = random.Random(2)
    blob = "".join(rng.choice(alphabet) for _ in range(1_000_000))
    for text in ("1" * 3_000_000, "a1" * 1_000_000, blob):
        assert pii.find(f"x {text} call +49 170 5551234", model)[0][-1][1] == 3


def test_tens_of_thousands_of_spans():
    """In islands of their own, and in one."""
    model = pii.train()
    for sep in ("\n", " "):
        text = sep.join(f"10.{i % 256}.{i // 256 % 256}.7" for i in range(8_000))
        base, every = pii.find(text, model)
        assert len([s for s in base if s[1] == 1]) == 8_000 and set(base) <= set(every)


def segmentations(n, found):
    """All ways to cut n tokens into single tokens and candidate segments."""
    by = {}
    for s in found:
        by.setdefault(s[0], []).append(s)

    def go(i):
        if i == n:
            yield []
            return
        for rest in go(i + 1):
            yield rest
        for s in by.get(i, []):
            for rest in go(s[1]):
                for y in range(1, len(pii.LABELS)):
                    yield [(s, y), *rest]

    return go(0)


def score(model, n, chosen):
    total, y, i = 0.0, 0, 0
    starts = {s[0]: (s, k) for s, k in chosen}
    while i < n:
        if i in starts:
            s, k = starts[i]
            total += model.moves[y, k] + model.weights[s[4]].sum(0)[k - 1]
            y, i = k, s[1]
        else:
            total += model.moves[y, 0]
            y, i = 0, i + 1
    return total


def test_dynamic_programme_finds_the_best_segmentation():
    model = pii.train()
    for text in ("call 555-123-4567", "x@y.de", "078-05-1120, a", "10.0.0.999 b1"):
        for m in pii._ISLAND.finditer(text):
            n, found = model.segments(text, *m.span())
            if len(found) > 14:
                continue
            best = max(segmentations(n, found), key=lambda c: score(model, n, c))
            kept = [(s[2], s[3], y) for s, y in best if model.weights[s[4]].sum(0)[y - 1] >= pii.MARGIN]
            assert model.decode(text, *m.span()) == kept


def test_gradient_is_of_the_likelihood():
    model = pii.SemiCRF(pii.train().index, pii.train().weights * 0.1, pii.train().moves * 0.1)
    text = "a 12-3456789 b@c"
    n, found = model.segments(text, 2, len(text))
    right = {(found[0][2], found[0][3]): 2}

    def likelihood():
        every = [score(model, n, c) for c in segmentations(n, found)]
        z = math.log(sum(math.exp(x - max(every)) for x in every)) + max(every)
        return score(model, n, [(found[0], 2)]) - z

    if len(found) <= 12:
        moves, _ = model.gradient(n, found, right)
        before = likelihood()
        model.moves = model.moves + 1e-5 * moves
        assert math.isclose((likelihood() - before) / 1e-5, (moves**2).sum(), rel_tol=1e-2)


def test_held_out_spans():
    """Generated texts that the model has not seen: most of their entities are found, and little else."""
    rng, model = random.Random(99), pii.train()
    hit = want = got = 0
    for _ in range(300):
        text, spans = pii.example(rng)
        found = {(a, b) for a, _, b in pii.find(text, model)[1]}
        true = {(a, b) for a, b, _ in spans}
        hit, want, got = hit + len(found & true), want + len(true), got + len(found)
    assert hit / want > 0.9 and hit / got > 0.9


def test_edges(spark, table):
    docs = table(None, "", "mail a@b.co!", "mail a@b.co!", extra={"PII": "clash", "base": 1})
    out = pii.find_pii(docs).orderBy("doc_id").collect()
    assert [[(s.kind, s.start, s.end) for s in r["pii"]] for r in out] == [[], [], [("email", 5, 11)], [("email", 5, 11)]]
    assert pii.find_pii(docs.limit(0)).count() == 0
    assert [r["text"] for r in pii.mask(docs).orderBy("doc_id").collect()] == [None, "", "mail [EMAIL]!", "mail [EMAIL]!"]
