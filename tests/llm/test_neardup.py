import random

import pytest

from featherloom.llm import neardup
from tests.llm.brute import near_groups, shingles


def groups(df):
    return {r["doc_id"]: r["component_id"] for r in df.collect()}


def variants(seed: int, n: int) -> list[str]:
    """Documents that differ from each other by a few words, chains of them, and unrelated ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(n):
        base = [word() for _ in range(rng.choice([5, 20, 60, 150]))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.4:
                base = w
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, table, seed):
    texts = variants(seed, 60)
    out = neardup.near_duplicates(table(*texts))
    assert groups(out) == near_groups(dict(enumerate(texts)))
    assert {r["doc_id"]: r["n_shingles"] for r in out.collect()} == {i: len(shingles(t)) for i, t in enumerate(texts)}


def test_edges(spark, table):
    docs = table((5, None), (4, ""), (3, "one two"), (9, "ONE  two"), (9, "ONE  two"), (None, "one two"), (2, "a b c d e f"), extra={"kept": "clash", "n_shingles": 1})
    out = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    assert out == {(5, 0, 5, True), (4, 0, 4, True), (3, 1, 3, True), (9, 1, 3, False), (None, 1, 3, False), (2, 2, 2, True)}
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    left = neardup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 2, 3, 4, 5]


def test_large_group_of_near_copies(spark, table):
    """Each differs from the others by one word: all are one group, and no pair of them is compared twice over."""
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join([*base[:i], f"own{i}x{k}", *base[i + 1 :]]) for k in range(3) for i in range(100)]
    assert set(groups(neardup.near_duplicates(table(*texts))).values()) == {0}


def test_unsuitable_threshold(table):
    with pytest.raises(ValueError):
        neardup.near_duplicates(table("a"), percent=50)


def test_two_that_are_left_of_a_bucket_that_others_lead(spark, table):
    """Six groups of near copies hold one passage among other text and lead its buckets, but are like nothing outside of their
    group. Two documents that are little but the passage are left of these buckets, and are a link."""
    passage = [f"p{i}" for i in range(304)]
    texts = [" ".join([*passage, *(f"a{k}" for k in range(21))]), " ".join([*passage, *(f"b{k}" for k in range(21))])]
    for g in range(6):
        rest = [f"g{g}x{i}" for i in range(60)]
        texts += [" ".join([*passage, *rest[:i], f"own{i}", *rest[i + 1 :]]) for i in range(40)]
    got = groups(neardup.near_duplicates(table(*texts)))
    assert got == {0: 0, 1: 0} | {2 + 40 * g + i: 2 + 40 * g for g in range(6) for i in range(40)}


def test_an_id_in_several_groups(spark, table):
    """Of the two texts of id 5, one is a copy of document 1, the other leads a group of its own; id 7 has near copies of its own."""
    w = lambda p: " ".join(f"{p}{i}" for i in range(60))
    docs = table((1, w("a")), (5, w("a")), (5, w("b")), (6, w("b")), (7, w("c")), (7, w("c")), (7, w("c") + " more"), (8, None), (8, None), (None, w("d")))
    left = neardup.drop_near_duplicates(docs)
    got = sorted((r["doc_id"] or 0, (r["text"] or "")[:1]) for r in left.collect())
    assert got == [(0, "d"), (1, "a"), (5, "b"), (7, "c"), (8, "")]


def test_small_tables_stand_in_few_parts(spark, table):
    """The parts of links and postings follow their rows, not the number of shuffle partitions."""
    from featherloom.llm.common import PART_ROWS, counted, gathered

    df, seen = counted(spark.range(1000).repartition(16))
    assert seen["n"] == 1000 and df.rdd.getNumPartitions() == 16
    assert gathered(df, 1000).rdd.getNumPartitions() == 1 and gathered(df, 3 * PART_ROWS).rdd.getNumPartitions() == 3
    assert gathered(df, 10**9).rdd.getNumPartitions() == 16


@pytest.mark.parametrize("seed", [3, 4])
def test_a_group_around_a_text_that_is_not_there(spark, table, seed):
    """Copies of one text with two or three words changed: most are just not similar enough to each other, some are, and none is
    like all. Besides, two that share a changed word."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(260):
        w = list(base)
        for i in rng.sample(range(150), rng.choice([2, 2, 3, 3])):
            w[i] = f"own{k}x{i}" if rng.random() < 0.8 else f"shared{i}"
        texts.append(" ".join(w))
    got = groups(neardup.near_duplicates(table(*texts), percent=80))
    want = near_groups(dict(enumerate(texts)), 80)
    assert got == want and 1 < len(set(want.values()))
