import random

from tests.llm.brute import overlap
from featherloom.llm import decontam


def items_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_against_brute_force(spark, table):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "B", "c1", "é", "dd"])
    texts = ["".join(word() + rng.choice([" ", ", ", "-", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    items = [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 7, 8, 9, 12)] + ["", "?!", None]
    want = {i: overlap(t, {str(k): x for k, x in enumerate(items)}) for i, t in enumerate(texts)}
    for block in (1 << 20, 8):  # one automaton, and a block for every item
        out = decontam.find_overlap(table(*texts), items_of(spark, items), block_bytes=block)
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["hit_items"]) for r in out.collect()} == want


def test_offsets_point_into_the_original(spark, table):
    text = "Éa,  ONE two\tthree. 😀 four"
    out = decontam.find_overlap(table(text), items_of(spark, ["one TWO three"])).first()
    assert [text[s.start : s.end] for s in out["hit_spans"]] == ["ONE two\tthree"]


def test_edges(spark, table):
    long = "x " * 300_000 + "p q r"
    docs = table(None, "", long, "p q r", "p q r", extra={"n_words": "clash", "__row": 1})
    out = decontam.find_overlap(docs, items_of(spark, ["p q r", None]))
    assert [(r["n_words"], r["n_hit"]) for r in out.orderBy("doc_id").collect()] == [(0, 0), (0, 0), (300_003, 3), (3, 3), (3, 3)]
    blocks = decontam.find_overlap(docs, items_of(spark, ["p q r", None, "q"]), block_bytes=1)
    assert [(r["n_words"], r["n_hit"], r["hit_items"], len(r["hit_spans"])) for r in blocks.orderBy("doc_id").collect()] == [(0, 0, [], 0), (0, 0, [], 0), (300_003, 3, ["0", "2"], 1), *[(3, 3, ["0", "2"], 1)] * 2]
    assert blocks.columns == out.columns and blocks.dtypes == out.dtypes
    assert {r["n_hit"] for r in decontam.find_overlap(docs, items_of(spark, ["x"]).limit(0)).collect()} == {0}
    assert decontam.find_overlap(docs.limit(0), items_of(spark, ["x"])).count() == 0


def test_contaminated_rows_go(spark, table):
    docs = table("one two", "one", "else")
    assert sorted(r["doc_id"] for r in decontam.drop_contaminated(docs, items_of(spark, ["one", "two"])).collect()) == [1, 2]
    assert decontam.drop_contaminated(docs, items_of(spark, ["one", "two"])).columns == docs.columns
