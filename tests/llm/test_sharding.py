import zlib

import numpy as np

from featherloom.llm import sharding
from tests.llm.brute import jump


def test_as_published():
    keys = np.array([0, 1, 2**63, 2**64 - 1, *np.random.default_rng(1).integers(0, 2**63, 500)], np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]


def test_plan(spark, documents):
    rows = sharding.shard_documents(documents, 16).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert r["grown_shard"] in (r["shard"], 16)
    for s in range(16):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))


def test_only_the_necessary_fraction_moves():
    keys = np.random.default_rng(2).integers(0, 2**63, 100_000).astype(np.uint64)
    a, b = sharding.jump_hash(keys, 16), sharding.jump_hash(keys, 17)
    assert abs((a != b).mean() - 1 / 17) < 0.005 and set(b[a != b]) == {16}


def test_hot_and_odd_keys(spark, table):
    docs = table(*[(7, "same")] * 500, (None, None), (8, ""), extra={"shard": "clash"})
    rows = sharding.shard_documents(docs, 4).collect()
    assert len(rows) == 502 and len({r["shard"] for r in rows if r["doc_id"] == 7}) == 1
    for s in range(4):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    assert sharding.shard_documents(docs.limit(0), 4).count() == 0
    assert sharding.assign_shards(docs, ["doc_id"], 4, 5).columns[-2:] == ["shard", "grown_shard"]
