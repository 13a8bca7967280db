"""MinHash near-duplicate detection by a signature-coordinate inverted join.

Each distinct set of word shingles gets a MinHash signature. It is posted under (coordinate, value) pairs. Sets that agree
in at least `matches` of the COORDINATES coordinates share one of the COORDINATES - matches + 1 rarest pairs of each
(prefix filter), so that only this prefix is joined; the other, frequent pairs are never merged as lists but skipped: the
signatures of a candidate are compared directly to count its collisions. Candidates that collide often enough are
confirmed on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PART_ROWS, counted, cut, gathered, slices, small_batches, tidy
from .graph import components

WIDTH = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
COORDINATES = 64
#: Equal coordinates that a candidate needs at PERCENT; a pair of similarity 0.85 has fewer with a probability of 2.4e-6.
MATCHES = 40
#: Word hashes that a task keeps.
CACHE = 200_000
#: Shingles whose hash functions are computed at a time.
CHUNK = 4096
#: Candidates that may be sent to all executors (some 50 bytes each), so that texts need not be shuffled; more are joined.
BROADCAST_NODES = 500_000
#: Postings of a bucket that one task gets, about.
SPLIT = 512
#: Pairs of full sets that a task compares, about.
CONFIRMED = 5_000
#: Nodes that a rare shingle stands in, at most.
RARE = 24

#: Probability, at most, that a pair just similar enough has too few equal coordinates.
MISSED = 2.5e-6

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.Generator(np.random.PCG64(20240607))
_A = (_RNG.integers(0, 1 << 63, COORDINATES, np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, COORDINATES, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def matches_for(percent: int) -> int:
    """Equal coordinates that candidates need for links of `percent`: as many as leave a pair of just that similarity with fewer
    at a probability of at most MISSED. MATCHES for PERCENT and above."""
    p, below = percent / 100, 0.0
    for k in range(MATCHES):
        below += comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)
        if below > MISSED:
            return k
    return MATCHES


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


_WORDS = _Words()


def forget_words() -> None:
    _WORDS.clear()


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a whole text, hashed to 64 bits, in ascending order. A text of fewer words is one
    shingle; a text without words, or null, has none."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(_WORDS) > CACHE:
        _WORDS.clear()
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    out = np.full(n, 0x2545F4914F6CDD1D, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = (out ^ h[i : i + n]) * _MIX
            out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(sh: np.ndarray) -> np.ndarray:
    """MinHash signature of a non-empty set of hashed shingles."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(sh), CHUNK):
            best = np.minimum(best, (sh[i : i + CHUNK] * _A[:, None] + _B[:, None]).min(1))
    return (best >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signed(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, th, n, set_hash, sig): th is a hash of the text; set_hash and sig are null for a document without words."""
    text = F.col(f"`{text_col}`").cast("string")
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), text.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                n, h, sigs = [], [], []
                for t in part.column("t").to_pylist():
                    sh = shingles(t, width)
                    n.append(len(sh))
                    h.append(xxhash.xxh3_128_digest(sh.tobytes()) if len(sh) else None)
                    sigs.append(signature(sh) if len(sh) else None)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), pa.array(n, pa.int64()), pa.array(h, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))], names=["id", "th", "n", "set_hash", "sig"])

    small_batches(docs.sparkSession)
    return source.mapInArrow(tidy(run, forget_words), T.StructType([source.schema["id"], *T._parse_datatype_string("th long, n long, set_hash binary, sig array<int>").fields]))


def _prefix(classes: DataFrame, n_classes: int, matches: int) -> DataFrame:
    """(token, f, node, n, weight): the rarest shared pairs of each class, as far as they lie in its prefix; f: how many classes
    have the pair."""
    tokens = classes.select("node", "n", F.posexplode("sig").alias("c", "v")).select("node", "n", F.expr("shiftleft(cast(c as long), 32) | (v & 4294967295L)").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    met = gathered(tokens.join(shared, "token"), COORDINATES * n_classes, 4 * PART_ROWS)
    own = met.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("own"), F.sum(F.log2("f")).alias("weight"))
    # pairs that no other class has come first in the prefix
    inside = F.size("own") - (matches - 1)
    return own.where(inside > 0).select("node", "n", "weight", F.explode(F.slice("own", 1, inside)).alias("x")).select("x.token", "x.f", "node", "n", "weight")


def _comparable(percent: int) -> str:
    return f"100 * least(na, nb) >= {percent} * greatest(na, nb)"


def _with_bucket(postings: DataFrame, buckets: DataFrame, how: str = "inner") -> DataFrame:
    """postings joined with a table of one row for each bucket. Buckets of many postings are dealt over several tasks, with the
    bucket's row in each."""
    dealt = postings.withColumn("salt", F.pmod(F.xxhash64("node"), F.floor(F.col("f") / SPLIT) + 1))
    each = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("f") / SPLIT)))).drop("f")
    return dealt.join(each, ["token", "salt"], how).drop("salt")


def _leader_pairs(postings: DataFrame, rows: int, percent: int) -> DataFrame:
    """Each member of a bucket with the member nearest to what the bucket has in common."""
    lead = postings.groupBy("token").agg(F.max(F.struct("weight", F.negative("node").alias("m"), "n", "comp")).alias("l"), F.count("*").alias("size"), F.max("f").alias("f"))
    pairs = _with_bucket(postings, gathered(lead.where("size > 1"), rows)).where("comp != l.comp").select(F.negative("l.m").alias("x"), "node", F.col("l.n").alias("na"), F.col("n").alias("nb"))
    return _ordered(gathered(pairs.where(_comparable(percent)), rows))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def _open_buckets(postings: DataFrame, rows: int, least: int = 2) -> DataFrame:
    """(token, f, major): buckets with members in several components and at least `least` members; major is the largest component.

    In a whole bucket of two the pair has been compared (least = 3 leaves it out). Two that are left of a larger bucket, whose
    leader is not among them, have not met.
    """
    groups = gathered(postings.groupBy("token", "comp").agg(F.count("*").alias("k"), F.max("f").alias("f")), rows)
    major = groups.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("g"), F.count("*").alias("comps"), F.sum("k").alias("size"), F.max("f").alias("f"))
    return gathered(major.where(f"comps > 1 and size >= {least}").select("token", "f", F.col("g.comp").alias("major")), rows)


def _center_pairs(postings: DataFrame, rows: int, percent: int) -> DataFrame:
    """Members of a bucket outside of its largest component, with the most central node of that component."""
    centers = postings.groupBy("comp").agg(F.max(F.struct("near", F.negative("node").alias("m"), "n")).alias("c"))
    rest = gathered(_with_bucket(postings, _open_buckets(postings, rows)).where("comp != major"), rows).select("node", F.col("n").alias("nb"), "major").distinct()
    pairs = gathered(rest, rows).join(gathered(centers, rows).withColumnRenamed("comp", "major"), "major").select(F.negative("c.m").alias("x"), "node", F.col("c.n").alias("na"), "nb")
    return _ordered(gathered(pairs.where(_comparable(percent)), rows))


def _spread(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, comp, h, f, abroad): the shingles of each node that others have too, in how many nodes, and whether in nodes of
    several components."""
    each = sets.join(nodes.select("node", "comp"), "node").select("node", "comp", F.explode("set").alias("h"))
    known = each.groupBy("h").agg(F.count("*").alias("f"), (F.min("comp") != F.max("comp")).alias("abroad")).where("f > 1")
    return each.join(known, "h")


def _measures(spread: DataFrame) -> DataFrame:
    """(node, near, hot): how often a node's shingles stand in all nodes, and how many of them are frequent and stand in
    nodes of another component too."""
    return spread.groupBy("node").agg(F.sum("f").alias("near"), F.sum((F.col("abroad") & (F.col("f") > RARE)).cast("long")).alias("hot"))


def _enough(common: str, percent: int) -> str:
    return f"100 * ({common}) >= {percent} * (na + nb - ({common}))"


def _equal(x: str, y: str) -> Column:
    """How many coordinates of two signatures are equal."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda n, e: n + e)


def _other_pairs(postings: DataFrame, rows: int, spread: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that can be similar enough.

    A pair has at most as many frequent shingles in common as the one with fewer has, and its rare ones in common are found
    by joining the rare shingles, whose lists are short. So pairs with rare shingles in common come from that join, with their
    number; all others come from the open buckets: members outside of the largest component with each other and with its
    members, as far as their frequent shingles alone are enough. Two members are compared by their signatures where they meet, in
    the first bucket that they share, and only those that collide often enough leave the join.
    """
    able = postings.where(f"100 * hot >= {percent} * n")
    known = gathered(_with_bucket(able, _open_buckets(able, rows)), rows)
    tokens = known.groupBy("node").agg(F.collect_list("token").alias("own"))
    known = gathered(known.join(tokens.join(classes.select("node", "sig"), "node"), "node"), rows, PART_ROWS // 4)
    as_x = {"node": "x", "comp": "xc", "n": "na", "hot": "ha", "own": "ox", "sig": "sx"}
    rest = known.where("comp != major").select("token", *[F.col(c).alias(n) for c, n in as_x.items()])
    pairs = rest.join(known.select("token", "node", "comp", F.col("n").alias("nb"), F.col("hot").alias("hb"), "major", "own", "sig"), "token")
    able_pair = f"comp != xc and (comp = major or x < node) and {_comparable(percent)} and {_enough('least(ha, hb)', percent)}"
    by_hot = pairs.where(F.expr(able_pair) & (F.array_min(F.array_intersect("ox", "own")) == F.col("token")) & (_equal("sx", "sig") >= matches_for(percent)))
    rare = spread.where(F.col("abroad") & (F.col("f") <= RARE)).select("h", "node", "comp")
    met = rare.select("h", F.col("node").alias("x"), F.col("comp").alias("xc")).join(rare, "h").where("x < node and comp != xc").groupBy("x", "node").agg(F.count("*").alias("k"))
    size = gathered(postings.select("node", "n", "hot").distinct(), rows)
    met = met.join(size.withColumnsRenamed({"node": "x", "n": "na", "hot": "ha"}), "x").join(size.withColumnsRenamed({"n": "nb", "hot": "hb"}), "node")
    by_rare = met.where(f"{_comparable(percent)} and {_enough('least(ha, hb) + k', percent)}")
    return _ordered(by_hot.select("x", "node").unionByName(by_rare.select("x", "node")))


def _colliding(pairs: DataFrame, rows: int, classes: DataFrame, n_classes: int, matches: int) -> DataFrame:
    """The pairs that collide in enough coordinates. In place of merging the long lists of frequent pairs, each is looked up for
    the candidates alone: b stands in the list of (c, v) if its coordinate c is v."""
    sig = classes.select("node", "sig")
    both = gathered(pairs.join(sig.withColumnsRenamed({"node": "a", "sig": "sa"}), "a"), max(rows, n_classes), PART_ROWS // 4).join(sig.withColumnsRenamed({"node": "b", "sig": "sb"}), "b")
    return both.where(_equal("sa", "sb") >= matches).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "set": "sa"}), "a").join(sets.withColumnsRenamed({"node": "b", "set": "sb"}), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, set): full sets of the classes in `nodes`, from the text of one document of each."""
    wanted = classes.join(nodes, "node", "left_semi").select("node", F.col("rep").alias("id"), "set_hash")
    few = wanted.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t")).join(F.broadcast(wanted) if few else wanted, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                nodes, sets = [], []
                for t, node, h in zip(part.column("t").to_pylist(), part.column("node").to_pylist(), part.column("set_hash").to_pylist(), strict=True):
                    sh = shingles(t, width)
                    if xxhash.xxh3_128_digest(sh.tobytes()) == h:  # an id may stand in several rows
                        nodes.append(node)
                        sets.append(sh.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    return source.select("t", "node", "set_hash").mapInArrow(tidy(run, forget_words), "node long, set array<long>")


def _confirm(docs: DataFrame, classes: DataFrame, n_classes: int, pairs: DataFrame, rows: int, id_col: str, text_col: str, width: int, percent: int, sets: DataFrame | None = None) -> DataFrame | None:
    """The pairs that collide often enough and are similar enough as full sets; None if there are none to compare."""
    pairs, seen = counted(gathered(_colliding(pairs, rows, classes, n_classes, matches_for(percent)), max(rows, n_classes)))
    if not seen["n"]:
        return None
    pairs = gathered(pairs, seen["n"])
    if sets is None:
        sets = _sets(docs, classes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), id_col, text_col, width)
    return cut(gathered(_confirmed(pairs, sets, percent), seen["n"], CONFIRMED))


def _found(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, th, comp, n_shingles, component_id, kept) for every row of docs; comp is null for a row without words."""
    if not 64 * percent >= 100 * MATCHES:
        raise ValueError("the match threshold suits similarities of about 0.8 and above")
    rows, seen = counted(_signed(docs, id_col, text_col, width))
    classes, seen = counted(
        gathered(rows.where("set_hash is not null").groupBy("set_hash", "n").agg(F.min("id").alias("rep"), F.any_value("sig").alias("sig")), seen["n"], PART_ROWS // 4)
        .withColumn("node", F.monotonically_increasing_id())
    )
    n_classes = seen["n"]
    postings, seen = counted(gathered(_prefix(classes, n_classes, matches_for(percent)), COORDINATES * n_classes, 4 * PART_ROWS))
    n_postings = seen["n"]
    postings = gathered(postings, n_postings)
    own = (id_col, text_col, width, percent)
    now, comp, sets = postings.withColumn("comp", F.col("node")), None, None
    for step in (_leader_pairs, _center_pairs, _other_pairs):
        if step is not _leader_pairs:
            now = now if comp is None else gathered(postings.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), n_postings)
            opened = _open_buckets(now, n_postings, 3 if step is _center_pairs else 2).drop("major")
            now, seen = counted(gathered(_with_bucket(now, opened, "left_semi"), n_postings))
            n_postings = seen["n"]
            if not n_postings:
                break
            now = gathered(now, n_postings)
            nodes = gathered(now.select("node", "comp").distinct(), n_postings)
            sets = cut(_sets(docs, classes, nodes.select("node"), id_col, text_col, width)) if sets is None else sets
            spread = cut(_spread(nodes, sets))
            now = gathered(now.join(gathered(_measures(spread), n_postings), "node"), n_postings)
            postings = now.drop("comp", "near", "hot")
        n_pairs = n_postings
        if step is _other_pairs:
            pairs, seen = counted(_other_pairs(now, n_postings, spread, classes, percent))
            n_pairs = seen["n"]
            pairs = gathered(pairs, n_pairs)
        else:
            pairs = step(now, n_postings, percent)
        links = _confirm(docs, classes, n_classes, pairs, n_pairs, *own, sets)
        if links is not None:
            known = [] if comp is None else [comp.select(F.col("node").alias("a"), F.col("comp").alias("b"))]
            comp = cut(components(reduce(DataFrame.unionByName, known, links)))
    ids = classes.select("set_hash", "node", "rep")
    placed = (ids.withColumn("comp", F.col("node")) if comp is None else ids.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    least = placed.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = placed.join(least, "comp").select("set_hash", "comp", "component_id")
    out = rows.select("id", "th", "n", "set_hash").join(named, "set_hash", "left")
    component = F.when(F.col("set_hash").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", "th", "comp", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs.

    Rows whose shingle sets have 100 * intersection >= percent * union are linked; component_id is the smallest id that
    links reach, the row's own included. A row without words has no shingles and stands alone. Equal sets are one
    class and are compared once; repeated rows get equal results. A row with a null id is linked with
    equal texts, and through those that have an id with near ones; it takes its group's id (null if there is none) and is not kept. An empty table gives an empty table.

    Members of a bucket are first compared with the bucket's most central member, and those left over with the center of the
    bucket's largest component, which joins the large groups. What is left are pairs from different components; those
    are compared that have enough shingles which others have too to leave room for a link. So no group of copies is compared pair by pair, and no pair that may be linked is left out.
    """
    return _found(docs, id_col, text_col, width, percent).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of docs for each group of near-duplicates, all columns kept as they are: the row with the smallest id, and of
    several such rows any one. An id may stand in rows of several groups; each of these groups keeps its row. Rows without an
    id stay."""
    found = cut(_found(docs, id_col, text_col, width, percent))
    # of several rows with one id in one group, the one with the smallest hash stays
    again = found.where("kept and id is not null").groupBy("id", "comp").agg(F.min("th").alias("own"), F.count("*").alias("k"))
    twice = cut(again.where("k > 1"))
    gone = found.where("not kept and id is not null").select("id", "th")
    repeated = None if twice.isEmpty() else twice
    if repeated is not None:
        near = found.where("kept").join(repeated, (found["id"] == repeated["id"]) & found["comp"].eqNullSafe(repeated["comp"]))
        gone = gone.unionByName(near.where("th != own").select(found["id"], found["th"]))
    dropped, seen = counted(gone.distinct())
    key, hashed = F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    few = seen["n"] <= BROADCAST_NODES  # then texts need not be shuffled
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("id"), hashed.alias("th"))
    out = rows.join(F.broadcast(dropped) if few else dropped, ["id", "th"], "left_anti")
    if repeated is not None:  # the same id and text in several rows: one of them
        same = repeated.select("id", F.col("own").alias("th")).distinct()
        out = out.join(same, ["id", "th"], "left_anti").unionByName(out.join(same, ["id", "th"], "left_semi").dropDuplicates(["id", "th"]))
    return out.select("row.*")
