"""Steps that grew faster than their input, or went by a part of it."""

from pyspark.sql import functions as F

from featherloom.functions import net
from featherloom.operators import frames, scalers
from featherloom.operators import vectorizers as V
from featherloom.plans import features as G
from featherloom.plans import insights, models, quality, splitters


def test_region_is_looked_up_once_and_as_before(spark):
    texts = ["DE", " de ", "Germny", "united kingdom", "Untied Sates", "", "x", None, "Brasil", "austra", "Nigeria", "zz"]

    def pairs(x):
        return {x[i : i + 2] for i in range(max(len(x) - 1, 1))}

    def plain(x):
        if x is None:
            return "US"
        x = x.strip().upper()
        own = pairs(x)
        found = min((-len(own & pairs(n.upper())) / len(own | pairs(n.upper())), k) for k, (_, n) in net.REGIONS.items())
        return x if x in net.REGIONS else found[1] if found[0] < 0 else "US"

    df = spark.createDataFrame([(t,) for t in texts], "r string")
    assert [r[0] for r in df.select(net.region_of(F.col("r"))).collect()] == [plain(t) for t in texts]
    names = spark.createDataFrame([(n, k) for k, (_, n) in net.REGIONS.items()], "r string, k string")
    assert names.where(net.region_of(F.col("r")) != F.col("k")).count() == 0
    plan = df.select(net.parse_phone(F.concat(F.lit("301234567"), F.col("r")), F.col("r")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect(") == 1 and "array_union(" not in plan


def test_sanity_check_goes_by_all_rows(spark):
    n = 1_200_000
    df = spark.range(n).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    found, _ = quality.sanity_check(V.encode(df, [V.fit(df, "numeric", ["x"], "Real", track_nulls=False)]), "features", "y")
    assert (found[0].mean, found[0].least, found[0].greatest) == ((n - 1) / 2, 0.0, n - 1.0)
    assert abs(found[0].variance / (n * (n + 1) / 12) - 1) < 1e-9


def test_sampled_rows_are_in_all_folds(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 2).cast("double").alias("y"), F.array((F.col("id") % 2).cast("double")).alias("v"))
    tree = {"DecisionTreeClassifier": {"maxDepth": [1]}}
    # a sample of an eighth of the rows, which had all been in the first fold
    chosen = models.binary_selector(["DecisionTreeClassifier"], tree, splitter=splitters.DataBalancer(max_rows=340), folds=2).fit(df, "v", "y", F.col("key"))
    assert chosen.validation_score == 1.0 and 0.11 < chosen.preparation["down"] < 0.14
    parts = models.Validation(folds=4).parts(splitters.sampled(df, F.col("key"), 0.1), F.col("key"))
    assert all(test.count() > 40 for _, test in parts)


def test_all_rows_train(spark):
    df = spark.range(1_100_000).select("id", (F.col("id") % 2).alias("y"))
    for splitter in (splitters.DataSplitter(), splitters.DataBalancer(), splitters.DataCutter()):
        assert splitter.prepare(df, F.col("id"), "y")[0].count() == 1_100_000


def test_percentiles_are_exact(spark):
    # 60000 distinct values, a tenth of the rows one value, and nulls
    x = F.when(F.col("id") % 10 == 0, 777.0).when(F.col("id") % 11 != 0, F.pow((F.col("id") * 7919 % 60013) / 100.0, 2))
    df = spark.range(60_000).select(x.alias("x"))
    values = sorted(r["x"] for r in df.where("x is not null").collect())
    n = len(values)
    want = sorted({values[-(-n * i // 100) - 1] for i in range(1, 100)})
    assert scalers.fit_percentiles(df, F.col("x"), 100) == want
    ranks = [1, 2, n // 3, n // 3, n - 1, n]
    # with quantiles that are far off
    assert scalers.at_ranks(df, F.col("x"), lambda _: ranks, 3) == [values[r - 1] for r in ranks]
    assert scalers.at_ranks(df, F.col("x"), lambda _: ranks, 10_000) == [values[r - 1] for r in ranks]
    assert scalers.fit_percentiles(df.limit(0), F.col("x")) == []


def test_median_is_found_without_all_values_in_one_task(spark):
    df = spark.range(1001).select((F.col("id") * 7919 % 1009).alias("x"))
    assert frames.median(df, F.col("x")) == df.agg(F.median("x")).first()[0]
    assert frames.median(df.where("x <> 0"), F.col("x")) == df.where("x <> 0").agg(F.median("x")).first()[0]
    assert frames.median(df.limit(0), F.col("x")) is None


def test_vectors_between_stages_stay_sparse(spark):
    df = spark.createDataFrame([("a", ["x", "y", "x"]), ("b", ["y"]), ("c", None)], "key string, words array<string>")
    model = G.Workflow([G.raw("words", "TextList").tfidf(1 << 14, name="v")]).train(df)
    out = model.transform(df, sparse=True).select("key", F.size(G.stored_values("v")).alias("n"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("all"), F.aggregate(G.stored_values("v"), F.lit(0.0), lambda a, x: a + x).alias("stored"))
    rows = {r["key"]: r for r in out.collect()}
    assert [rows[k]["n"] for k in "abc"] == [2, 1, 0] and all(r["all"] == r["stored"] for r in rows.values()) and rows["a"]["stored"] > rows["b"]["stored"] > 0
    assert set(model.transform(df).columns) == {"key", "words", "v", *[s.name for layer in model.stages for s in layer]}
    plan = model.transform(df).select("v")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_to_vector" not in plan and plan.count("UDF(") <= 3


def test_topics_are_fitted_on_tasks_of_bounded_rows(spark):
    df = spark.range(500_000).coalesce(1)
    sizes = [r[0] for r in G.spread(df, 50_000).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 500_000 and max(sizes) <= 60_000
    assert G.spread(df, 500_000) is df


def test_slots_that_move_alike_go_by_their_place(spark):
    """Two slots of equal weight but for the rounding of a fit, the later one's name coming first."""
    rows = [(str(i), float(i % 7 + 1), float(i % 7 + 1 if i % 2 else i % 5 + 1)) for i in range(140)]
    df = spark.createDataFrame(rows, "key string, z double, a double").withColumn("y", F.col("z") * 3.3 - F.col("a") * (3.3 + 2e-11) + 5)
    vectors = V.encode(df, [V.fit(df, "numeric", ["z", "a"], "Real", track_nulls=False)])
    model = models.fit("LinearRegression", {"regParam": 0.0}, models.ready(vectors, "features", "y"))
    top = insights.leave_one_out(model, vectors.where("z = a"), "features", "key", top_k=1).select(F.inline("insights"))
    assert {r["slot"] for r in top.collect()} == {"z"}
