"""Workflows that are saved, loaded, warm-started and run; functions of one's own and wrapped stages; every learner and selector."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.events import CutOff, EventFeature
from ..plans import features as G
from ..plans import models
from ..plans.local import LocalScorer
from ..plans.runner import Runner, RunParams
from ..sources import readers
from ..sources.avro import load_avro, save_avro, stream_avro
from .base import event_ms, query, r6, shared_folder, table


def _balances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[G.Feature]]:
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    balance = G.raw("balance", "Real")
    return df, [(balance * 2.0 + 1.0).apply("alias", name="scaled"), balance.apply("z_normalize", name="normal")]


@query("""select cast(c_custkey as varchar) as key, round(c_acctbal * 2 + 1, 6) scaled, round((c_acctbal - avg(c_acctbal) over ()) / stddev_samp(c_acctbal) over (), 6) normal from customer""")
def workflow_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted workflow is written, read again, and scores as before."""
    df, results = _balances(spark, sf_dir)
    path = shared_folder(spark, "workflow")
    G.Workflow(results).train(df).save(spark, path)
    return G.WorkflowModel.load(spark, path).score(df).select("key", *[r6(F.col(c)).alias(c) for c in ("scaled", "normal")])


@query("""with s as (select avg(c_acctbal) m, stddev_samp(c_acctbal) s from customer where c_acctbal > 1000) select cast(c_custkey as varchar) as key, round((c_acctbal - m) / s, 6) normal, round((c_acctbal - m) / s * 10, 6) tenfold from customer, s""")
def workflow_warm_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger workflow takes over the stage that a smaller one has learned from other rows."""
    df, (_, normal) = _balances(spark, sf_dir)
    before = G.Workflow([normal]).train(df.where("balance > 1000"))
    tenfold = (normal * 10.0).apply("alias", name="tenfold")
    return G.Workflow([normal, tenfold], reuse=before).train(df).score(df).select("key", *[r6(F.col(c)).alias(c) for c in ("normal", "tenfold")])


@query("""select cast(c_custkey as varchar) as key, round(c_acctbal * 2 + 1, 6) scaled from customer""")
def compute_up_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature of a graph and what it needs, nothing else."""
    df, results = _balances(spark, sf_dir)
    out = G.Workflow(results).compute_up_to(results[0], df)
    return out.select("key", r6(F.col("scaled")).alias("scaled"))


@query("""select 'train' run, cast(null as bigint) as n, true as good union all select 'score', count(*), true from orders union all select 'features', count(*), true from orders union all select 'evaluate', null, true""")
def runner_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of run of an application: rows written, and whether the model is good."""
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), urgent.cast("double").alias("label"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))
    label = G.raw("label", "RealNN", response=True)
    vector = G.auto_encode([G.raw("priority", "PickList"), G.raw("price", "Real") / 1000.0], min_support=1)
    selector = models.binary_selector(["DecisionTreeClassifier"], {"DecisionTreeClassifier": {"maxDepth": [3]}}, folds=2)
    base = shared_folder(spark, "run")
    runner = Runner(G.Workflow([G.select_model(label, vector, selector)]), lambda s, p: df)
    params = RunParams(model_location=f"{base}/model", write_location=f"{base}/out", metrics_location=f"{base}/metrics")
    rows = []
    for kind in ("train", "score", "evaluate", "features"):
        out = runner.run(spark, kind, params)
        rows.append((kind, out.get("rows"), bool(out.get("au_pr", 1.0) > 0.99)))
    return spark.createDataFrame(rows, "run string, n long, good boolean")


@query("""with t as (select c_custkey k, c_acctbal b, c_mktsegment s, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) clean from customer), n as (select clean, row_number() over (order by count(*) desc, clean) i from t group by 1)
  select cast(k as varchar) as key, round(floor(b / 100), 6) hundreds, round(sqrt(abs(b)), 6) root, i as slot from t join n on n.clean = t.clean""")
def local_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted workflow as a function of one record, without Spark: here in the tasks of a map over all records."""
    df, _ = _balances(spark, sf_dir)
    balance = G.raw("balance", "Real")
    made = [(balance / 100.0).floor().apply("alias", name="hundreds"), balance.apply("abs").sqrt().apply("alias", name="root"), G.raw("segment", "PickList").pivot(min_support=1).apply("alias", name="v")]
    score = LocalScorer(G.Workflow(made).train(df))

    def run(batches):
        for pdf in batches:
            got = [score(r) for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records")]
            yield pd.DataFrame({"key": pdf["key"], "hundreds": [g["hundreds"] for g in got], "root": [g["root"] for g in got], "slot": [g["v"].index(1.0) + 1 for g in got]})

    return df.mapInPandas(run, "key string, hundreds double, root double, slot long").select("key", r6(F.col("hundreds")).alias("hundreds"), r6(F.col("root")).alias("root"), "slot")


def _squared(a: Column) -> Column:
    return a * a


def _net(price: Column, discount: Column) -> Column:
    return price * (1 - discount)


def _gross(price: Column, discount: Column, tax: Column) -> Column:
    return price * (1 - discount) * (1 + tax)


def _unit(price: Column, discount: Column, tax: Column, quantity: Column) -> Column:
    return F.sqrt(price * (1 - discount) * (1 + tax) / quantity)


def _greatest(first: Column, *others: Column) -> Column:
    return F.greatest(first, *others)


def _low(a: Column) -> Column:
    return F.least(a, F.lit(10.0))


def _rest(a: Column) -> Column:
    return F.greatest(a - 10.0, F.lit(0.0))


@query("""select cast(l_orderkey as varchar) as key, l_linenumber as line, round(l_quantity * l_quantity, 6) squared, round(l_extendedprice * (1 - l_discount), 6) net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) gross,
  round(sqrt(l_extendedprice * (1 - l_discount) * (1 + l_tax) / l_quantity), 6) unit, round(greatest(l_quantity, l_discount, l_tax), 6) most, round(least(l_quantity, 10), 6) low, round(greatest(l_quantity - 10, 0), 6) rest from lineitem""")
def own_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of one's own over one, two, three, four and any number of features, and two outputs of one feature."""
    names = {"price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "quantity": "l_quantity"}
    df = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("key"), F.col("l_linenumber").alias("line"), *[F.col(c).alias(n) for n, c in names.items()])
    price, discount, tax, quantity = (G.raw(n, "Real") for n in names)
    made = [
        G.raw("line", "Integral").apply("alias", name="number"), quantity.map(_squared, name="squared"), price.map(_net, discount, name="net"), price.map(_gross, discount, tax, name="gross"),
        price.map(_unit, discount, tax, quantity, name="unit"), quantity.map(_greatest, discount, tax, name="most"), quantity.map(_low, name="low"), quantity.map(_rest, name="rest"),
    ]
    out = G.Workflow(made).train(df).score(df)
    return out.select("key", F.col("number").alias("line"), *[r6(F.col(f.name)).alias(f.name) for f in made[1:]])


@query("""with w as (select p_partkey k, string_split(p_name, ' ') w, p_brand m from part), r as (select m, row_number() over (order by count(*) desc, m) - 1 i from w group by 1)
  select cast(k as varchar) as key, array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), ',') as pairs, i::double as idx from w join r on r.m = w.m""")
def wrapped_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of Spark ML in a graph: a transformer and an estimator."""
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.split("p_name", " ").alias("words"), F.col("p_brand").alias("maker"))
    out = G.Workflow([G.raw("words", "TextList").apply("ml_ngram", name="pairs"), G.raw("maker", "PickList").apply("string_index", name="idx")]).train(df).score(df)
    return out.select("key", F.array_join("pairs", ",").alias("pairs"), "idx")


#: Every learner with options that suit the small problem below.
_LEARNERS = {
    "LogisticRegression": {"regParam": 0.0, "maxIter": 100}, "RandomForestClassifier": {"numTrees": 10, "maxDepth": 4, "seed": 1}, "GBTClassifier": {"maxIter": 5, "maxDepth": 3, "seed": 1},
    "DecisionTreeClassifier": {"maxDepth": 4}, "LinearSVC": {"regParam": 0.0, "maxIter": 50}, "NaiveBayes": {"modelType": "gaussian"}, "MultilayerPerceptronClassifier": {"layers": [2, 3, 2], "maxIter": 100, "seed": 1},
    "XGBoostClassifier": {}, "LinearRegression": {"regParam": 0.0}, "RandomForestRegressor": {"numTrees": 10, "maxDepth": 6, "seed": 1}, "GBTRegressor": {"maxIter": 10, "maxDepth": 4, "seed": 1},
    "DecisionTreeRegressor": {"maxDepth": 6}, "GeneralizedLinearRegression": {"family": "gaussian"}, "XGBoostRegressor": {},
}


@query("select unnest([" + ", ".join(f"'{n}'" for n in _LEARNERS) + "]) learner, (select count(*) from part) n, true as good")
def learners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every classifier finds a class that a threshold decides, and every regressor a line: nine tenths right, or of the variance."""
    size = F.col("p_size") / 50
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.array(size, F.col("p_retailprice") / 2000).alias("v"), (size > 0.5).cast("double").alias("y"), (size * 3 + 1).alias("z"))
    rows = None
    for name, params in _LEARNERS.items():
        classes = "Class" in name or name in models.CLASSIFIERS
        label = "y" if classes else "z"
        model = models.fit(name, params, models.ready(df, "v", label))
        p = F.element_at("prediction", F.lit("prediction"))
        got = models.predict(model, df, "v")
        right = F.avg((p == F.col("y")).cast("double")) if classes else 1 - F.avg((p - F.col("z")) ** 2) / F.var_pop("z")
        row = got.agg(F.lit(name).alias("learner"), F.count(p).alias("n"), (right >= 0.9).alias("good"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query("""select 'binary' kind, (select count(*) from part) n, true as good union all select 'multi', (select count(*) from part), true union all select 'regression', (select count(*) from part), true""")
def selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three kinds of selection: candidates compared, the best refitted on all prepared rows, and held-out rows scored."""
    size = F.col("p_size")
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.array(size / 50, F.col("p_retailprice") / 2000).alias("v"), (size > 25).cast("double").alias("binary"), F.floor(size / 17).cast("double").alias("multi"), (size * 3.0).alias("regression"))
    tree = {"maxDepth": [2, 5]}
    made = {
        "binary": models.binary_selector(["DecisionTreeClassifier"], {"DecisionTreeClassifier": tree}, folds=2),
        "multi": models.multi_selector(["DecisionTreeClassifier"], {"DecisionTreeClassifier": tree}, folds=1),
        "regression": models.regression_selector(["LinearRegression", "DecisionTreeRegressor"], {"LinearRegression": {"regParam": [0.0]}, "DecisionTreeRegressor": tree}, folds=2),
    }
    rows = []
    for kind, selector in made.items():
        chosen = selector.fit(df, "v", kind, F.col("key"))
        best = chosen.holdout_score > 0.9 if kind == "binary" else chosen.holdout_score < 0.1
        n = chosen.transform(df, "v").where(F.element_at("prediction", F.lit("prediction")).isNotNull()).count()
        rows.append((kind, n, bool(best)))
    return spark.createDataFrame(rows, "kind string, n long, good boolean")


@query("""select c_custkey, c_name, c_acctbal, c_mktsegment from customer""")
def csv_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV and read with types cast to a schema, then written with its schema and read again."""
    names = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]
    source = table(spark, sf_dir, "customer").select(*names)
    base = shared_folder(spark, "csv")
    source.write.csv(f"{base}/csv", header=True)
    texts = spark.read.csv(f"{base}/csv", header=True)
    typed = readers.cast_columns(texts, source.schema)
    readers.save_with_schema(typed, f"{base}/typed")
    return readers.load_with_schema(spark, f"{base}/typed")


@query("""select c_custkey, c_name, c_acctbal, c_mktsegment from customer""")
def avro_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as Avro files and read again."""
    path = shared_folder(spark, "avro")
    save_avro(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return load_avro(spark, path)


@query("""select cast(user_id as varchar) as key, round(sum(value) filter (where (epoch_us(ts) // 1000) < 1705363200000), 6) before_sum, count(*) filter (where (epoch_us(ts) // 1000) >= 1705363200000) as after_n from events group by user_id""")
def avro_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in Avro files, aggregated around a cut-off."""
    path = shared_folder(spark, "avro")
    save_avro(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), path)
    reader = readers.avro(path, F.col("user_id")).aggregate(event_ms(), CutOff.unix_epoch(1_705_363_200_000), F.col("event_id"))
    out = reader.generate(spark, [EventFeature("before_sum", F.col("value"), "Real"), EventFeature("after_n", F.lit(1), "Integral", lambda x, t, i: F.count(x), response=True)])
    return out.select("key", r6(F.col("before_sum")).alias("before_sum"), "after_n")


@query("""select cast(event_id as varchar) as key, round(value, 6) as v from events""")
def avro_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Avro files that are read as a stream."""
    base = shared_folder(spark, "avro")
    source = table(spark, sf_dir, "events").select("event_id", "value")
    save_avro(source, f"{base}/in")
    stream = stream_avro(spark, f"{base}/in", source.schema).select(F.col("event_id").cast("string").alias("key"), r6(F.col("value")).alias("v"))
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query(f"""with t as (select item_id, list_filter(regexp_extract_all(lower(text), '[\\pL\\pN]+'), lambda x: x not in ({", ".join(f"'{w}'" for w in text.STOP_WORDS)})) k from benchmark) select item_id, cast(len(k) as bigint) as n, 1.0::double as alike from t""")
def similar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text is like itself by n-grams."""
    df = table(spark, sf_dir, "benchmark")
    return df.select("item_id", F.size(text.tokenize(F.col("text"))).cast("long").alias("n"), r6(text.ngram_similarity(F.col("text"), F.concat(F.lit("  "), "text"))).alias("alike"))
