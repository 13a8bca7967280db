"""Evaluators, hold-outs, folds and the balance of classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import evaluators, splitters
from .base import query, r6, table

#: A label and a score of 50 values that knows something of it.
_SCORED = "select l_orderkey, l_linenumber, case when l_quantity > 25 then 1 else 0 end label, floor((l_quantity + l_linenumber * 7) % 50) / 50 probability from lineitem"
_PRED = f"select *, case when probability > 0.5 then 1 else 0 end prediction from ({_SCORED})"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    p = F.floor((q + F.col("l_linenumber") * 7) % 50) / 50
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(q > 25, 1).otherwise(0).alias("label"), p.alias("probability"))
    return df.withColumn("prediction", F.when(F.col("probability") > 0.5, 1).otherwise(0))


_AREAS = f"""c as (select probability s, sum(label) p, count(*) - sum(label) n from t group by 1), r as (select s, sum(p) over w tp, sum(n) over w fp, p, n from c window w as (order by s desc)),
  k as (select sum(p) pos, sum(n) neg from c)"""


@query(f"""with t as ({_PRED}), {_AREAS}, m as (select count(*) filter (where label = 1 and prediction = 1) tp, count(*) filter (where label = 0 and prediction = 0) tn, count(*) filter (where label = 0 and prediction = 1) fp, count(*) filter (where label = 1 and prediction = 0) fn from t),
  a as (select sum(n * (tp - p / 2.0)) / any_value(pos * neg) roc from r, k)
  select tp, tn, fp, fn, round(tp / (tp + fp), 6) "precision", round(tp / (tp + fn), 6) recall, round(2.0 * tp / (2 * tp + fp + fn), 6) f1, round((fp + fn) / (tp + tn + fp + fn), 6) error, round(roc, 6) au_roc from m, a""")
def evaluate_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluators.binary(_scored(spark, sf_dir))
    names = ("tp", "tn", "fp", "fn", "precision", "recall", "f1", "error", "au_roc")
    row = [m[n] if n in ("tp", "tn", "fp", "fn") else round(m[n], 6) for n in names]
    return spark.createDataFrame([row], ", ".join(f"`{n}` {'long' if i < 4 else 'double'}" for i, n in enumerate(names)))


@query(f"""with t as ({_PRED}), {_AREAS} select round(s, 6) threshold, cast(tp as bigint) tp, cast(fp as bigint) fp, round(tp / (tp + fp), 6) "precision", round(tp / pos, 6) recall, round(fp / neg, 6) fpr from r, k""")
def threshold_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = evaluators.binary(_scored(spark, sf_dir))["curves"]
    rows = [[round(t, 6), int(tp), int(fp), round(p, 6), round(r, 6), round(f, 6)] for t, tp, fp, p, r, f in zip(*[c[k] for k in ("thresholds", "tp", "fp", "precision", "recall", "false_positive_rate")], strict=True)]
    return spark.createDataFrame(rows, "threshold double, tp long, fp long, `precision` double, recall double, fpr double")


@query(f"""with t as ({_SCORED}) select cast(least(19, floor(20 * probability)) as integer) bin, count(*) n, cast(sum(label) as bigint) positives, round(avg(probability), 6) mean_score, round(avg(label), 6) rate,
  round(sum((probability - label) ** 2), 4) squared_error, round((least(19, floor(20 * probability)) + 0.5) / 20, 6) center from t group by all""")
def score_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluators.bin_scores(_scored(spark, sf_dir), bins=20)
    return out.select("bin", "n", "positives", r6(F.col("mean_score")).alias("mean_score"), r6(F.col("rate")).alias("rate"), F.round("squared_error", 4).alias("squared_error"), r6(F.col("center")).alias("center"))


_MULTI = "select l_orderkey, cast(l_linenumber % 5 as int) label, case when cast(l_quantity as int) % 3 = 0 then cast(l_quantity as int) % 7 else cast(l_linenumber % 5 as int) end prediction from lineitem"


def _multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n = F.col("l_quantity").cast("int"), (F.col("l_linenumber") % 5).cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", n.alias("label"), F.when(q % 3 == 0, q % 7).otherwise(n).alias("prediction"))


def _weighted_sql(k: int) -> str:
    return f"""select {k} k, round(pr, 6) "precision", round(rc, 6) recall, round(case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0 end, 6) f1, round(1 - rc, 6) error from
  (select sum(n * case when pn > 0 then tp / pn else 0 end) / sum(n) pr, sum(tp) / sum(n) rc from (select y, count(*) n, count(*) filter (where y = p) tp, (select count(*) from t{k} b where b.p = a.y) pn from t{k} a group by y))"""


@query(f"""with t as ({_MULTI}), o as (select label, row_number() over (order by count(*) desc, label) i from t group by 1), {", ".join(f"t{k} as (select case when label in (select label from o where i <= {k}) then label else -1 end y, prediction p from t)" for k in (2, 5))}
  {_weighted_sql(2)} union all {_weighted_sql(5)}""")
def evaluate_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted figures among the 2 and the 5 most frequent labels (there are 5)."""
    rows = [[m["k"], *[round(m[n], 6) for n in ("precision", "recall", "f1", "error")]] for m in evaluators.multi_top_k(_multi(spark, sf_dir), ks=(2, 5))]
    return spark.createDataFrame(rows, "k int, `precision` double, recall double, f1 double, error double")


@query(f"""with t as (select label::double y, prediction::double p, count(*) n from ({_MULTI}) group by all), s as (select 'label' side, y category, sum(n) over (partition by y) total, coalesce(sum(n) filter (where y = p) over (partition by y), 0) correct, p other, n, y <> p wrong from t
  union all select 'prediction', p, sum(n) over (partition by p), coalesce(sum(n) filter (where y = p) over (partition by p), 0), y, n, y <> p from t), r as (select *, row_number() over (partition by side, category order by n desc, other) i from s where wrong)
  select side, category, cast(total as bigint) total, cast(correct as bigint) correct, other, n from r where i <= 2""")
def misclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluators.misclassified(_multi(spark, sf_dir), most=2)


_PROBS = """select label::int label, list_transform(embedding[1:4], lambda x: abs(x)::double / (abs(embedding[1])::double + abs(embedding[2])::double + abs(embedding[3])::double + abs(embedding[4])::double)) p from embeddings"""


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four scores a row; most labels are none of the four classes."""
    first = F.slice("embedding", 1, 4)
    total = F.aggregate(first, F.lit(0.0), lambda a, x: a + F.abs(x).cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("label"), F.transform(first, lambda x: F.abs(x).cast("double") / total).alias("probability"))


@query(f"""with t as ({_PROBS}), r as (select label, list_max(p) best, coalesce(p[label + 1], 0) mine, case when label < 4 then 1 + len(list_filter([1, 2, 3, 4], lambda i: p[i] > p[label + 1] or (p[i] = p[label + 1] and i <= label))) else 99 end place from t),
  o as (select n.n top_n, h.h threshold, place <= n.n and mine >= h.h ok, best >= h.h reached from r, (select unnest([1, 3]) n) n, (select unnest([0.0, 0.25, 0.5, 0.75]) h) h)
  select top_n, cast(threshold as double) threshold, count(*) filter (where ok) correct, count(*) filter (where not ok and reached) incorrect, count(*) filter (where not ok and not reached) no_prediction from o group by 1, 2""")
def thresholds_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluators.thresholds_multi(_probabilities(spark, sf_dir), top_ns=(1, 3), thresholds=[0.0, 0.25, 0.5, 0.75])
    return spark.createDataFrame([list(r.values()) for r in rows], "top_n int, threshold double, correct long, incorrect long, no_prediction long")


@query(f"""with t as ({_PROBS}), c as (select label from t group by 1 order by count(*) desc, label limit 3), r as (select label, list_position(p, list_max(p)) - 1 prediction, list_max(p) best from t)
  select h.h::double threshold, label::double label, prediction::double prediction, count(*) n from r, (select unnest([0.0, 0.2, 0.4, 0.6, 0.8]) h) h where best >= h.h and label in (select label from c) and prediction in (select label from c) group by all""")
def confusion_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _probabilities(spark, sf_dir)
    return evaluators.confusion_by_threshold(df.withColumn("prediction", F.array_position("probability", F.array_max("probability")) - 1), classes=3)


@query("""select round(avg(-ln(case when label = 1 then p else 1 - p end)), 6) log_loss from (select label, (probability + 0.01) / 1.02 p from (""" + _SCORED + "))")
def log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("probability") + 0.01) / 1.02
    df = _scored(spark, sf_dir).select("label", F.array(1 - p, p).alias("probability"))
    return spark.createDataFrame([[round(evaluators.log_loss(df), 6)]], "log_loss double")


_REG = "select l_orderkey, l_linenumber, l_extendedprice / 1000 label, l_quantity * 1.5 prediction from lineitem"


def _regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("label"), (F.col("l_quantity") * 1.5).alias("prediction"))


@query(f"""with t as ({_REG}) select round(sqrt(avg((label - prediction) ** 2)), 6) rmse, round(avg((label - prediction) ** 2), 4) mse, round(avg(abs(label - prediction)), 6) mae, round(1 - avg((label - prediction) ** 2) / var_pop(label), 6) r2 from t""")
def evaluate_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluators.regression(_regression(spark, sf_dir))
    return spark.createDataFrame([[round(m["rmse"], 6), round(m["mse"], 4), round(m["mae"], 6), round(m["r2"], 6)]], "rmse double, mse double, mae double, r2 double")


@query(f"""with t as (select 100 * (prediction - label) / greatest(abs(label), 0.001) e from ({_REG})) select cast(case when e >= 100 then 21 when e < -100 then 0 else floor((e + 100) / 10) + 1 end as integer) bin, count(*) n from t group by 1""")
def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluators.error_histogram(_regression(spark, sf_dir)).select("bin", "n")


@query("""with d as (select cast(ts as date) d, sum(value) y from events group by 1), s as (select *, lag(y) over (order by d) p, row_number() over (order by d) i from d), t as (select *, lead(y, 7) over (order by d) later from s where i > 1), n as (select count(*) n from t)
  select round(2 * sum(abs(y - p) / (abs(y) + abs(p))) / any_value(n), 6) smape, round(sum(abs(y - later)) / (any_value(n) - 7), 4) seasonal_error, round(sum(abs(y - p)) / (sum(abs(y - later)) / (any_value(n) - 7) * any_value(n)), 6) mase from t, n""")
def evaluate_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yesterday's sum as the forecast of a day's."""
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.sum("value").alias("y"))
    before = days.select(F.date_add("d", 1).alias("d"), F.col("y").alias("p"))
    m = evaluators.forecast(days.join(before, "d"), ["d"], "y", "p", season=7)
    return spark.createDataFrame([[round(m["smape"], 6), round(m["seasonal_error"], 4), round(m["mase"], 6)]], "smape double, seasonal_error double, mase double")


_UNIT = "(('0x' || substr(md5(cast(doc_id as varchar) || '#42'), 1, 8))::bigint / 4294967296.0)"


@query(f"""select doc_id, {_UNIT} < 0.1 test, cast(floor({_UNIT} * 3) as integer) fold from labels""")
def holdout_and_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "labels").select("doc_id")
    train, test = splitters.hold_out(df, F.col("doc_id"))
    return splitters.folds(train.withColumn("test", F.lit(False)).unionByName(test.withColumn("test", F.lit(True))), F.col("doc_id")).select("doc_id", "test", "fold")


@query(f"""with t as (select doc_id, quality, {_UNIT} u from labels), c as (select least(sum(quality), count(*) - sum(quality)) small, greatest(sum(quality), count(*) - sum(quality)) big, case when sum(quality) < count(*) - sum(quality) then 1 else 0 end rare from t),
  f as (select *, case when 3 * small * 0.7 < 0.3 * big then 3 when 2 * small * 0.7 < 0.3 * big then 2 else 1 end up from c), g as (select *, (small * up / 0.3 - small * up) / big down from f)
  select doc_id, quality from t, g where quality <> rare and u < down union all select doc_id, quality from t, g, range(1, 4) r(i) where quality = rare and i <= up""")
def balanced_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rarer class repeated and the other one sampled until it makes up three tenths."""
    out, _ = splitters.DataBalancer(fraction=0.3).prepare(table(spark, sf_dir, "labels").select("doc_id", "quality"), F.col("doc_id"), "quality")
    return out


@query("""with n as (select p_brand, count(*) c from part group by 1), k as (select p_brand from n where c / (select sum(c) from n) >= 0.03 order by c desc, p_brand limit 5) select p_partkey, p_brand from part where p_brand in (select p_brand from k)""")
def cut_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent labels with at least a share of the rows."""
    out, _ = splitters.DataCutter(max_labels=5, min_fraction=0.03).prepare(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("p_partkey"), "p_brand")
    return out
