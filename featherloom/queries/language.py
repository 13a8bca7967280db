"""Language operators that learn or look up: languages, entities, names, term weights, and frame helpers."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import frames, names
from ..plans import features as G
from .base import query, r6, table


def _listed(language: str) -> str:
    """The stop words that Spark brings for a language, as a list of SQL; read from its jar, for there is no session yet."""
    import glob
    import os
    import zipfile

    import pyspark

    jar = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))[0]
    with zipfile.ZipFile(jar) as z:
        words = z.read(f"org/apache/spark/ml/feature/stopwords/{text.LANGUAGES[language]}.txt").decode().split()
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _languages_sql() -> str | None:
    codes = ("de", "en", "es", "fr")
    try:
        hits = ", ".join(f"len(list_filter(w, lambda x: x in ({_listed(k)}))) {k}" for k in codes)
    except (IndexError, OSError, KeyError):  # a Spark that is installed otherwise
        return None
    best = f"greatest({', '.join(codes)})"
    return rf"""with t as (select doc_id, regexp_extract_all(lower(text), '[\pL'']+') w from documents), h as (select doc_id, {hits} from t)
  select doc_id, case when {best} > 0 then case {best} {" ".join(f"when {k} then '{k}'" for k in codes)} end end as language, case when {best} > 0 then round({best} / ({" + ".join(codes)}), 6) end confidence from h"""


@query(_languages_sql())
def detect_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest language of each document by the stop words of fourteen languages."""
    found = table(spark, sf_dir, "documents").select("doc_id", text.detect_languages(F.col("text"), ("de", "en", "es", "fr")).alias("m"))
    best = F.array_min(F.transform(F.map_entries("m"), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return found.select("doc_id", best["k"].alias("language"), r6(-best["v"]).alias("confidence"))


@query(r"""with t as (select doc_id, regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b') d, regexp_extract_all(text, '\b\d{1,2}:\d{2}(?::\d{2})?\b') h, regexp_extract_all(text, '\b\d+(?:[.,]\d+)?\s?%') p from documents)
  select doc_id, cast(len(list_distinct(d)) as bigint) dates, cast(len(list_distinct(h)) as bigint) times, cast(len(list_distinct(p)) as bigint) shares from t""")
def recognize_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct dates, times and percentages of each document."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.map_entries(text.recognize_entities(F.col("text"))).alias("e"))
    n = lambda tag: F.coalesce(F.size(F.filter("e", lambda x: F.array_contains(x["value"], tag))).cast("long"), F.lit(0).cast("long"))
    return found.select("doc_id", n("Date").alias("dates"), n("Time").alias("times"), n("Percentage").alias("shares"))


@query("""with t as (select c_custkey, case c_custkey % 3 when 0 then 'Mr. John Stone' when 1 then 'Mary Reed' else 'Alex' end s from customer)
  select c_custkey, case c_custkey % 3 when 0 then 'john' when 1 then 'mary' else 'alex' end as first_name, case c_custkey % 3 when 0 then 'Male' when 1 then 'Female' else 'GenderNotInferred' end gender from t""")
def human_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    df = table(spark, sf_dir, "customer").select("c_custkey", F.when(k == 0, "Mr. John Stone").when(k == 1, "Mary Reed").otherwise("Alex").alias("s"))
    fitted = names.detect(df, "s", ["john", "stone", "mary", "reed", "alex"], {"john": "Male", "mary": "Female"}, guards=False)
    stats = names.name_stats(F.col("s"), fitted)
    return df.select("c_custkey", F.element_at(stats, F.lit("FirstName")).alias("first_name"), F.element_at(stats, F.lit("Gender")).alias("gender"))


#: Words and their stems by Porter's paper.
_STEMS = "caresses:caress ponies:poni cats:cat agreed:agre plastered:plaster motoring:motor conflated:conflat hopping:hop filing:file happy:happi relational:relat conditional:condit vietnamization:vietnam triplicate:triplic hopefulness:hope revival:reviv adjustment:adjust adoption:adopt effective:effect probate:probat rate:rate controlling:control sky:sky".split()


@query("""select p_partkey, [""" + ", ".join(f"'{x.split(':')[1]}'" for x in _STEMS) + f"""][p_partkey % {len(_STEMS)} + 1] stem from part""")
def stem_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.get(F.array(*[F.lit(x.split(":")[0]) for x in _STEMS]), (F.col("p_partkey") % len(_STEMS)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.get(text.stem(F.array(word)), F.lit(0)).alias("stem"))


_TYPES = "select p_partkey, string_split(p_name, ' ') w from part"


def _words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, G.Feature]:
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.split("p_name", " ").alias("words"))
    return df, G.raw("words", "TextList")


@query(f"""with t as ({_TYPES}), x as (select p_partkey, unnest(w) v from t), c as (select p_partkey, v, count(*) n from x group by all)
  select cast(t.p_partkey as varchar) as key, cast(len(w) as double) words, cast(count(distinct v) as bigint) kinds from t left join c on c.p_partkey = t.p_partkey group by t.p_partkey, w""")
def count_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary counts: the slots of a row add up to its words."""
    df, words = _words(spark, sf_dir)
    out = G.Workflow([words.apply("count_vec", name="v")]).train(df).transform(df)
    return out.select("key", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("words"), F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("kinds"))


@query(f"""with t as ({_TYPES}), x as (select p_partkey, unnest(w) v from t), n as (select count(*) n from t), d as (select v, count(distinct p_partkey) df from x group by 1), c as (select p_partkey, v, count(*) tf from x group by all)
  select cast(p_partkey as varchar) as key, round(sum(tf * ln((n + 1.0) / (df + 1.0))), 6) weight from c join d on c.v = d.v, n group by 1""")
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term frequency times inverse document frequency, in a hash space that is wide enough for no two words to meet."""
    df, words = _words(spark, sf_dir)
    out = G.Workflow([words.tfidf(1 << 14, name="v")]).train(df).transform(df, sparse=True)
    return out.select("key", r6(F.aggregate(G.stored_values("v"), F.lit(0.0), lambda a, x: a + x)).alias("weight"))


@query("""select cast(p_partkey as varchar) as key, 4 as dimensions, true as means from part""")
def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean word vectors of each part's name."""
    df, words = _words(spark, sf_dir)
    model = G.Workflow([words.apply("word2vec", name="v", vectorSize=4, minCount=1, seed=1, maxIter=1)]).train(df)
    out = model.transform(df)
    # a row's vector is the mean of its words' own
    own = model.stages[0][0].model.getVectors().select("word", vector_to_array("vector").alias("w"))
    each = out.select("key", F.posexplode("words").alias("i", "word")).join(own, "word").select("key", F.posexplode("w").alias("d", "x"))
    mean = each.groupBy("key", "d").agg(F.avg("x").alias("x")).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda e: e["x"]).alias("mean"))
    off = F.array_max(F.zip_with("v", "mean", lambda a, b: F.abs(a - b)))
    return out.join(mean, "key").select("key", F.size("v").alias("dimensions"), (off < 1e-4).alias("means"))


@query("""select cast(p_partkey as varchar) as key, 1.0::double as total from part""")
def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic distributions: they add up to one."""
    df, words = _words(spark, sf_dir)
    made = words.apply("count_vec", name="c").apply("lda", name="v", k=3, seed=1, maxIter=3)
    out = G.Workflow([made]).train(df).transform(df)
    return out.select("key", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("""select event_type, count(*) n, round(sum(value), 6) total, bool_and(value > 0) positive from events group by 1""")
def frame_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    counts, sums = frames.group_count(events, "event_type"), frames.group_sum(events, "value", "event_type")
    positive, rest = frames.split(events, F.col("value") > 0)
    bad = rest.select("event_type").distinct().withColumn("bad", F.lit(True))
    return counts.join(sums, "event_type").join(bad, "event_type", "left").select("event_type", "n", r6(F.col("total")).alias("total"), F.col("bad").isNull().alias("positive"))


@query("""select count(*)::double n, true as middle from lineitem""")
def adaptive_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram of adaptive bins holds all rows, and half of them below the median."""
    df = table(spark, sf_dir, "lineitem")
    bins = frames.histogram(df, F.col("l_extendedprice"), 50)
    median = frames.median(df, F.col("l_extendedprice"))
    return spark.createDataFrame([(sum(n for _, n in bins), abs(frames.density(bins, median) - 0.5) < 0.05)], "n double, middle boolean")
