"""Row-level operators: math, text, network addresses, dates, collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import collections as C
from ..functions import dates, math, net, text
from .base import event_ms, query, r6, table

#: Both sides have nulls: x in line 3, y where the quantity is a multiple of 5.
_XY = """select l_orderkey, l_linenumber, case when l_linenumber <> 3 then l_extendedprice end x,
  case when cast(l_quantity as bigint) % 5 <> 0 then l_quantity end y, l_discount d, l_tax t from lineitem"""


def _xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("x"),
        F.when(F.col("l_quantity").cast("long") % 5 != 0, F.col("l_quantity")).alias("y"),
        F.col("l_discount").alias("d"),
        F.col("l_tax").alias("t"),
    )


@query(f"""select l_orderkey, l_linenumber, round(coalesce(x + y, x, y), 6) plus, round(coalesce(x - y, x, -y), 6) minus,
  round(x * y, 6) times, round(case when t <> 0 then x / t end, 6) divided from ({_XY})""")
def math_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return _xy(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", r6(math.add(x, y)).alias("plus"), r6(math.subtract(x, y)).alias("minus"),
        r6(math.multiply(x, y)).alias("times"), r6(math.divide(x, F.col("t"))).alias("divided"),
    )


@query(f"""select l_orderkey, l_linenumber, round(y + 2.5, 6) plus, round(y - 2.5, 6) minus, round(y * 1e3, 6) times,
  round(y / 8, 6) divided, cast(null as double) by_zero from ({_XY})""")
def math_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("y")
    return _xy(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", r6(math.add_scalar(y, 2.5)).alias("plus"), r6(math.subtract_scalar(y, 2.5)).alias("minus"),
        r6(math.multiply_scalar(y, 1e3)).alias("times"), r6(math.divide_scalar(y, 8)).alias("divided"), r6(math.divide_scalar(y, 0)).alias("by_zero"),
    )


@query(f"""select l_orderkey, l_linenumber, round(abs(25 - y), 6) absolute, cast(ceil(y / 4) as bigint) up, cast(floor((25 - y) / 4) as bigint) down,
  cast(floor((25 - y) / 2 + 0.5) as bigint) nearest, round(floor(y / 7 * 100 + 0.5) / 100, 6) digits, round(exp(d), 6) exp_d,
  round(case when y > 5 then sqrt(y - 5) when y = 5 then 0 end, 6) root, round(case when t > 0 then log10(t) / log10(2) end, 6) log2_t,
  round(case when d <> 0 then pow(d, -2) end, 6) power from ({_XY})""")
def math_unary(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, back = F.col("y"), F.lit(25.0) - F.col("y")
    return _xy(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", r6(math.absolute(back)).alias("absolute"), math.ceil(y / 4).alias("up"), math.floor(back / 4).alias("down"),
        math.round_half_up(back / 2).alias("nearest"), r6(math.round_digits(y / 7, 2)).alias("digits"), r6(math.exp(F.col("d"))).alias("exp_d"),
        r6(math.sqrt(y - 5)).alias("root"), r6(math.log(F.col("t"), 2)).alias("log2_t"), r6(math.power(F.col("d"), -2)).alias("power"),
    )


@query(f"""select l_orderkey, l_linenumber, round(y * 2 + 3, 6) scaled, round(y, 6) back, round(case when t > 0 then ln(t) end, 6) logged,
  round(case when t > 0 then t end, 6) unlogged from ({_XY})""")
def scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled, logged = math.scale_linear(F.col("y"), 2, 3), math.scale_log(F.col("t"))
    return _xy(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", r6(scaled).alias("scaled"), r6(math.descale_linear(scaled, 2, 3)).alias("back"),
        r6(logged).alias("logged"), r6(math.descale_log(logged)).alias("unlogged"),
    )


@query(f"""select l_orderkey, l_linenumber,
  cast(case when y >= 5 and y < 10 then 0 when y >= 10 and y < 20 then 1 when y >= 20 and y <= 40 then 2 when y is null then 4 else 3 end as integer) left_slot,
  cast(case when y >= 5 and y <= 10 then 0 when y > 10 and y <= 20 then 1 when y > 20 and y <= 40 then 2 when y is null then 4 else 3 end as integer) right_slot
  from ({_XY})""")
def bucketize(spark: SparkSession, sf_dir: str) -> DataFrame:
    def slot(left: bool):
        return (F.array_position(math.bucketize(F.col("y"), [5, 10, 20, 40], left), 1.0) - 1).cast("int")

    return _xy(spark, sf_dir).select("l_orderkey", "l_linenumber", slot(True).alias("left_slot"), slot(False).alias("right_slot"))


@query(r"""with t as (select page_id, url, regexp_replace(lower(url), '[[:punct:]]', ' ', 'g') c from pages)
  select page_id, array_to_string(list_transform(list_filter(string_split(c, ' '), lambda x: x <> ''), lambda x: upper(x[1:1]) || x[2:]), '') cleaned,
  concat_ws('|', nullif(regexp_extract(url, '^([a-z]+):', 1), ''), nullif(regexp_extract(url, '#(.*)$', 1), '')) joined from t""")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    scheme, anchor = F.regexp_extract("url", "^([a-z]+):", 1), F.regexp_extract("url", "#(.*)$", 1)
    return table(spark, sf_dir, "pages").select("page_id", text.clean(F.col("url")).alias("cleaned"), text.concat_skip_empty("|", scheme, anchor).alias("joined"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_TOKENS = rf"list_filter(regexp_extract_all(lower(text), '[\pL\pN]+'), lambda x: x not in ({_STOP}))"


@query(f"""with t as (select doc_id, {_TOKENS} k from documents)
  select doc_id, cast(case when len(k) > 0 then len(k) end as integer) n_tokens, cast(coalesce(list_sum(list_transform(k, lambda x: length(x))), 0) as double) token_chars,
  md5(array_to_string(k, ' ')) digest, cast(case when len(k) >= 2 then len(k) - 1 end as integer) n_bigrams,
  case when len(k) >= 2 then k[1] || ' ' || k[2] end first_bigram, case when len(k) > 0 then 0.0 else 1.0 end::double is_null from t""")
def text_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text.tokenize(F.col("text")).alias("k"))
    k, grams = F.col("k"), text.ngrams(F.col("k"), 2)
    return docs.select(
        "doc_id", F.size(k).alias("n_tokens"), text.token_length(k).alias("token_chars"), F.md5(F.coalesce(F.array_join(k, " "), F.lit("")).cast("binary")).alias("digest"),
        F.size(grams).alias("n_bigrams"), F.get(grams, F.lit(0)).alias("first_bigram"), text.list_is_null(k).alias("is_null"),
    )


@query(r"""with t as (select page_id, replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') p, html from pages)
  select page_id, cast(length(p) as integer) plain_chars, md5(p) plain_md5, cast(len(regexp_extract_all(html, '<([a-z0-9]+)', 1)) as integer) n_tags from t""")
def text_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain, tags = text.strip_html(F.col("html")), text.tokenize_regex(F.col("html"), "<([a-z0-9]+)", 1, to_lower=False)
    return table(spark, sf_dir, "pages").select("page_id", F.length(plain).alias("plain_chars"), F.md5(plain.cast("binary")).alias("plain_md5"), F.size(tags).alias("n_tags"))


@query("""with t as (select b.item_id, string_split(b.text, ' ') a, string_split(n.text, ' ') b, b.text x, n.text y from benchmark b join benchmark n on n.item_id = b.item_id + 1)
  select item_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) jaccard, contains(lower(x), lower(b[1])) inside,
  contains(x, upper(b[1])) inside_case from t""")
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    both = items.join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("y")), "item_id")
    a, b = F.split("text", " "), F.split("y", " ")
    return both.select(
        "item_id", r6(text.jaccard(a, b)).alias("jaccard"), text.is_substring(F.get(b, F.lit(0)), F.col("text")).alias("inside"),
        text.is_substring(F.upper(F.get(b, F.lit(0))), F.col("text"), to_lower=False).alias("inside_case"),
    )


@query()
def text_ngram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation")
    return names.select("n_nationkey", r6(text.ngram_similarity(F.col("n_name"), F.lit("UNITED STATES"))).alias("similarity"))


_MAIL = r"regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*')"
_LOCAL, _LABEL = "[A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]+", "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_FULL = rf"^({_LOCAL})@({_LABEL}(?:\.{_LABEL})*)$"


@query(f"""with t as (select doc_id, {_MAIL} m from documents)
  select doc_id, nullif(m, '') mail, nullif(regexp_extract(nullif(m, ''), '{_FULL}', 1), '') prefix, nullif(regexp_extract(nullif(m, ''), '{_FULL}', 2), '') domain,
  regexp_matches(nullif(m, ''), '{_FULL}') valid from t""")
def net_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.nullif(F.regexp_extract("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*", 0), F.lit(""))
    m = F.col("mail")
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("mail")).select(
        "doc_id", "mail", net.email_prefix(m).alias("prefix"), net.email_domain(m).alias("domain"), net.is_valid_email(m).alias("valid")
    )


@query(r"""with t as (select page_id, case when page_id % 7 = 0 then 'no url' else url end u from pages)
  select page_id, regexp_matches(u, '^(https?|ftp)://[^\s/?#.]+\.[^\s/?#]+([/?#]\S*)?$') valid,
  case when page_id % 7 <> 0 then regexp_extract(u, '^[a-z]+://([^/?#]*)', 1) end as domain, case when page_id % 7 <> 0 then regexp_extract(u, '^([a-z]+):', 1) end protocol from t""")
def net_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.when(F.col("page_id") % 7 == 0, F.lit("no url")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", net.url_is_valid(u).alias("valid"), net.url_domain(u).alias("domain"), net.url_protocol(u).alias("protocol"))


@query("""with t as (select c_custkey, case c_custkey % 4 when 0 then '(212) ' || lpad(cast(2000000 + c_custkey % 7999999 as varchar), 7, '0')
    when 1 then '+49 ' || cast(3012345678 + c_custkey as varchar) when 2 then '1' else '555' || cast(c_custkey as varchar) end p from customer)
  select c_custkey, case c_custkey % 4 when 0 then '+1212' || lpad(cast(2000000 + c_custkey % 7999999 as varchar), 7, '0') when 1 then '+49' || cast(3012345678 + c_custkey as varchar) end parsed,
  case when c_custkey % 4 = 2 then null else c_custkey % 4 < 2 end valid from t""")
def net_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    local = F.concat(F.lit("(212) "), F.lpad((F.lit(2000000) + k % 7999999).cast("string"), 7, "0"))
    p = F.when(k % 4 == 0, local).when(k % 4 == 1, F.concat(F.lit("+49 "), (F.lit(3012345678) + k).cast("string"))).when(k % 4 == 2, "1").otherwise(F.concat(F.lit("555"), k.cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", net.parse_phone(p).alias("parsed"), net.is_valid_phone(p).alias("valid"))


@query("""with t as (select c_custkey, ['DE', 'Germny', 'united kingdom', null, 'fr'][c_custkey % 5 + 1] r, '30' || cast(1234567 + c_custkey % 8000000 as varchar) p from customer),
  c as (select *, case c_custkey % 5 when 0 then 'DE' when 1 then 'DE' when 2 then 'GB' when 3 then 'US' else 'FR' end k, case c_custkey % 5 when 0 then '49' when 1 then '49' when 2 then '44' when 3 then '1' else '33' end n from t)
  select c_custkey, k as region, case when n <> '1' then '+' || n || p end parsed from c""")
def net_phone_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the region that a column names, by its code or about by its name; nine digits are no North American number."""
    k = F.col("c_custkey")
    r = F.get(F.array(*[F.lit(x).cast("string") for x in ("DE", "Germny", "united kingdom", None, "fr")]), (k % 5).cast("int"))
    p = F.concat(F.lit("30"), (F.lit(1234567) + k % 8000000).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", net.region_of(r).alias("region"), net.parse_phone(p, r).alias("parsed"))


@query("""select p_partkey, case when p_partkey % 5 = 0 then 'application/pdf' when p_partkey % 5 = 1 then 'image/png' when p_partkey % 5 = 2 then 'text/plain' when p_partkey % 5 = 3 then null
  else 'application/octet-stream' end mime, case when p_partkey % 5 = 2 then p_name end plain from part""")
def net_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, F.unhex(F.lit("255044462D312E34"))).when(k == 1, F.unhex(F.lit("89504E470D0A1A0A00"))).when(k == 2, F.col("p_name").cast("binary")).when(k == 4, F.unhex(F.lit("0001FF")))
    b64 = F.base64(raw)
    return table(spark, sf_dir, "part").select("p_partkey", net.mime_type(b64).alias("mime"), F.when(k == 2, net.base64_text(b64)).alias("plain"))


@query("""with t as (select o_orderkey, o_orderdate d, cast(o_orderdate as date) dd from orders)
  select o_orderkey, cast(day(d) as integer) day_of_month, cast(isodow(d) as integer) day_of_week, cast(dayofyear(d) as integer) day_of_year, cast(hour(d) as integer) hour_of_day, cast(month(d) as integer) month_of_year,
  cast(floor((day(d) - 1 + isodow(date_trunc('month', dd)) - 1) / 7) + 1 as integer) week_of_month, cast(floor((dayofyear(d) - 1 + isodow(date_trunc('year', dd)) - 1) / 7) + 1 as integer) week_of_year,
  round(cos(2 * pi() * (month(d) - 1) / 12), 6) cos_month, round(sin(2 * pi() * (isodow(d) - 1) / 7), 6) sin_day from t""")
def date_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = event_ms("o_orderdate")
    names = {"DayOfMonth": "day_of_month", "DayOfWeek": "day_of_week", "DayOfYear": "day_of_year", "HourOfDay": "hour_of_day", "MonthOfYear": "month_of_year", "WeekOfMonth": "week_of_month", "WeekOfYear": "week_of_year"}
    circle = [r6(F.get(dates.unit_circle(ms, p), F.lit(i))).alias(n) for p, i, n in (("MonthOfYear", 0, "cos_month"), ("DayOfWeek", 1, "sin_day"))]
    return table(spark, sf_dir, "orders").select("o_orderkey", *[dates.time_period(ms, p).alias(n) for p, n in names.items()], *circle)


@query("""with t as (select user_id, list((epoch_us(ts) // 1000)) l, mode(isodow(ts) order by isodow(ts)) dow, mode(hour(ts) order by hour(ts)) hr from events where event_type = 'error' group by 1)
  select user_id, cast(trunc((1706745600000 - list_min(l)) / 86400000.0) as double) since_first, cast(trunc((1706745600000 - list_max(l)) / 86400000.0) as double) since_last,
  cast(dow - 1 as integer) mode_day, cast(hr as integer) mode_hour from t""")
def date_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id").agg(F.collect_list(event_ms()).alias("l"))
    end = 1_706_745_600_000
    pivot = lambda p: dates.date_list_pivot(F.col("l"), p, end)
    return lists.select(
        "user_id", F.get(pivot("SinceFirst"), F.lit(0)).alias("since_first"), F.get(pivot("SinceLast"), F.lit(0)).alias("since_last"),
        (F.array_position(pivot("ModeDay"), 1.0) - 1).cast("int").alias("mode_day"), (F.array_position(pivot("ModeHour"), 1.0) - 1).cast("int").alias("mode_hour"),
    )


@query("""select p_partkey, p_size > 0 and p_size <= 25 small, case when p_size > 25 then p_size else 0 end kept, case when p_brand = 'Brand#1' then 'first' else p_brand end brand,
  case when p_retailprice > 1000 then 1.0 else 0.0 end::double dear, case when length(nullif(p_type, 'SMALL')) > 0 then 1.0 else 0.0 end::double typed from part""")
def value_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.nullif(F.col("p_type"), F.lit("SMALL"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.coalesce((F.col("p_size") > 0) & (F.col("p_size") <= 25), F.lit(False)).alias("small"), C.filter_value(F.col("p_size"), lambda c: c > 25, 0).alias("kept"),
        C.replace_value(F.col("p_brand"), "Brand#1", "first").alias("brand"), C.occurs(F.col("p_retailprice") - 1000, "number").alias("dear"), C.occurs(kind, "text").alias("typed"),
    )


@query("""with t as (select user_id, event_type k, count(*) n from events group by all), r as (select *, row_number() over (partition by user_id order by n desc, k) i from t)
  select user_id, string_agg(case when k <> 'error' then k || '=' || n end, ',' order by k) kept, string_agg(case when i <= 2 then k || '=' || n end, ',' order by k) top2,
  string_agg(k || '=' || (n > 10), ',' order by k) many from r group by 1""")
def map_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").count()
    m = F.col("m")
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "count")))).alias("m"))

    def shown(c):
        return F.nullif(F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ","), F.lit(""))

    return maps.select("user_id", shown(C.filter_map(m, block=["error"])).alias("kept"), shown(C.top_n_map(m, 2)).alias("top2"), shown(C.lift_map(lambda v: v > 10)(m)).alias("many"))


@query("""with t as (select user_id, list(distinct event_type order by event_type) s, list(value order by event_id) l from events group by 1)
  select user_id, array_to_string(list_sort(list_distinct(list_transform(s, lambda x: x[1:1]))), ',') initials, cast(len(l) as integer) n, round(list_sum(list_transform(l, lambda x: x * 2)), 4) doubled from t""")
def list_set_lifting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"), F.collect_list("value").alias("l"))
    twice = C.lift_list(lambda x: x * 2)(F.col("l"))
    return rows.select(
        "user_id", F.array_join(C.lift_set(lambda x: F.substring(x, 1, 1))(F.col("s")), ",").alias("initials"), F.size("l").alias("n"),
        F.round(F.aggregate(twice, F.lit(0.0), lambda a, x: a + x), 4).alias("doubled"),
    )


@query("""with t as (select a.vec_id, list_transform(a.embedding, lambda x: x::double) a, list_transform(b.embedding, lambda x: x::double) b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
  select vec_id, round(list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])), 6) dot, round(list_sum(a) + list_sum(b), 6) added, round(list_sum(a) - list_sum(b), 6) subtracted,
  cast(len(a) + len(b) as integer) combined, round(list_sum(a) - a[1] + 9, 6) updated from t""")
def vector_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    both = vectors.join(vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    a, b = F.col("a"), F.col("b")
    total = lambda v: r6(F.aggregate(v, F.lit(0.0), lambda s, x: s + x))
    return both.select(
        "vec_id", r6(C.vector_dot(a, b)).alias("dot"), total(C.vector_add(a, b)).alias("added"), total(C.vector_subtract(a, b)).alias("subtracted"),
        F.size(C.combine(a, b)).alias("combined"), total(C.vector_update(a, 0, 9.0)).alias("updated"),
    )


@query("""with t as (select vec_id, list_transform(embedding[1:3], lambda x: abs(x)::double) p from embeddings), l as (select vec_id, unnest(['red', 'green', 'UnseenLabel']) k, unnest(p) v from t),
  r as (select *, row_number() over (partition by vec_id order by v desc, k) i from l where k <> 'UnseenLabel')
  select vec_id, k best, round(v, 6) probability from r where i = 1""")
def label_joiners(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.transform(F.slice("embedding", 1, 3), lambda x: F.abs(x).cast("double"))
    top = F.map_entries(C.top_n_labels(["red", "green", "UnseenLabel"], p, 1))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.get(top, F.lit(0)).alias("e")).select("vec_id", F.col("e.key").alias("best"), r6(F.col("e.value")).alias("probability"))


@query("""select event_id, cast(json_extract_string(props, '$.k') as bigint) k, strftime(ts, '%Y-%m-%d') as day_text from events""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = dates.parse_any(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.date_format(day, "yyyy-MM-dd").alias("day_text"))
