"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"

DECONTAMINATE = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
p as (select distinct item_id, least(len(w), 8) n, unnest(list_transform(range(1, greatest(len(w) - 7, 1) + 1), lambda i: array_to_string(w[i : i + 7], ' '))) p from b where len(w) > 0),
g as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') p from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from p))),
h as (select g.doc_id, g.i, g.n, p.item_id from g join p on p.p = g.p and p.n = g.n),
c as (select doc_id, count(distinct place) n_hit from (select doc_id, unnest(range(i, i + n)) place from h) group by 1),
k as (select doc_id, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) ids from h group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_items, 0) >= 2 contaminated
from d left join c on c.doc_id = d.doc_id left join k on k.doc_id = d.doc_id
"""

HOST_RULES = rf"""
with d as (select doc_id, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), {_SPACED}) w from documents),
l as (select doc_id, count(*) - count(distinct line) dup from (select doc_id, unnest(string_split(t, chr(10))) line from d) where regexp_matches(line, {_SPACED}) group by 1),
g as (select doc_id, i, w[i : i + 2] x from (select doc_id, w, unnest(range(1, len(w) - 1)) i from d)),
r as (select doc_id, count(distinct place) rep from (select doc_id, unnest(range(i, i + 3)) place from (select *, count(*) over (partition by doc_id, x) n from g) where n > 1) group by 1),
m as (select d.doc_id, source, cast(len(w) as bigint) n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) word_chars,
  cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) n_symbols, coalesce(dup, 0) n_dup_lines, coalesce(rep, 0) n_repeat_words from d left join l on l.doc_id = d.doc_id left join r on r.doc_id = d.doc_id),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from m),
h as (select source, count(*)::double n, sum(base_failed::int)::double k, sum(base_failed::int) / count(*) p from f where source is not null group by 1),
s as (select count(*) hosts, sum(n) n, sum(k) / sum(n) mean, sum(n * p * p) moment, sum(n * n) squares from h),
v as (select *, (moment - n * mean * mean - (hosts - 1) * mean * (1 - mean)) / nullif(n - squares / n, 0) between_hosts from s),
q as (select mean, least(greatest(case when between_hosts > 0 then mean * (1 - mean) / between_hosts - 1 else n / hosts end, 1), n / hosts) weight from v),
j as (select source, (k + mean * weight) / (n + weight) rate from h, q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(rate > 0.5, false) kept, round(rate, 9) shrunk_rate from f left join j on j.source = f.source
"""

NEAR_DEDUP = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, {_SPACED}) w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) x from d),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
u as (select a, b from e union all select b, a from e),
r as (select doc_id i, doc_id c from d union select u.b, r.c from r join u on u.a = r.i),
m as (select i, min(c) c from r group by 1)
select d.doc_id, coalesce(n, 0) n_shingles, c component_id, c = d.doc_id kept from d left join n on n.doc_id = d.doc_id join m on m.i = d.doc_id
"""

_CONTROLS = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "</SYS>>", "<SYS>>", "[INST]", "[/INST]", "\\")


def _escaped_length(c: str) -> str:
    return f"length({c}) + " + " + ".join(f"(length({c}) - length(replace({c}, '{x}', ''))) // {len(x)}" for x in _CONTROLS)


CHAT = f"""
with t as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
l as (select *, length('<|turn|><|says|><|end|>') + {_escaped_length("r")} + {_escaped_length("x")} size from t),
c as (select *, sum(size) over w upto, row_number() over (partition by conv_id order by turn desc, r desc, x desc) back from l window w as (partition by conv_id order by turn, r, x rows unbounded preceding))
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn, r, x)) turns_sha256, cast(coalesce(sum(length(x)) filter (where r = 'assistant'), 0) as bigint) loss_chars,
sha256(coalesce(string_agg(x, '' order by turn, r, x) filter (where r = 'assistant'), '')) loss_sha256, cast(sum(upto) filter (where r = 'assistant' or back = 1) as bigint) formatted_chars from c group by 1
"""

CROSS_ENTROPY = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, {_SPACED}) w, coalesce(doc_id in (select doc_id from labels where quality = 1), false) y from documents),
t as (select doc_id, y, i, w[i] word, case when i > 1 then w[i - 1] else '' end context from (select doc_id, y, w, unnest(range(1, len(w) + 1)) i from d)),
o as (select doc_id, word, count(*) c from t group by all), op as (select doc_id, context, word, count(*) c from t group by all),
n as (select word, count(*) n, count(*) filter (where y) m from t group by 1 union all select '', count(*), count(*) filter (where y) from d where len(w) > 0),
p as (select context, word, count(*) n, count(*) filter (where y) m from t group by all),
s as (select count(*) filter (where word <> '') v, sum(n) filter (where word <> '') n, sum(m) filter (where word <> '') m from n),
k as (select t.doc_id, t.y, p.n pn, p.m pm, op.c po, nw.n wn, nw.m wm, ow.c wo, nc.n cn, nc.m cm, case when t.context = '' then 1 else oc.c end co from t join p on p.context = t.context and p.word = t.word
  join op on op.doc_id = t.doc_id and op.context = t.context and op.word = t.word join n nw on nw.word = t.word join o ow on ow.doc_id = t.doc_id and ow.word = t.word
  join n nc on nc.word = t.context left join o oc on oc.doc_id = t.doc_id and oc.word = t.context),
z as (select doc_id, len(w) size from d),
f as (select k.doc_id, size, -ln((pn - po + 4 * ((wn - wo + 0.5) / (s.n - size + 0.5 * (v + 1)))) / (cn - co + 4)) b,
  -ln((pm - po * y::int + 4 * ((wm - wo * y::int + 0.5) / (s.m - size * y::int + 0.5 * (v + 1)))) / (cm - co * y::int + 4)) a from k join z on z.doc_id = k.doc_id, s)
select d.doc_id, cast(len(w) as bigint) n_words, round(avg(a), 6) loss_target, round(avg(b), 6) loss_background, round(avg(a) - avg(b), 6) score from d left join f on f.doc_id = d.doc_id group by d.doc_id, len(w)
"""



def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_BASE = (
    (rf"({_NAMES})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("AKIA[A-Z0-9]+", 0, 16),
    ("[0-9a-f]+", 0, 32),
    ("[A-Za-z0-9+/_=-]+", 0, 20),
)
_MATCHES = " union all ".join(
    f"select doc_id, {k} k, {least} least, regexp_extract_all(t, '{p}', 0) m, regexp_extract_all(t, '{p}', {g}) x, string_split_regex(t, '{p}') g from d" for k, (p, g, least) in enumerate(_BASE)
)
SECRETS = rf"""
with d as (select doc_id, coalesce(text, '') t from documents), m as ({_MATCHES}),
i as (select doc_id, k, least, unnest(list_zip(m, x, g[1 : len(m)])) z, unnest(range(1, len(m) + 1)) i from m where len(m) > 0),
p as (select doc_id, k, least, z[1] v, length(z[2]) n, sum(length(z[3]) + length(z[1])) over (partition by doc_id, k order by i rows unbounded preceding) e from i),
q as (select doc_id, k, v, cast(e - length(v) as bigint) s, cast(e as bigint) e from p where n >= least),
b as (select * from q where k < 3),
c as (select *, case when regexp_matches(v, '^[0-9a-f]+$') and regexp_matches(v, '[a-f]') then 2.9 when regexp_matches(v, '^[0-9A-F]+$') and regexp_matches(v, '[A-F]') then 2.9
  when regexp_matches(v, '^[A-Z0-9=]+$') and regexp_matches(v, '[A-Z]') then 3.5 else 3.7 end bits from q where k = 3 and regexp_matches(v, '[0-9]')
  and not regexp_matches(v, '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$') and not regexp_matches(v, '^/?([A-Za-z0-9]{{1,15}}[/_-]){{3,}}[A-Za-z0-9]{{0,15}}$')
  and not regexp_matches(lower(v), 'example|sample|dummy|placeholder|changeme')
  and len(list_filter(range(1, 9), lambda u: u * greatest(3, (length(v) - 8 + u - 1) // u) <= length(v) and starts_with(v, repeat(v[1 : u], cast(greatest(3, (length(v) - 8 + u - 1) // u) as bigint))))) = 0),
w as (select doc_id, s, list_filter(range(0, length(v) - 19), lambda j: list_aggregate(string_split(substr(v, j + 1, 20), ''), 'entropy') >= bits - 1e-9) good from c where bits is not null),
a as (select doc_id, 3 k, s + good[1] s, s + good[-1] + 20 e from w where len(good) > 0),
y as (select doc_id, k, s, e from b union all select * from a where not exists (select 1 from b where b.doc_id = a.doc_id and b.s < a.e and a.s < b.e)),
z as (select doc_id, count(*) filter (where k = 0) n_assign, count(*) filter (where k = 1) n_access, count(*) filter (where k = 2) n_hex,
  string_agg(['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || s || ':' || e, ',' order by s, k) filter (where k < 3) base, string_agg(['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || s || ':' || e, ',' order by s, k) spans from y group by 1)
select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join z on z.doc_id = d.doc_id
"""

ORACLES = {
    "op1_decontaminate": DECONTAMINATE,
    "op3_cross_entropy_difference": CROSS_ENTROPY,
    "op5_host_rules": HOST_RULES,
    "op7_minhash_near_dedup": NEAR_DEDUP,
    "op8_prefix_targets": CHAT,
    "op9_secret_entropy": SECRETS,
}
