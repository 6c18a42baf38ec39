"""The registered queries of the training-data operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, minhash, periods, pieces, quality_classifier, quality_rules, secrets, sharding, spelling, substring, token_counts, toxicity
from .common import read

TOKENIZER = "piece_bpe_32k.model"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(read(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "char_distance", "word_distance")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the four best segmentations; the operator itself also gives the ids."""
    out = pieces.segment(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return out.select("doc_id", "n_pieces", F.transform("scores", lambda s: F.round(s, 3)).alias("scores"), "digests", "round_trip")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(read(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"), alter=spelling.drop_letters)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic_runs(read(spark, sf_dir, "documents"), tail=periods.tail_period)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(read(spark, sf_dir, "documents")))


QUERIES = [
    op1_quality_rules, op2_decontamination, op3_quality_classifier, op4_token_counts, op5_nbest_pieces, op6_toxicity, op7_balanced_shards, op8_near_duplicates, op9_language_id,
    op10_substring_dedup, op11_spelling_variants, op12_periodic_runs, op13_secret_scan,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = rf"""
with d as (select doc_id, lang, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '{WORD}') as ws from d),
tri as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from tri) where c > 1),
rep as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from twice) group by doc_id),
dup as (select doc_id, count(*) - count(distinct l) as n from (select doc_id, unnest(string_split(t, chr(10))) as l from d)
  where regexp_matches(l, '{WORD}') group by doc_id),
c as (select doc_id, lang, length(regexp_replace(t, '[^a-z]', '', 'g')) as c0, length(regexp_replace(t, '[^A-Z]', '', 'g')) as c1,
  length(regexp_replace(t, '[^0-9]', '', 'g')) as c2, length(regexp_replace(t, '{WORD}', '', 'g')) as c3,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as c4, length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) as c6, strlen(t) as bytes, length(regexp_replace(t, '[\x00-\x7F]+', '', 'g')) as wide from d),
total as (select doc_id, len(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) as low from d),
chars as (select doc_id, lang, unnest([0, 1, 2, 3, 4, 5, 6]) as k, unnest([c0, c1, c2, c3, c4, low - c0 - c1 - c2 - c3 - c4, c6]) as n from c join total using (doc_id)),
listed as (select unnest(range(0, {len(quality_rules.COMMON)})) as k, unnest({quality_rules.COMMON!r}) as word),
bins as (select k from listed union all select {len(quality_rules.COMMON)}),
each as (select doc_id, coalesce(k, {len(quality_rules.COMMON)}) as k, count(*) as n from (select doc_id, translate(unnest(ws), '{UPPER}', '{LOWER}') as word from w) left join listed using (word) group by all),
words as (select d.doc_id, d.lang, b.k, coalesce(e.n, 0) as n from d cross join bins b left join each e on e.doc_id = d.doc_id and e.k = b.k),
hist as (select 'c' as kind, * from chars union all select 'w', * from words),
h as (select *, sum(n) over (partition by kind, doc_id) as all_n from hist),
base as (select w.doc_id, d.lang, len(ws) as n_words, length(w.t) - c3 as word_chars, c4 as n_symbols, coalesce(dup.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, length(w.t) as n_chars,
  len(ws) < {quality_rules.BASE_WORDS} or 100 * coalesce(rep.n, 0) > 50 * len(ws) as base_failed from w join d using (doc_id) join c using (doc_id) left join dup using (doc_id) left join rep using (doc_id)),
neutral as (select doc_id, case when k = 6 then 0 else k end as k, sum(n) as n from chars group by 1, 2),
whole as (select k, sum(n) as n, sum(sum(n)) over () as all_n from neutral join base using (doc_id) where not base_failed group by k),
own as (select lang, k, sum(n) as n, sum(sum(n)) over (partition by lang) as all_n from neutral join base using (doc_id) where not base_failed and lang is not null group by lang, k),
shared as (select 'l' as kind, lang as id, p.n / greatest(p.all_n, 1) as p, q.n / greatest(q.all_n, 1) as q, p.all_n, q.all_n as ref_n from own p join whole q using (k)
  union all select 'd', doc_id::varchar, p.n / greatest(t.n, 1), q.n / greatest(q.all_n, 1), t.n, q.all_n from neutral p join (select doc_id, sum(n) as n from neutral group by 1) t using (doc_id) join whole q using (k)),
apart as (select kind, id, case when max(all_n) = 0 or max(ref_n) = 0 then 0 else sqrt(greatest((sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end)
  + sum(case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end)) / 2, 0)) end as js from shared group by all),
langs as (select lang from base join apart on kind = 'l' and id = lang where not base_failed and lang is not null group by lang having count(*) >= {quality_rules.LEAST_DOCS} and max(js) <= {quality_rules.MAX_CHAR}
  order by count(*) desc, lang limit {quality_rules.MOST_LANGUAGES}),
r as (select kind, hist.lang, k, sum(n) as n, sum(sum(n)) over (partition by kind, hist.lang) as all_n from hist join base using (doc_id) join langs on langs.lang = hist.lang where not base_failed group by kind, hist.lang, k),
pq as (select h.kind, h.doc_id, r.lang, h.all_n, r.all_n as ref_n, h.n / greatest(h.all_n, 1) as p, r.n / greatest(r.all_n, 1) as q from h join r on h.kind = r.kind and h.k = r.k),
js as (select kind, doc_id, lang, case when max(all_n) = 0 or max(ref_n) = 0 then 0 else sqrt(greatest((sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end)
  + sum(case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end)) / 2, 0)) end as js from pq group by all),
nearest as (select doc_id, min(js) filter (kind = 'c') as cd, min(js) filter (kind = 'w') as wd from js group by doc_id),
near as (select base.doc_id, case when base.lang is null or langs.lang is not null then cd else apart.js end as cd, case when base.lang is null or langs.lang is not null then wd else 0 end as wd
  from base left join langs on langs.lang = base.lang left join nearest using (doc_id) left join apart on apart.kind = 'd' and apart.id = base.doc_id::varchar)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not (n_chars >= {quality_rules.MIN_CHARS} and coalesce(cd, 0) > {quality_rules.MAX_CHAR})
  and not (n_words >= {quality_rules.MIN_WORDS} and coalesce(wd, 0) > {quality_rules.MAX_WORD}) as kept, round(coalesce(cd, 0), 6) as char_distance, round(coalesce(wd, 0), 6) as word_distance
from base left join near using (doc_id)
"""

OP7 = """
with table_of as (select list(c order by i) as tab from (select i, list_reduce(list_prepend(i, range(0, 8)), lambda a, b: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end) as c
  from (select unnest(range(0, 256)) as i))),
d as (select doc_id, coalesce(text, '') as t from documents),
b as (select doc_id, t, list_transform(range(0, strlen(t)), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::bigint) as bytes from (select doc_id, t, hex(encode(t)) as h from d)),
c as (select doc_id, strlen(t) + 16 as size, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, x: xor(a // 256, tab[xor(a % 256, x) + 1])), 4294967295) as crc from b, table_of),
o as (select *, sum(size) over (order by doc_id, crc, size rows unbounded preceding) as upto, sum(size) over () as total, row_number() over (order by doc_id, crc, size) - 1 as nth from c),
s as (select *, least(39, (2 * (upto - size) + size) * 40 // (2 * total)) as shard from o)
select doc_id, size, crc as text_crc32, 'bytes' as law, shard::int as shard, (nth - min(nth) over (partition by shard))::bigint as slot, null::int as grown_shard from s
"""

OP8 = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as ws from documents),
s as (select distinct doc_id, g from (select doc_id, array_to_string(ws[i:i + 4], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0))),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as common from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
link as materialized (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * common >= 85 * (a.n + b.n - common)),
reach as (select x, y from link union select r.x, l.y from reach r join link l on r.y = l.x),
top as (select x as doc_id, least(x, min(y)) as component_id from reach group by x)
select w.doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, w.doc_id) as component_id, w.doc_id = coalesce(component_id, w.doc_id) as kept
from w left join n using (doc_id) left join top using (doc_id)
"""

OP10 = rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws from documents),
g as (select doc_id, i, row_number() over (partition by md5(array_to_string(ws[i:i + 19], ' ')) order by doc_id, i) as nth
  from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from w)),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as i from g where nth > 1),
e as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as word from w),
k as (select e.doc_id, string_agg(word, ' ' order by e.i) as kept, count(*) as n from e left join gone on gone.doc_id = e.doc_id and gone.i = e.i where gone.i is null group by e.doc_id)
select doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k using (doc_id)
"""


#: The table of the CRC-32 of bytes, and the CRC-32 of a list of them.
CRC_TABLE = """select list(c order by i) as tab from (select i, list_reduce(list_prepend(i, range(0, 8)), lambda a, b: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end) as c
  from (select unnest(range(0, 256)) as i))"""


def crc_of(column: str) -> str:
    """SQL for the unsigned CRC-32 of a text column's bytes; needs the table as ``tab``."""
    each = f"list_transform(range(0, strlen({column})), lambda k: ('0x' || substr(hex(encode({column})), 2 * k + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295, {each}), lambda a, x: xor(a // 256, tab[xor(a % 256, x) + 1])), 4294967295)"


OP11 = f"""
with recursive table_of as ({CRC_TABLE}),
r as (select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') as w from documents),
k as (select doc_id, w, doc_id || ':' || w as named, count(*) as c from r where length(w) >= 7 group by all),
h as (select w, c, {crc_of("named")} as h from k, table_of),
alt as (select case when h % 31 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, c from h),
v as materialized (select word, sum(c)::bigint as n from alt where length(word) >= 7 group by word having sum(c) >= 2),
cut as materialized (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select *, unnest(range(1, length(word) + 1)) as i from v)),
shorter as (select distinct c.word as x, c.n as xn, v.word as y, v.n as yn from cut c join v on c.rest = v.word),
near as (select a.word, b.word as other, b.n as other_n from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union all select x, y, yn from shorter union all select y, x, xn from shorter),
best as (select word, count(*) as n_near, max(other_n) as top from near group by word),
f as materialized (select v.word, v.n, coalesce(b.n_near, 0) as n_near, case when b.top >= 10 * v.n then b.top end as form_n,
  case when b.top >= 10 * v.n then (select min(other) from near where near.word = v.word and near.other_n = b.top) end as form from v left join best b using (word)),
follow as (select word, form as last from f where form is not null union all select follow.word, f.form from follow join f on f.word = follow.last where f.form is not null),
ends as (select follow.word, last from follow join f on f.word = follow.last where f.form is null)
select f.word, form, coalesce(last, f.word) as root, n, n_near, form_n from f left join ends using (word)
"""

OP12 = rf"""
with table_of as ({CRC_TABLE}),
d as (select doc_id, doc_id::varchar as id, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws from documents),
h as (select doc_id, ws, len(ws) as n, {crc_of("id")} as h from d, table_of),
a as (select *, case when h % 10 = 0 and n > 0 then (h // 10) % n else n end as a, 3 + (h // 10) % 8 as parts from h),
e as materialized (select doc_id, i, ws[1 + case when i >= a then a + (i - a) % (1 + (n - a) // parts) else i end] as word from (select *, unnest(range(0, n)) as i from a)),
p as (select x.doc_id, y.i - x.i as q, x.i from e x join e y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i),
s as (select doc_id, q, min(i) as start, count(*) + q as length from (select *, i - row_number() over (partition by doc_id, q order by i) as g from p) group by doc_id, q, g),
runs as materialized (select doc_id, start, length, min(q) as period from s where length >= greatest(12, 2 * q) group by all),
top as (select * from (select *, row_number() over (partition by doc_id order by length desc, start, period) as nth, count(*) over (partition by doc_id) as n_runs from runs) where nth = 1),
listed as (select doc_id, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as t from runs group by doc_id),
gone as (select distinct e.doc_id, e.i from e join runs r on r.doc_id = e.doc_id and e.i >= r.start + r.period and e.i < r.start + r.length),
kept as (select e.doc_id, string_agg(word, ' ' order by e.i) as t, count(*) as n from e left join gone g on g.doc_id = e.doc_id and g.i = e.i where g.i is null group by e.doc_id)
select a.doc_id, a.n as n_words, coalesce(n_runs, 0) as n_runs, start, length, period, 1000 * length // period as exponent_milli, a.n - coalesce(kept.n, 0) as n_dropped,
  sha256(coalesce(listed.t, '')) as runs_sha256, sha256(coalesce(kept.t, '')) as collapsed_sha256 from a left join top using (doc_id) left join listed using (doc_id) left join kept using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1, "op7_balanced_shards": OP7, "op8_near_duplicates": OP8, "op10_substring_dedup": OP10, "op11_spelling_variants": OP11, "op12_periodic_runs": OP12}
