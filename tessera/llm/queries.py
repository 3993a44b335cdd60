"""One query per operator, over its whole table with production parameters, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chat_format import format_conversations
from tessera.llm.decontamination import contained_items
from tessera.llm.license_scan import scan_licenses
from tessera.llm.line_dedup import dropped_lines
from tessera.llm.lm_scoring import score_documents
from tessera.llm.parity_join import join_similar
from tessera.llm.piece_sampling import sample_pieces
from tessera.llm.quality_rules import judge_quality
from tessera.llm.token_counts import count_tokens
from tessera.llm.url_filters import filter_urls


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("per_word", 6).alias("per_word"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior", "kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dropped_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.concat_ws(",", F.col("dropped").cast("array<string>")).alias("dropped"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_decontamination": op5_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_license_scans": op7_license_scans,
    "op8_quality_rules": op8_quality_rules,
    "op9_line_dedup": op9_line_dedup,
    "op10_chat_format": op10_chat_format,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(column: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def jaccard_sql(documents: str, width: int, percent: int) -> str:
    """doc_id, n_shingles and component_id of a table's documents, by counting the shingles that pairs share."""
    return f"""
with recursive d as (select distinct doc_id, {_words("text")} as w from {documents}),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {width} then [array_to_string(w, ' ')] else [array_to_string(w[k:k + {width - 1}], ' ') for k in range(1, len(w) - {width - 2})] end) as g from d),
n as (select doc_id, count(*) as n from s group by 1),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as materialized (select x, y from pairs join n a on a.doc_id = x join n b on b.doc_id = y where 100 * shared >= {percent} * (a.n + b.n - shared)),
reach as (select doc_id, doc_id as root from d union select l.y, r.root from reach r join links l on l.x = r.doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(root) from reach r where r.doc_id = d.doc_id) as component_id from d left join n using (doc_id)"""


ORACLES: dict[str, str] = {
    # All token sets of labelled pages are counted, which finds the frequent ones; rules that pruning drops decide nothing.
    "op1_url_filters": rf"""
with u as (select row_number() over () as r, page_id, coalesce(url, '') as url from pages),
v as (select *, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from u),
h as (select r, page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) as path from v),
p as (select *, list_sort(list_distinct(list_concat(
    list_filter(list_transform(list_reverse(string_split(host, '.')), lambda x, i: 'h' || (i - 1) || ':' || x), lambda x: not ends_with(x, ':')),
    list_transform(list_filter(regexp_split_to_array(translate(path, '{UPPER}', '{LOWER}'), '[/._\-]+'), lambda x: x <> '' and not regexp_full_match(x, '[0-9]+')), lambda x: 'p:' || x),
    list_transform(list_filter(regexp_split_to_array(regexp_extract(url, '\?([^#]*)', 1), '[&;]'), lambda x: x <> ''), lambda x: 'q:' || split_part(x, '=', 1)),
    case when contains(url, '#') then ['fragment'] else [] end))) as tokens from h),
l as (select doc_id, bool_or(quality = 0 or toxic = 1) as bad from labels where (quality = 0 or toxic = 1) is not null group by 1),
b as (select tokens, bad from p join l on page_id = doc_id),
s as (select list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1) as tokens, bad from (select *, unnest(range(1, 1 << len(tokens))) as mask from b)),
c as (select tokens, count(*) as n, count(*) filter (bad) as n_bad from s group by 1),
k as (select tokens, 'block' as verdict, n_bad as both_n, n_bad / n as confidence, 0.6 as least, 1.5 * (select avg(bad::int) from b) as lift from c
    union all select tokens, 'allow', n - n_bad, (n - n_bad) / n, 0.8, 1.1 * (1 - (select avg(bad::int) from b)) from c),
rules as (select * from k where both_n >= 20 and confidence >= least and confidence >= lift),
m as (select r, max((confidence, both_n, verdict = 'block')) as best from p join rules on list_has_all(p.tokens, rules.tokens) group by r),
f as (select *, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule from p left join m using (r))
select page_id, host, path, rule, case rule when 'www.example.com/en/' then 'allow' when 'com/' then 'allow' when 'example.com/en/' then 'block' when 'net/es/' then 'block' when 'net/fr/' then 'block'
    else case when best[3] then 'block' else 'allow' end end as verdict, best[1] as confidence from f""",
    "op3_lm_scoring": f"""
with d as (select row_number() over () as r, doc_id, {_words("text")} as w from documents),
p as (select r, unnest(range(len(w))) as i, unnest(w) as x from d),
q as (select *, lag(x) over (partition by r order by i) as v from p),
o as (select x, count(*) as c from p group by x),
t as (select v, x, count(*) as c from q where v is not null group by all),
s as (select r, case when t.c >= 2 then ln(t.c / ov.c) when q.v is null then ln(o.c / n.n) else ln(0.4) + ln(o.c / n.n) end as l
      from q join o on q.x = o.x left join o ov on q.v = ov.x left join t on q.v = t.v and q.x = t.x cross join (select count(*) as n from p) n),
f as (select r, sum(l) as l from s group by r)
select doc_id, len(w) as n_words, round(coalesce(l, 0.0), 6) as log_score, round(l / len(w), 6) as per_word from d left join f using (r)""",
    "op4_jaccard_join": jaccard_sql("documents", 4, 85),
    "op5_decontamination": f"""
with d as (select distinct doc_id, {_words("text")} as w from documents),
i as (select distinct item_id, {_words("text")} as w, least(5, len(w)) as n from benchmark),
ish as (select distinct item_id, w, n, unnest([array_to_string(w[k:k + n - 1], ' ') for k in range(1, len(w) - n + 2)]) as s from i where len(w) > 0),
dsh as (select distinct doc_id, n, unnest([array_to_string(w[k:k + n - 1], ' ') for k in range(1, len(w) - n + 2)]) as s from d, (select distinct n from i where n > 0)),
q as (select item_id, w, count(*) as n_shingles from ish group by all),
m as (select doc_id, item_id, w, count(*) as n_shared from ish join dsh using (n, s) group by all)
select doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles as containment from m join q using (item_id, w) where n_shared >= 0.8 * n_shingles - 1e-9""",
    # Two edits in a line of forty characters leave its first thirteen, its last thirteen or those between in one piece,
    # moved by two places at most. From where two lines first differ, one edit and then what takes at most one edit must
    # be left; that is so if common beginning and end leave no more than one character of the longer rest.
    "op9_line_dedup": r"""
with t as (select doc_id, string_split(text, chr(10)) as ls from documents),
o as (select doc_id, unnest(range(len(ls))) as pos, unnest(ls) as line from t),
e as (select * from o where length(line) >= 20 and not regexp_full_match(line, '[ 	-
]*')),
f as (select line, min((doc_id, pos)) as place, length(line) as n from e group by line),
g as (select *, unnest(range(n - 2, n + 3)) as o, substr(line, 14, 13) as mid from f where n >= 40),
h as (select *, unnest(range(12, 17)) as s from f where n >= 40),
met as (select a.line as x, b.line as y from g a join f b on a.o = b.n and left(a.line, 13) = left(b.line, 13) where b.n >= 40 and a.place < b.place
union select a.line, b.line from g a join f b on a.o = b.n and right(a.line, 13) = right(b.line, 13) where b.n >= 40 and a.place < b.place
union select a.line, b.line from g a join h b on a.o = b.n and a.mid = substr(b.line, b.s, 13) where a.place < b.place),
chars as (select y, string_split(x, '') as p, string_split(y, '') as q from met),
first as (select *, coalesce(list_position(list_transform(list_zip(p, q), lambda z: z[1] is distinct from z[2]), true), len(p) + 1) as i from chars),
rest as (select y, p[i + 1:] as p, q[i + 1:] as q from first union all select y, p[i + 1:], q[i:] from first union all select y, p[i:], q[i + 1:] from first),
apart as (select y, greatest(len(p), len(q)) as n, p = q as same, list_position(list_transform(list_zip(p, q), lambda z: z[1] is distinct from z[2]), true) - 1 as fore, list_position(list_transform(list_zip(list_reverse(p), list_reverse(q)), lambda z: z[1] is distinct from z[2]), true) - 1 as aft from rest),
near as (select distinct y as line from apart where same or fore + aft >= n - 1),
gone as (select e.doc_id, list(e.pos order by e.pos) as dropped from e join f on e.line = f.line left join near on e.line = near.line where (e.doc_id, e.pos) <> f.place or near.line is not null group by 1)
select doc_id, coalesce(len(ls), 0) as n_lines, coalesce(len(dropped), 0) as n_dropped, coalesce(array_to_string(dropped, ','), '') as dropped from t left join gone using (doc_id)""",
    "op10_chat_format": r"""
with recursive m as (select row_number() over () as r, * from (select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as raw from conversations)),
x as (select r, unnest(range(len(a))) as i, unnest(a) as line from (select r, regexp_split_to_array(raw, '\r?\n') as a from m)),
y as (select r, i, length(translate(regexp_extract(line, '^((?:[ \t]*>)+)', 1), ' ' || chr(9), '')) as level, regexp_replace(line, '^((?:[ \t]*>)+)', '') as body from x),
z as (select *, coalesce(lead(level) over (partition by r order by i), 0) as following from y),
t as (select r, regexp_replace(coalesce(string_agg(body, chr(10) order by i) filter (level = 0 and not (following > 0 and regexp_matches(body, '(?i)\b(wrote|writes|said)\s*:\s*$'))), ''), '^\s+|\s+$', '', 'g') as text from z group by r),
f as (select m.*, t.text from m join t using (r)),
g as (select *, sum(case when level is distinct from prev then 1 else 0 end) over (partition by r order by i) as run from (select *, lag(level) over (partition by r order by i) as prev from y)),
n as (select r, run, level, i, trim(regexp_replace(regexp_replace(lower(body), '[*_`]', '', 'g'), '\s+', ' ', 'g')) as line from g where level > 0),
a as (select r, run, level, list(line order by i) as ls from n where line <> '' group by all),
b as (select *, unnest(list_distinct([1, case when len(ls) >= 64 then 64 when len(ls) >= 32 then 32 when len(ls) >= 16 then 16 when len(ls) >= 8 then 8 when len(ls) >= 4 then 4 when len(ls) >= 2 then 2 else 1 end])) as s from a),
c as (select *, unnest(list_distinct(list_concat(range(0, len(ls) - s + 1, s), [len(ls) - s]))) as skip from b),
q as (select distinct conv_id, turn, level, s, array_to_string(ls[skip + 1:skip + s], chr(10)) as unit from c join m using (r)),
e as (select conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda z: trim(regexp_replace(regexp_replace(lower(z), '[*_`]', '', 'g'), '\s+', ' ', 'g'))), lambda z: z <> '') as ls from f),
d as (select *, unnest(range(len(ls) - s + 1)) as skip from (select *, unnest([1, 2, 4, 8, 16, 32, 64]) as s from e) where len(ls) >= s),
w as (select distinct conv_id, turn as parent, s, array_to_string(ls[skip + 1:skip + s], chr(10)) as unit from d),
v as (select q.conv_id, q.turn, level, s, unit, max(w.parent) as parent from q join w using (conv_id, s, unit) where w.parent < q.turn group by all),
votes as (select conv_id, turn, level, parent, sum(s) as n from v group by all),
k as (select conv_id, turn, max((-level, n, parent))[3] as parent from votes group by all),
up as (select conv_id, turn, parent, parent as root from k union select up.conv_id, up.turn, up.parent, k.parent from up join k on k.conv_id = up.conv_id and k.turn = up.root),
roots as (select conv_id, turn, parent, min(root) as root from up group by all),
o as (select f.conv_id, f.turn, role, text, parent, coalesce(root, f.turn) as root from f left join roots using (conv_id, turn) where trim(text) <> ''),
p as (select *, row_number() over (partition by conv_id order by root nulls first, turn nulls first, role, text) - 1 as i from o)
select conv_id, i // 256 as part, count(*) as n_messages, count(parent) as n_linked, string_agg('<|' || role || '|>' || chr(10) || replace(text, '<|', '< |') || chr(10) || '<|end|>' || chr(10), '' order by i) as text from p group by conv_id, i // 256""",
}
