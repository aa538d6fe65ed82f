"""The queries of this subpackage and their SQL for the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.llm import decontam, linededup, lmscore, packing, qualityclf, qualityrules, sharding, simhash, tokenstore, urlfilter
from provspark.llm.common import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by its url, or by what it is an alias of. Null urls and those without ``://`` have empty parts and are allowed; repeated rows stay; no pages: no rows."""
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def _node(x: str) -> str:
    """SQL of the resource that the url ``x`` names."""
    plain = f"regexp_replace(trim({x}), '(?s)#.*$', '')"
    part = lambda pattern, k: f"regexp_extract({plain}, '{pattern}', {k})"
    low = lambda y: f"translate({y}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host, path = (part("(?s)^.*?://([^/?#]*)([^?#]*)", k) for k in (1, 2))
    return f"case when contains({plain}, '://') then {low(part('(?s)^(.*?)://', 1))} || '://' || {low(host)} || case when {path} = '' then '/' else {path} end || {part('(?s)^[^?]*(\\?.*)$', 1)} else {plain} end"


OP1_SQL = rf"""
with recursive p as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages),
tags as (select url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^<>]*>')) as tag from p where contains(url, '://')),
hits as (select url, trim(case when regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?\s*canonical\b') then regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
  when regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?\s*refresh\b') then regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1) end) as raw from tags),
goals as (select url, replace(raw, '&amp;', '&') as t, regexp_extract(url, '(?s)^(.*?)://', 1) as scheme, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) as site, regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1) as folder from hits where raw <> ''),
whole as (select url, case when contains(t, '://') then t when starts_with(t, '//') then scheme || ':' || t when starts_with(t, '/') then site || t when ends_with(folder, '/') then folder || t else folder || '/' || t end as goal from goals),
one as (select distinct {_node('url')} as a, {_node('goal')} as b from whole), edges as (select a, b from one where a <> b union select b, a from one where a <> b),
u as (select page_id, url, {_node('url')} as node from p union all select null, a, a from edges),
x as (select *, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from u),
rules(h, q, action) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits as (select distinct x.host, x.path, first_value(h || q) over best as rule, first_value(action) over best as action from (select distinct host, path from x) x join rules on (x.host = h or ends_with(x.host, '.' || h)) and starts_with(x.path, q) window best as (partition by x.host, x.path order by length(h || q) desc)),
blocked(node) as (select x.url from x join fits using (host, path) where x.page_id is null and action = 'block' union select edges.b from blocked join edges on edges.a = blocked.node)
select page_id, x.host, x.path, rule, case when action is not null then action when node in (select node from blocked) then 'block' else 'allow' end as verdict from x left join fits on x.host = fits.host and x.path = fits.path where page_id is not null
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its group. Null, empty and wordless texts have fingerprint zero and link alike; repeated rows each get a row; a null id never names a group."""
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its place. A null text has one byte of size; null ids share a key; repeated rows get slots of their own."""
    return sharding.assign(table(spark, sf_dir, "documents"))


OP3_SQL = """
with d as (select doc_id, coalesce(text, '') as t, coalesce(doc_id::varchar, '') as key from documents),
b as (select doc_id, key, octet_length(encode(t)) + 1 as size, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::bigint) as bytes from d),
c as (select doc_id, key, size, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) as crc from b),
s as (select *, list_transform(range(9), lambda s: -ln((('0x' || substr(md5(key || ':' || s), 1, 13))::bigint + 0.5) / 4503599627370496.0)) as scores, ('0x' || substr(md5(key || ':' || crc || ':block'), 1, 13))::bigint % 4096 as block from c),
p as (select *, list_position(scores[1:8], list_min(scores[1:8])) - 1 as shard, list_position(scores, list_min(scores)) - 1 as grown_shard from s)
select doc_id, size, crc as text_crc32, 'key' as law, shard, row_number() over (partition by shard order by block, doc_id nulls first, crc, size) - 1 as slot, grown_shard from p
"""


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to a store of its own and read back. A null or empty text is the end id alone; null ids come first; repeated rows are written once a row."""
    path, tokenizer = scratch_path(spark, "store"), vocabulary("byte_bpe_50k.json")
    tokenstore.write_store(table(spark, sf_dir, "documents"), path, tokenizer)
    return tokenstore.read_store(spark, path, tokenizer)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged. A null or empty text has no words and fails the base rules; repeated rows each get a row."""
    return qualityrules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("mean_ratio")


OP5_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d),
g as (select r, unnest(range(1, len(w) - 1)) as i, unnest([w[x] || ' ' || w[x + 1] || ' ' || w[x + 2] for x in range(1, len(w) - 1)]) as g from w where len(w) >= 3),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as n from g) where n > 1),
repeated as (select r, count(distinct i + k) as n from twice, (values (0), (1), (2)) k(k) group by r),
lines as (select r, unnest(string_split(t, chr(10))) as l from d),
dup as (select r, count(*) - count(distinct l) as n from lines where regexp_matches(l, '[^\x20\x09-\x0D]') group by r),
good as (select doc_id from (select distinct doc_id from labels where quality = 1 and toxic = 0 and doc_id is not null) order by md5(doc_id::varchar) limit 20000),
ch as (select r, doc_id in (select doc_id from good) as good, unnest(range(len(t))) as i, unnest(string_split(t, '')) as c from d where t <> ''),
tri as (select r, good, (unicode(c) * 66931 + unicode(lead(c) over o) * 1031 + unicode(lead(c, 2) over o)) % 262144 as b from ch window o as (partition by r order by i)),
n as (select b, count(*)::double as raw, count(*) filter (where good)::double as hit from tri where b is not null group by b),
s as (select sum(raw) as raws, sum(hit) as hits from n),
lr as (select b, case when hits = 0 then 0 else ln((hit + hits / raws) / (hits + hits / raws * 262144)) - ln((raw + 1) / (raws + 262144)) end as x from n, s),
m as (select r, avg(x) as mean from tri join lr using (b) group by r),
f as (select d.doc_id, len(w.w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
  coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(repeated.n, 0)::bigint as n_repeat_words, coalesce(mean, 0) as mean
  from d join w using (r) left join dup using (r) left join repeated using (r) left join m using (r)),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and mean >= -0.5 as kept from v
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without what an earlier place has. Null and empty texts stay as they are; null ids come first; equal rows are one document."""
    return linededup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), counted=True)


OP6_SQL = r"""
with d as (select doc_id, text, string_split(text, chr(10)) as lines from documents where text is not null),
l as (select doc_id, unnest(range(len(lines))) as a, unnest(list_transform(lines, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))) as words from d),
w as (select *, lead(a) over (partition by doc_id order by a) as next from l where words > 0),
p as (select doc_id, a, next as b from w where next is not null union all select doc_id, a, a from w where words >= 50),
s as (select doc_id, a, b, array_to_string(lines[a + 1 : b + 1], chr(10)) as bytes from p join d using (doc_id)),
f as (select *, first_value(doc_id) over o as first_id, first_value(b) over o as first_b, row_number() over o as place from s window o as (partition by bytes order by doc_id, a)),
gone as (select distinct doc_id, unnest(range(a, b + 1)) as pos from f where place > 1 and not (doc_id = first_id and a <= first_b)),
g as (select doc_id, list(pos) as gone from gone group by doc_id)
select o.doc_id, case when g.gone is null then o.text else array_to_string([lines[i + 1] for i in range(len(lines)) if not list_contains(g.gone, i)], chr(10)) end as text, coalesce(len(g.gone), 0) as removed_lines
from documents o left join d using (doc_id) left join g using (doc_id)
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in pieces. A null or empty text is the end id alone; repeated rows and ids are documents of their own."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored. A null or empty text is its end alone; a null id is never held out; repeated rows count and are scored each."""
    return lmscore.score(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every item. Null and empty texts match nothing; repeated rows are reported each."""
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
i as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from benchmark),
si as (select distinct item_id, least(5, len(w)) as k, unnest([array_to_string(w[x : x + least(5, len(w)) - 1], ' ') for x in range(1, len(w) - least(5, len(w)) + 2)]) as s from i where len(w) > 0),
n as (select item_id, count(*) as n_shingles from si group by item_id),
widths as (select distinct k from si),
sd as (select distinct r, doc_id, k, unnest([array_to_string(w[x : x + k - 1], ' ') for x in range(1, len(w) - k + 2)]) as s from d, widths where len(w) >= k),
hit as (select r, doc_id, item_id, count(*) as n_shared from sd join si using (k, s) group by r, doc_id, item_id)
select doc_id, item_id, n_shingles, n_shared, n_shared::double / n_shingles as containment
from hit join n using (item_id) where n_shared >= 0.8 * n_shingles - 1e-9
"""


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored. A null or empty text is scored as no bytes; a null id is never held out; repeated rows each get a row."""
    docs = table(spark, sf_dir, "documents")
    return qualityclf.score(docs, qualityclf.train(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Query]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_simhash": op2_simhash,
        "op3_sharding": op3_sharding,
        "op4_token_store": op4_token_store,
        "op5_quality_rules": op5_quality_rules,
        "op6_line_dedup": op6_line_dedup,
        "op7_packing": op7_packing,
        "op8_lm_scores": op8_lm_scores,
        "op9_decontamination": op9_decontamination,
        "op10_quality_classifier": op10_quality_classifier,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op3_sharding": OP3_SQL, "op5_quality_rules": OP5_SQL, "op6_line_dedup": OP6_SQL, "op9_decontamination": OP9_SQL}
