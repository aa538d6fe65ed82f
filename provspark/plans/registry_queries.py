"""Readings of documents, labels and pages as registry tables, files and archive entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.catalog import Tables, query
from provspark.functions import canon
from provspark.operators import archive, check, history, registry


def _revisions(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("fingerprint"), F.col("source").alias("name"), F.col("n_chars").alias("published_at"))


@query("select doc_id as fingerprint, source as name, n_chars as published_at from documents order by n_chars desc, doc_id desc limit 100")
def registry_listing(t: Tables) -> DataFrame:
    return registry.listing(_revisions(t))


@query("""
select d.doc_id as fingerprint, source as name, n_chars as published_at, coalesce(r.n, 0) as reviews, coalesce(a.n, 0) as attachments, coalesce(a.s, 0) as stored from documents d
left join (select doc_id, count(*) as n from labels group by 1) r using (doc_id) left join (select page_id, count(*) as n, count(*) filter (where length(html) > 2000) as s from pages group by 1) a on page_id = d.doc_id
""")
def registry_described(t: Tables) -> DataFrame:
    reviews = t.labels.select(F.col("doc_id").alias("target"))
    files = t.pages.select(F.col("page_id").alias("fingerprint"), (F.length("html") > 2000).alias("stored"))
    return registry.described(_revisions(t), reviews, files)


@query("select doc_id as fingerprint, doc_id not in (select doc_id from labels where quality = 1) as created from documents")
def publish_idempotent(t: Tables) -> DataFrame:
    new = t.documents.select(F.col("doc_id").alias("fingerprint"))
    return registry.publish(new.unionByName(new), t.labels.where("quality = 1").select(F.col("doc_id").alias("fingerprint")))


@query("""
select doc_id as review, case when quality = 0 and toxic = 1 then 'invalid' when doc_id % 6 = 5 then 'tampered' when doc_id % 4 = 3 then 'unknown_target' else 'accepted' end as status from labels
""")
def review_membership(t: Tables) -> DataFrame:
    digest = lambda c: F.concat(F.lit("sha256:"), F.sha2(c.cast("string"), 256))
    reviews = t.labels.select(F.col("doc_id").alias("review"), F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "bad").otherwise(digest(F.col("doc_id"))).alias("target"))
    revisions = t.documents.where("doc_id % 4 <> 3").select(digest(F.col("doc_id")).alias("fingerprint"))
    return registry.review_status(reviews, revisions, F.col("review") % 6 != 5).select("review", "status")


@query("select l_orderkey as review, string_agg(distinct l_suppkey::varchar, ',' order by l_suppkey::varchar) as unknown from lineitem where l_suppkey % 5 = 2 group by l_orderkey")
def cited_activities(t: Tables) -> DataFrame:
    reviews = t.lineitem.groupBy(F.col("l_orderkey").alias("review")).agg(F.collect_list(F.col("l_suppkey").cast("string")).alias("cited"))
    known = t.supplier.where("s_suppkey % 5 <> 2").select(F.col("s_suppkey").cast("string").alias("activity_id"))
    return registry.outside(reviews, "cited", known).select("review", F.array_join("unknown", ",").alias("unknown"))


@query("select distinct 'sha256:' || sha256(html) as sha256, octet_length(encode(html)) as size from pages where html is not null")
def stored_once(t: Tables) -> DataFrame:
    return registry.stored_once(t.pages.where("html is not null").select(F.encode("html", "UTF-8").alias("content")))


@query("""
with p as (select cast(page_id as varchar) as name, 'sha256:' || sha256(html) as sha256, octet_length(encode(html)) as size from pages),
d as (select name, case when cast(name as bigint) % 9 = 4 then 'sha256:0' else sha256 end as w, size from p where cast(name as bigint) % 5 <> 0), h as (select * from p where cast(name as bigint) % 7 <> 0)
select coalesce(d.name, h.name) as name, case when h.name is null then 'missing' when d.name is null then 'undeclared' when w <> sha256 then 'altered' else 'available' end as status from d full outer join h on d.name = h.name
""")
def attachment_check(t: Tables) -> DataFrame:
    files = t.pages.select("page_id", F.col("page_id").cast("string").alias("name"), canon.binary_digest(F.encode("html", "UTF-8")).alias("sha256"), F.octet_length("html").cast("long").alias("size"))
    declared = files.where("page_id % 5 <> 0").withColumn("sha256", F.when(F.col("page_id") % 9 == 4, "sha256:0").otherwise(F.col("sha256")))
    return check.declared_against_present(declared, files.where("page_id % 7 <> 0"))


_NAMES = """
n as (select page_id, regexp_replace(regexp_extract(url, '://[^/]*/(.*)$', 1), '[^A-Za-z0-9._-]+', '_', 'g') as p from pages),
s as (select page_id, substr(case when regexp_matches(p, '^[A-Za-z0-9]') then p else 'file' || p end, 1, 96) as base from n)
"""


def _names(t: Tables) -> DataFrame:
    return t.pages.select("page_id", archive.sanitized(F.regexp_extract("url", "://[^/]*/(.*)$", 1)).alias("base"))


@query(f"with {_NAMES} select page_id, base, regexp_matches(base, '^[A-Za-z0-9][A-Za-z0-9._-]{{0,99}}$') as valid from s")
def attachment_sanitize(t: Tables) -> DataFrame:
    return _names(t).withColumn("valid", archive.valid_attachment_name(F.col("base")))


@query(f"with {_NAMES}, b as (select page_id, substr(base, 1, 2) as stem from s), k as (select *, row_number() over (partition by stem order by page_id) as k from b) select page_id, case when k = 1 then stem else k || '-' || stem end as name from k")
def unique_attachment_names(t: Tables) -> DataFrame:
    return history.unique_names(_names(t).select("page_id", F.substring("base", 1, 2).alias("stem")), "stem", ["page_id"], "name").select("page_id", "name")


@query(r"""
with e as (select page_id, case page_id % 12 when 0 then '' when 1 then '/abs' when 2 then 'a\b' when 3 then 'x/../y' when 4 then 'C:x' when 5 then 'workspace.h5' when 6 then 'attachments/-bad' when 7 then 'other.txt' when 8 then 'attachments/f' || page_id else 'ro-crate-metadata.json' end as name,
 page_id // 24 as archive, length(html) as size from pages),
c as (select *, count(*) over (partition by archive, name) as n from e)
select page_id, name, case when name = '' then 'empty' when starts_with(name, '/') then 'absolute' when contains(name, '\') then 'backslash' when contains(name, '..') then 'parent' when name = 'C:x' then 'drive' when n > 1 then 'duplicate'
 when name = 'attachments/-bad' then 'attachment_name' when name = 'other.txt' then 'unexpected' when page_id % 5 = 1 then 'encrypted' when page_id % 7 = 1 then 'symlink' when page_id % 11 = 1 then 'compressed'
 when starts_with(name, 'attachments/') and size > 3000 then 'too_large' end as refusal from c
""")
def archive_entry_check(t: Tables) -> DataFrame:
    m = F.col("page_id") % 12
    name = F.when(m == 0, "").when(m == 1, "/abs").when(m == 2, "a\\b").when(m == 3, "x/../y").when(m == 4, "C:x").when(m == 5, archive.WORKSPACE).when(m == 6, "attachments/-bad").when(m == 7, "other.txt").when(m == 8, F.concat(F.lit("attachments/f"), F.col("page_id").cast("string"))).otherwise(archive.MANIFEST)
    entries = t.pages.select("page_id", name.alias("name"), F.expr("page_id div 24").alias("archive"), F.length("html").cast("long").alias("size"), (F.col("page_id") % 5 == 1).alias("encrypted"), (F.col("page_id") % 7 == 1).alias("symlink"), (F.col("page_id") % 11 == 1).alias("compressed"))
    return archive.entry_refusals(entries, "archive", archive.SizePolicy(attachment=3000)).select("page_id", "name", "refusal")


@query("""
select page_id, regexp_matches(upper(split_part(base, '.', 1)), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') or ends_with(base, '.') as not_portable from
(select page_id, case page_id % 5 when 0 then 'con' when 1 then 'aux.txt' when 2 then 'name.' when 3 then 'lpt9.x' else 'conx' end as base from pages)
""")
def portable_names(t: Tables) -> DataFrame:
    m = F.col("page_id") % 5
    name = F.when(m == 0, "con").when(m == 1, "aux.txt").when(m == 2, "name.").when(m == 3, "lpt9.x").otherwise("conx")
    return t.pages.select("page_id", (~archive.portable(name)).alias("not_portable"))


@query("select page_id, (case page_id % 6 when 0 then false when 1 then false when 2 then false when 3 then false else true end) as valid from pages")
def locator_paths(t: Tables) -> DataFrame:
    m = F.col("page_id") % 6
    path = F.when(m == 0, "signals/g/o").when(m == 1, "/other/g/o").when(m == 2, "/signals/../o").when(m == 3, "/signals/g").when(m == 4, "/signals/g/o").otherwise("/images/g/o")
    return t.pages.select("page_id", archive.valid_path(path, ("signals", "images")).alias("valid"))
