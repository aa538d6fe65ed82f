"""Readings of plain records as JSON, digests, numbers, fingerprints and timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.catalog import Tables, query
from provspark.functions import canon, fingerprint
from provspark.operators import archive


@query("""select n_nationkey, 'sha256:' || sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '","region":' || n_regionkey || '}') as digest from nation""")
def json_digest_flat(t: Tables) -> DataFrame:
    fields = {"name": canon.json_string(F.col("n_name")), "key": F.col("n_nationkey").cast("string"), "region": F.col("n_regionkey").cast("string")}
    return t.nation.select("n_nationkey", canon.flat_digest(fields).alias("digest"))


@query("""select p_partkey, '{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}' as text from part""")
def canonical_json(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", canon.canonical_text(F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")))).alias("text"))


@query("""
select environment_id, count(*) as n from (select 'sha256:' || sha256('{"brand":"' || p_brand || '","size":' || p_size || '}') as environment_id from part) group by 1
""")
def environment_id(t: Tables) -> DataFrame:
    ident = canon.flat_digest({"brand": canon.json_string(F.col("p_brand")), "size": F.col("p_size").cast("string")})
    return t.part.select(ident.alias("environment_id")).groupBy("environment_id").agg(F.count("*").alias("n"))


@query(r"select o_orderkey, regexp_replace(cast(o_totalprice as varchar), '\.0$', '') as text from orders")
def canonical_numbers(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", canon.number_column(F.col("o_totalprice")).alias("text"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.') || lpad(cast(extract(millisecond from o_orderdate) % 1000 as varchar), 3, '0') || 'Z' as text from orders")
def utc_timestamps(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", archive.utc_text(F.col("o_orderdate")).alias("text"))


@query("select doc_id, substr(sha256(text), 1, 12) as short from documents where text is not null")
def short_ids(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", archive.short_id(canon.binary_digest(F.encode("text", "UTF-8"))).alias("short"))


@query("select event_id, 'k' as item, json_extract_string(props, '$.k') as value from events")
def flatten_context(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("item", "value"))


@query("select event_id, 'sha256:' || sha256(replace(props, ' ', '')) as digest from events")
def metadata_digest(t: Tables) -> DataFrame:
    return t.events.select("event_id", canon.typed_digest(F.col("props")).alias("digest"))


@query()
def signal_fingerprint(t: Tables) -> DataFrame:
    axis = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i.cast("double"))
    objects = t.embeddings.select(F.col("vec_id").cast("string").alias("object_uuid"), F.lit("signal").alias("kind"), axis.alias("x"), F.col("embedding").alias("y"), F.lit("<f4").alias("dtype"), F.lit("s").alias("xunit"))
    return fingerprint.state_facts(objects).select("object_uuid", "fp_scheme", "fp_value", "dtype", "length")


@query()
def image_fingerprint(t: Tables) -> DataFrame:
    objects = t.embeddings.select(F.col("vec_id").cast("string").alias("object_uuid"), F.lit("image").alias("kind"), F.col("embedding").alias("data"), F.lit("<f4").alias("dtype"), F.array(F.lit(8), F.lit(8)).alias("shape"))
    return fingerprint.state_facts(objects).select("object_uuid", "fp_scheme", "fp_value", "dtype", F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape"))
