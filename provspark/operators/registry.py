"""Published revisions, attachments and reviews as tables; publication is idempotent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.operators.check import cascade
from provspark.schemas import DIGEST

#: Fixed value: the longest listing.
MOST_LISTED = 1000


def listing(revisions: DataFrame, limit: int = 100) -> DataFrame:
    """Newest first, at most ``limit`` held to 1..1000; equal times by fingerprint. A top-k, not a full sort."""
    return revisions.orderBy(F.desc("published_at"), F.desc("fingerprint")).limit(max(1, min(MOST_LISTED, limit)))


def described(revisions: DataFrame, reviews: DataFrame, attachments: DataFrame) -> DataFrame:
    """Each revision with how many reviews and attachments it has; both sides are counted before they are joined."""
    seen = reviews.groupBy(F.col("target").alias("fingerprint")).agg(F.count("*").alias("reviews"))
    files = attachments.groupBy("fingerprint").agg(F.count("*").alias("attachments"), F.count_if("stored").alias("stored"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return revisions.join(seen, "fingerprint", "left").join(files, "fingerprint", "left").select(*revisions.columns, zero("reviews"), zero("attachments"), zero("stored"))


def publish(new: DataFrame, existing: DataFrame, key: str = "fingerprint") -> DataFrame:
    """``new`` once a key with ``created``: false where the key is there already."""
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    return new.dropDuplicates([key]).join(known, key, "left").withColumn("created", F.col("_known").isNull()).drop("_known")


def review_status(reviews: DataFrame, revisions: DataFrame, fingerprint_ok: Column) -> DataFrame:
    """``reviews`` with ``status``: invalid, tampered, unknown_target or accepted."""
    known = revisions.select(F.col("fingerprint").alias("target")).distinct().withColumn("_known", F.lit(True))
    status = cascade((~F.coalesce(F.col("target").rlike(DIGEST), F.lit(False)), "invalid"), (~fingerprint_ok, "tampered"), (F.col("_known").isNull(), "unknown_target"), otherwise="accepted")
    return reviews.join(known, "target", "left").withColumn("status", status).drop("_known")


def review_list(reviews: DataFrame, target: str) -> DataFrame:
    """The reviews of one revision, oldest first."""
    return reviews.where(F.col("target") == target).orderBy("published_at", "fingerprint")


def outside(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Rows whose list ``column`` cites an activity that ``known(activity_id)`` has not, with the ids as ``unknown``."""
    cited = rows.select(*[c for c in rows.columns if c != column], F.explode(column).alias("activity_id"))
    bad = cited.join(known.select("activity_id").distinct(), "activity_id", "left_anti")
    keys = [c for c in rows.columns if c != column]
    return bad.groupBy(*keys).agg(F.array_sort(F.collect_set("activity_id")).alias("unknown"))


def stored_once(uploads: DataFrame) -> DataFrame:
    """Attachment bytes by content: ``(sha256, size)`` once each, whatever names they came under."""
    return uploads.select(F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"), F.octet_length("content").cast("long").alias("size")).distinct()


def put_attachments(uploads: DataFrame, declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(judged, blobs)`` of uploads ``(fingerprint, name, content)`` against what revisions declare.

    ``judged(fingerprint, name, size, sha256, status)``: accepted, undeclared, or altered where size or SHA-256 is not the
    declared one. ``blobs(sha256, size, content)`` has the bytes of the accepted ones, once each whatever their names.
    """
    seen = uploads.select("fingerprint", "name", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"), "content")
    want = declared.select("fingerprint", "name", F.regexp_replace("sha256", "^sha256:", "").alias("_sha"), F.col("size").cast("long").alias("_size"))
    status = cascade((F.col("_sha").isNull(), "undeclared"), (~(F.col("_sha").eqNullSafe(F.col("sha256")) & F.col("_size").eqNullSafe(F.col("size"))), "altered"), otherwise="accepted")
    judged = seen.join(want, ["fingerprint", "name"], "left").withColumn("status", status)
    blobs = judged.where("status = 'accepted'").select("sha256", "size", "content").dropDuplicates(["sha256"])
    return judged.select("fingerprint", "name", "size", "sha256", "status"), blobs


def read_attachments(stored: DataFrame, blobs: DataFrame) -> DataFrame:
    """``stored(fingerprint, name, sha256, size)`` with ``status``, the bytes hashed anew: available, missing or damaged."""
    now = blobs.select(F.regexp_replace("sha256", "^sha256:", "").alias("_key"), F.sha2("content", 256).alias("_now"), F.octet_length("content").cast("long").alias("_size"))
    joined = stored.withColumn("_key", F.regexp_replace("sha256", "^sha256:", "")).join(now, "_key", "left")
    status = cascade((F.col("_now").isNull(), "missing"), ((F.col("_now") != F.col("_key")) | ~F.col("_size").eqNullSafe(F.col("size")), "damaged"), otherwise="available")
    return joined.select(*stored.columns, status.alias("status"))


def publish_reviews(reviews: DataFrame, revisions: DataFrame, existing: DataFrame, fingerprint_ok: Column) -> DataFrame:
    """``reviews(fingerprint, target, ...)`` with ``status``: as ``review_status``, and created or known where it is accepted."""
    judged = review_status(reviews, revisions, fingerprint_ok).dropDuplicates(["fingerprint"])
    there = existing.select("fingerprint").distinct().withColumn("_there", F.lit(True))
    outcome = F.when(F.col("_there"), "known").otherwise("created")
    return judged.join(there, "fingerprint", "left").withColumn("status", F.when(F.col("status") == "accepted", outcome).otherwise(F.col("status"))).drop("_there")


def checked_revisions(asked: DataFrame, manifests: DataFrame, problems: DataFrame) -> DataFrame:
    """``asked(fingerprint)`` with ``status`` of what a registry returned for it; nothing it says is trusted.

    ``manifests(fingerprint, computed)`` is the returned text's own fingerprint under the one asked for,
    ``problems(fingerprint)`` the rules it breaks: missing, another revision, invalid, or valid.
    """
    bad = problems.select("fingerprint").distinct().withColumn("_bad", F.lit(True))
    joined = asked.join(manifests.select("fingerprint", F.col("computed").alias("_own"), F.lit(True).alias("_found")), "fingerprint", "left").join(bad, "fingerprint", "left")
    status = cascade((F.col("_found").isNull(), "missing"), (F.coalesce(F.col("_bad"), F.lit(False)), "invalid"), (~F.col("_own").eqNullSafe(F.col("fingerprint")), "another revision"), otherwise="valid")
    return joined.withColumn("status", status).drop("_own", "_found", "_bad")
