"""Verification and inspection of capsules: one plan over many archives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.functions import canon
from provspark.operators import check, manifest, review
from provspark.operators.archive import ATTACHMENTS, WORKSPACE, SizePolicy
from provspark.scratch import materialize
from provspark.sources import capsule


def outlined(entries: DataFrame, profile: str, terms: Sequence[str]) -> DataFrame:
    """``manifest.OUTLINE`` of each capsule's manifest, as a table: what it says is read once and joined by capsule."""
    return materialize(manifest.outline(capsule.manifests(entries), profile, terms).withColumnRenamed("manifest", "capsule"), "outlines")


def declared_files(outlines: DataFrame, kind: str = "files") -> DataFrame:
    """``(capsule, name, sha256, size)`` of the workspace and the attachments that manifests declare, or of referenced workspaces (``far``)."""
    return outlines.select("capsule", F.explode(kind).alias("f")).select("capsule", F.col("f.id").alias("name"), "f.sha256", F.col("f.size").try_cast("long").alias("size"))


def verify(spark: SparkSession, path: str, profile: str, terms: Sequence[str], reviews: DataFrame | None = None, policy: SizePolicy = SizePolicy()) -> tuple[DataFrame, DataFrame]:
    """``verify_entries`` of all capsules under ``path``."""
    return verify_entries(capsule.read_entries(spark, path, policy), profile, terms, reviews)


def verify_entries(entries: DataFrame, profile: str, terms: Sequence[str], reviews: DataFrame | None = None, workspaces: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(verdicts, problems)`` of the capsules that ``entries`` were read from.

    ``verdicts(capsule, valid, fingerprint, workspace, problems)``: workspace is ``integrity_only`` when its size and
    SHA-256 were checked, ``not_available`` when it is referenced. ``workspaces(iri, sha256, size)`` gives referenced ones that
    were fetched: such a workspace is checked like an included one. ``problems(capsule, subject, problem)`` are entry
    refusals, manifest rules, and files that differ from their declaration. ``reviews(capsule, review, cited)`` adds
    those that cite activities the capsule has not.
    """
    return _verified(entries, outlined(entries, profile, terms), reviews, workspaces)


def _verified(entries: DataFrame, outlines: DataFrame, reviews: DataFrame | None = None, workspaces: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    names = entries.select("capsule").distinct()
    refused = entries.where("refusal is not null").select("capsule", F.col("name").alias("subject"), F.col("refusal").alias("problem"))
    broken = entries.where("problem is not null").select("capsule", F.coalesce("name", F.lit("archive")).alias("subject"), "problem")
    bare = names.join(outlines.select("capsule"), "capsule", "left_anti").select("capsule", F.lit("archive").alias("subject"), F.lit("no manifest").alias("problem"))
    rules = outlines.select("capsule", F.inline("problems"))
    present = entries.where("refusal is null and ord >= 0").where(F.col("name").startswith(ATTACHMENTS) | (F.col("name") == WORKSPACE)).select("capsule", "name", "sha256", "size")
    both = declared_files(outlines).select("capsule", "name", F.struct("sha256", "size").alias("d")).join(present.select("capsule", "name", F.struct("sha256", "size").alias("p")), ["capsule", "name"], "full_outer")
    differing = both.where("not (d <=> p)").select("capsule", F.col("name").alias("subject"), check.cascade((F.col("d").isNull(), "undeclared"), (F.col("p").isNull(), "missing"), otherwise="altered").alias("problem"))
    parts = [refused, broken, bare, rules, differing]
    if reviews is not None:
        actions = outlines.select("capsule", F.explode("actions").alias("activity_id"))
        cited = reviews.select("capsule", "review", F.explode("cited").alias("activity_id")).join(actions, ["capsule", "activity_id"], "left_anti")
        parts.append(cited.select("capsule", F.col("review").alias("subject"), F.lit("cites an activity the capsule has not").alias("problem")).distinct())
    fetched = None
    if workspaces is not None:
        want = declared_files(outlines, "far").select("capsule", F.col("name").alias("iri"), F.struct("sha256", "size").alias("d"))
        fetched = want.join(workspaces.select("iri", F.struct("sha256", "size").alias("p")), "iri")
        parts.append(fetched.where("not (d <=> p)").select("capsule", F.col("iri").alias("subject"), F.lit("altered").alias("problem")))
    problems = check.all_problems(parts)
    held = entries.where((F.col("name") == WORKSPACE) & F.col("refusal").isNull()).select("capsule", F.lit("integrity_only").alias("workspace"))
    if fetched is not None:
        held = held.unionByName(fetched.select("capsule", F.lit("integrity_only").alias("workspace"))).distinct()
    root = outlines.select("capsule", F.explode("roots.fingerprint").alias("fingerprint"))
    counted = problems.groupBy("capsule").agg(F.count("*").alias("problems"))
    verdicts = names.join(root, "capsule", "left").join(held, "capsule", "left").join(counted, "capsule", "left")
    n = F.coalesce("problems", F.lit(0))
    return verdicts.select("capsule", (n == 0).alias("valid"), "fingerprint", F.coalesce("workspace", F.lit("not_available")).alias("workspace"), n.alias("problems")), problems


def inspect_entries(entries: DataFrame, profile: str, terms: Sequence[str], documents: DataFrame | None = None) -> tuple[manifest.Inspection, DataFrame, DataFrame | None]:
    """``(summary, integrity, documents)``: what capsules say, whether they are whole, and how supplied documents stand.

    ``integrity`` is that of ``verify_entries`` alone: what is wrong with a supplied document is no problem of the
    capsule. ``documents(capsule, kind, index, text)`` are reviews and reports as JSON; each gets a ``status``: valid,
    unreadable, its first problem, or that it cites an activity or a target that the capsule has not. Unreadable
    capsules have an integrity row, no summary, and no document rows.
    """
    outlines, said = outlined(entries, profile, terms), manifest.inspect(capsule.manifests(entries))
    verdicts, _ = _verified(entries, outlines)
    if documents is None:
        return said, verdicts, None
    given = documents.withColumn("_plain", canon.canonical_text(F.col("text")))
    reviews = review.review_problems(given.where("kind = 'review'"))
    reports = review.report_problems(given.where("kind = 'report'"))
    judged = reviews.unionByName(reports)
    readable = outlines.where("not unreadable").select("capsule", F.explode_outer("roots.fingerprint").alias("_fp"), F.col("actions").alias("_acts"))
    cited = F.from_json("text", "activity_id string, target string, reports array<struct<activity_id:string>>")
    joined = judged.withColumn("_c", cited).join(readable, "capsule")
    own = F.coalesce("_acts", F.array().cast("array<string>"))
    foreign = F.exists(F.coalesce("_c.reports", F.array().cast("array<struct<activity_id:string>>")), lambda r: ~F.array_contains(own, r["activity_id"]))
    status = check.cascade(
        (F.col("_plain").isNull(), "unreadable"),
        (F.size("problems") > 0, "_first"),
        ((F.col("kind") == "review") & ~F.col("_c.target").eqNullSafe(F.col("_fp")), "another revision"),
        ((F.col("kind") == "review") & F.coalesce(foreign, F.lit(False)), "cites an activity the capsule has not"),
        ((F.col("kind") == "report") & ~F.coalesce(F.array_contains(own, F.col("_c.activity_id")), F.lit(False)), "cites an activity the capsule has not"),
        otherwise="valid",
    )
    shown = joined.withColumn("status", status).withColumn("status", F.when(F.col("status") == "_first", F.get("problems", F.lit(0))).otherwise(F.col("status")))
    return said, verdicts, shown.select("capsule", "kind", "index", "status")


def rebuilt(stored: DataFrame, made: DataFrame) -> DataFrame:
    """``(workspace_id, described)``: whether a stored manifest's fingerprint is that of the one built from its ledger.

    ``stored(workspace_id, fingerprint)``, ``made(workspace_id, fingerprint)``; without a ledger it is not.
    """
    found = stored.select("workspace_id", F.col("fingerprint").alias("_s")).join(made.select("workspace_id", F.col("fingerprint").alias("_m")), "workspace_id", "left")
    return found.select("workspace_id", F.coalesce(F.col("_s") == F.col("_m"), F.lit(False)).alias("described"))
