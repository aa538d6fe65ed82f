"""Reviews and verification reports: creation, own fingerprints, validity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.functions import canon
from provspark.operators.compare import VERDICTS, overall
from provspark.schemas import DIGEST

# What reviewers may state, and the codes of reports.
STATEMENTS = ("endorsed", "disputed", "comment")
RESTORATIONS = ("included", "replayable", "opaque", "unavailable")
ELIGIBILITIES = ("ready", "missing_input", "input_changed", "unsupported_operation", "unsupported_contract", "unsupported_context", "invalid_parameters")
MATCHES = ("same", "different", "unknown")

_REPORT = "activity_id string, restoration string, eligibility string, verdict string, environment struct<match:string>, inputs array<struct<role:string,state_id:string,status:string>>, outputs array<struct<role:string,recorded:string,status:string,verdict:string>>"
_REVIEW = "target string, reviewer struct<name:string>, date string, statement string, verdict string, review_fingerprint string, reports array<struct<activity_id:string,verdict:string>>"


def review_json(kind: str, target: Column, reviewer: Column, identifier: Column, date: Column, statement: Column, verdict: Column, cited: Column) -> Column:
    """Canonical JSON of a review without its fingerprint; ``cited`` is an array of (activity_id, verdict)."""
    text = canon.json_string
    each = F.transform(cited, lambda c: canon.flat_json({"activity_id": text(c["activity_id"]), "verdict": text(c["verdict"])}))
    reports = F.concat(F.lit("["), F.coalesce(F.array_join(each, ","), F.lit("")), F.lit("]"))
    return canon.flat_json({"review": F.lit(canon.string_text(kind)), "review_version": F.lit("1"), "target": text(target), "reviewer": canon.flat_json({"name": text(reviewer), "identifier": text(identifier)}), "date": text(date), "statement": text(statement), "verdict": text(verdict), "reports": reports})


def signed(review: Column) -> Column:
    """The fingerprint of a review's canonical JSON."""
    return canon.binary_digest(F.encode(review, "UTF-8"))


def _listed(checks: Sequence[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(problem)) for test, problem in checks]))


def review_problems(reviews: DataFrame, text: str = "text") -> DataFrame:
    """``reviews`` with ``problems``: what their JSON breaks, a fingerprint that is not their content's included."""
    parsed = reviews.withColumn("_r", F.from_json(text, _REVIEW))
    r = F.col("_r")
    unsigned = canon._mapped(lambda t: canon.json_digest({k: v for k, v in canon.load_json(t).items() if k != "review_fingerprint"}))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    checks = [
        (~F.coalesce(r["target"].rlike(DIGEST), F.lit(False)), "invalid target"),
        (blank(r["reviewer"]["name"]), "no reviewer"), (blank(r["date"]), "no date"), (blank(r["statement"]), "no statement"),
        (r["verdict"].isNotNull() & ~r["verdict"].isin(*STATEMENTS), "unknown verdict"),
        (r["reports"].isNull() | F.exists(r["reports"], lambda c: blank(c["activity_id"]) | ~F.coalesce(c["verdict"].isin(*VERDICTS), F.lit(False))), "invalid reports"),
        (~r["review_fingerprint"].eqNullSafe(F.col("_own")), "fingerprint does not match"),
    ]
    return parsed.withColumn("_own", unsigned(F.col(text))).withColumn("problems", _listed(checks)).drop("_r", "_own")


def report_problems(reports: DataFrame, text: str = "text") -> DataFrame:
    """``reports`` with ``problems``: codes that are none, or a verdict that is not the most severe of its outputs."""
    parsed = reports.withColumn("_r", F.from_json(text, _REPORT))
    r = F.col("_r")
    other = lambda c, known: ~F.coalesce(c.isin(*known), F.lit(False))
    rank = lambda c: F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), c)
    worst = F.array_max(F.transform(r["outputs"], lambda o: rank(o["verdict"])))
    checks = [
        (F.coalesce(r["activity_id"], F.lit("")) == "", "no activity"), (other(r["restoration"], RESTORATIONS), "unknown restoration"), (other(r["eligibility"], ELIGIBILITIES), "unknown eligibility"),
        (other(r["verdict"], VERDICTS), "unknown verdict"), (other(r["environment"]["match"], MATCHES), "unknown environment match"), (r["inputs"].isNull(), "no inputs"),
        ((F.size(r["outputs"]) > 0) & (worst != rank(r["verdict"])), "verdict is not the most severe"),
    ]
    return parsed.withColumn("problems", _listed(checks)).drop("_r")


def build_reports(activities: DataFrame, outputs: DataFrame) -> DataFrame:
    """``activities(activity_id, restoration, eligibility, match)`` with the verdict over ``outputs(activity_id, position,
    role, verdict, rule, mismatches)``, and the rule and observations of the first compared output."""
    verdicts = overall(outputs, ["activity_id"], compared=F.col("rule").isNotNull()).withColumnRenamed("verdict", "_v")
    first = outputs.select("activity_id", F.col("position").alias("first_compared"), "rule", "mismatches")
    joined = activities.join(verdicts, "activity_id", "left").join(first, ["activity_id", "first_compared"], "left")
    verdict = F.when(F.col("eligibility") == "ready", F.coalesce("_v", F.lit("not_verified"))).otherwise("not_verified")
    return joined.select(*activities.columns, verdict.alias("verdict"), "rule", "mismatches")
