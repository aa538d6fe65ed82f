"""Command line: ``python -m provspark validate|verify|inspect|diff|attachment|workspace|create|review|registry|digest ...``.

Exit codes: 0 for valid or equal, 1 for problems or differences, 2 for a diff that cannot be made.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.functions import canon
from provspark.functions.environment import media_type
from provspark.operators import archive, diff, ledger, manifest, registry, review
from provspark.plans import build, verify
from provspark.sources import capsule

REVISIONS = "fingerprint string, name string, revision_of string, published_at string, text string"
FILES = "fingerprint string, name string, sha256 string, size long"
BLOBS = "sha256 string, size long, content binary"


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("provspark").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    """``(manifest, text)`` from a JSON file or from capsules."""
    if path.endswith(".json"):
        return spark.createDataFrame([(path, Path(path).read_text())], "manifest string, text string")
    return capsule.manifests(capsule.read_entries(spark, path))


def _cells(spark: SparkSession, path: str) -> DataFrame:
    """Entities of a manifest as one row an id, with their properties as JSON text; the fingerprint is left out."""
    props = manifest.properties(_manifests(spark, path)).where(f"ord >= 0 and prop <> '{manifest.FINGERPRINT}'")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("prop", "pos", "value"))), lambda p: F.concat_ws("=", p["prop"], p["value"]))
    return props.groupBy("id").agg(F.array_join(listed, "\n").alias("properties"))


def _shown(rows: DataFrame, most: int = 1000) -> list[dict]:
    return [r.asDict(recursive=True) for r in rows.limit(most).collect()]


def _written(path: str, data: bytes) -> None:
    with open(path, "xb") as out:  # never over a file that is there
        out.write(data)


def _capsule_rows(spark: SparkSession, path: str) -> DataFrame:
    return capsule.read_entries(spark, path, contents=True)


def create(spark: SparkSession, args: argparse.Namespace) -> int:
    """A capsule of a ledger as JSON, a workspace file and attachments."""
    found = ledger.from_json(spark.createDataFrame([(Path(args.ledger).read_text(),)], "text string"))
    bad = _shown(ledger.validate(found))
    if bad:
        print(json.dumps({"problems": bad}))
        return 1
    name = found.states.select("workspace_id").union(found.activities.select("workspace_id")).first()
    work = Path(args.workspace).read_bytes()
    files = [(i, Path(f).name, Path(f).read_bytes()) for i, f in enumerate(args.attach)]
    where = "" if name is None else name.workspace_id
    root = [(where, args.name, args.description, args.license, args.date, args.revision_of, None, canon.sha256(work).hexdigest(), len(work))]
    roots = spark.createDataFrame(root, "workspace_id string, name string, description string, license string, published string, revision_of string, workspace_ref string, workspace_sha256 string, workspace_size long")
    declared = [(where, i, n, media_type(n), len(b), f"sha256:{canon.sha256(b).hexdigest()}", "") for i, n, b in files]
    attachments = spark.createDataFrame(declared, "workspace_id string, ord int, name string, media_type string, size long, sha256 string, description string")
    words = build.Vocabulary(args.profile, args.profile, "1", args.terms, "workspace")
    locators = spark.createDataFrame([], "state_id string, kind string, path string")
    made = build.build(found, locators, roots, words, attachments).first()
    _written(args.to, capsule.archive_bytes([(archive.MANIFEST, made.text.encode()), (archive.WORKSPACE, work), *sorted((archive.ATTACHMENTS + n, b) for _, n, b in files)]))
    print(json.dumps({"fingerprint": made.fingerprint}))
    return 0


def sign_review(spark: SparkSession, args: argparse.Namespace) -> int:
    """A review of a revision, with its fingerprint; what it cites must be in the manifest."""
    props = manifest.properties(_manifests(spark, args.path)).cache()
    target = manifest.entities(props, {"fp": manifest.FINGERPRINT}).where("id = './'").select(manifest.text_of(F.col("fp"))).first()[0]
    known = {r.id.removeprefix("#activity-") for r in manifest.summary(props).select("id").collect()}
    cited = [dict(zip(("activity_id", "verdict"), c.split("=", 1))) for c in args.cite]
    if lost := [c["activity_id"] for c in cited if c["activity_id"] not in known]:
        print(f"no such activity: {lost[0]}", file=sys.stderr)
        return 1
    made = {"review": args.schema, "review_version": 1, "target": target, "reviewer": {"name": args.reviewer, "identifier": None}, "date": args.date, "statement": args.statement, "verdict": args.verdict, "reports": cited}
    whole = canon.canonical_json(made | {"review_fingerprint": canon.json_digest(made)})
    problems = review.review_problems(spark.createDataFrame([(whole,)], "text string")).first().problems
    if problems:
        print(json.dumps({"problems": problems}))
        return 1
    _written(args.to, whole.encode())
    return 0


def _table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    path = Path(folder) / name
    return spark.read.schema(schema).parquet(str(path)) if path.exists() else spark.createDataFrame([], schema)


def use_registry(spark: SparkSession, args: argparse.Namespace) -> int:
    """A registry of Parquet tables in a folder: publication is idempotent, workspaces are never published."""
    revisions = _table(spark, args.folder, "revisions", REVISIONS)
    if args.action == "list":
        print(json.dumps(_shown(registry.listing(revisions.drop("text")))))
        return 0
    if args.action == "fetch":
        row = revisions.where(F.col("fingerprint") == args.what).head(1)
        if not row or manifest.manifest_fingerprint(canon.load_json(row[0].text)) != args.what:
            print("no such revision" if not row else "the registry holds another revision", file=sys.stderr)
            return 1
        files = registry.read_attachments(_table(spark, args.folder, "attachments", FILES).where(F.col("fingerprint") == args.what), _table(spark, args.folder, "blobs", BLOBS))
        if args.to:
            _written(args.to, row[0].text.encode())
        print(json.dumps({"fingerprint": args.what, "attachments": _shown(files.select("name", "status"))}))
        return 0
    entries = _capsule_rows(spark, args.what).cache()
    text = capsule.manifests(entries)
    roots = manifest.inspect(manifest.properties(text)).roots
    new = roots.join(text, "manifest").select("fingerprint", "name", "revision_of", F.lit(args.date).alias("published_at"), "text")
    judged = registry.publish(new, revisions).collect()  # one capsule
    if len(judged) != 1:
        print("not one capsule with a manifest", file=sys.stderr)
        return 1
    found = judged[0].asDict()
    if found.pop("created"):
        own = F.lit(found["fingerprint"]).alias("fingerprint")
        held = entries.where(F.col("name").startswith(archive.ATTACHMENTS) & F.col("refusal").isNull())
        declared = manifest.inspect(manifest.properties(text)).attachments
        uploads = held.select(own, F.substring("name", len(archive.ATTACHMENTS) + 1, 1 << 20).alias("name"), "content")
        stored, blobs = registry.put_attachments(uploads, declared.select(own, "name", "sha256", F.col("size").try_cast("long").alias("size")))
        fresh = blobs.join(_table(spark, args.folder, "blobs", BLOBS).select("sha256"), "sha256", "left_anti")
        accepted = stored.where("status = 'accepted'").select("fingerprint", "name", "sha256", "size")
        row = spark.createDataFrame([found], REVISIONS)
        for name, rows in (("blobs", fresh), ("attachments", accepted), ("revisions", row)):
            spark.createDataFrame(rows.collect(), rows.schema).write.mode("append").parquet(f"{args.folder}/{name}")
    print(json.dumps([{"fingerprint": judged[0].fingerprint, "created": judged[0].created}]))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="provspark", description=__doc__.splitlines()[0])
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb in ("validate", "verify"):
        sub = verbs.add_parser(verb)
        sub.add_argument("path")
        sub.add_argument("--profile", required=True, help="the profile that manifests conform to")
        sub.add_argument("--context", required=True, help="JSON-LD context file that defines the terms")
    verbs.add_parser("inspect").add_argument("path")
    sub = verbs.add_parser("diff")
    sub.add_argument("old")
    sub.add_argument("new")
    sub = verbs.add_parser("attachment")
    sub.add_argument("path")
    sub.add_argument("name")
    sub.add_argument("to")
    sub = verbs.add_parser("workspace")
    sub.add_argument("path")
    sub.add_argument("to")
    sub = verbs.add_parser("create")
    for name in ("ledger", "workspace", "to"):
        sub.add_argument(name)
    for name in ("name", "description", "license", "date", "profile", "terms"):
        sub.add_argument(f"--{name}", required=True)
    sub.add_argument("--revision-of")
    sub.add_argument("--attach", action="append", default=[])
    sub = verbs.add_parser("review")
    for name in ("path", "to"):
        sub.add_argument(name)
    for name in ("schema", "reviewer", "date", "statement"):
        sub.add_argument(f"--{name}", required=True)
    sub.add_argument("--verdict", choices=review.STATEMENTS)
    sub.add_argument("--cite", action="append", default=[], help="ACTIVITY=VERDICT")
    sub = verbs.add_parser("registry")
    sub.add_argument("folder")
    sub.add_argument("action", choices=("list", "publish", "fetch"))
    sub.add_argument("what", nargs="?", help="a capsule to publish, or a fingerprint to fetch")
    sub.add_argument("--date", default="")
    sub.add_argument("--to")
    verbs.add_parser("digest").add_argument("path")
    args = parser.parse_args(argv)
    if args.verb == "digest":
        print(canon.json_digest(canon.load_json(Path(args.path).read_text())))
        return 0
    spark = _session()
    if args.verb in ("validate", "verify"):
        terms = sorted(json.loads(Path(args.context).read_text())["@context"])
        if args.verb == "validate":
            found = _shown(manifest.validate(manifest.properties(_manifests(spark, args.path)), args.profile, terms))
            print(json.dumps({"valid": not found, "problems": found}))
            return int(bool(found))
        verdicts, problems = verify.verify(spark, args.path, args.profile, terms)
        shown = _shown(verdicts)
        print(json.dumps({"capsules": shown, "problems": _shown(problems)}))
        return int(not shown or not all(v["valid"] for v in shown))
    if args.verb == "inspect":
        print(json.dumps(_shown(manifest.summary(manifest.properties(_manifests(spark, args.path))))))
        return 0
    if args.verb == "diff":
        try:
            found = _shown(diff.ordered(diff.changes(_cells(spark, args.old), _cells(spark, args.new), "entity", "id", ["properties"])))
        except OSError as error:
            print(error, file=sys.stderr)
            return 2
        print(json.dumps(found))
        return int(bool(found))
    if args.verb in ("create", "review", "registry"):
        return {"create": create, "review": sign_review, "registry": use_registry}[args.verb](spark, args)
    if args.verb == "workspace":
        rows = capsule.opened(_capsule_rows(spark, args.path)).collect()
        if len(rows) != 1:
            print("no workspace in the capsule", file=sys.stderr)
            return 1
        _written(args.to, bytes(rows[0].content))
        print(rows[0].origin)
        return 0
    rows = capsule.attachment(capsule.read_entries(spark, args.path, contents=True), args.name).collect()
    if len(rows) != 1:
        print("no such attachment", file=sys.stderr)
        return 1
    _written(args.to, bytes(rows[0].content))
    return 0


if __name__ == "__main__":
    sys.exit(main())
