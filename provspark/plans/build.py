"""Manifests built from ledgers: the rows of a workspace are gathered once, and its manifest is written in one pass."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.functions import canon
from provspark.operators import ledger as ledgers
from provspark.operators import manifest
from provspark.operators.archive import MANIFEST, WORKSPACE


@dataclass(frozen=True)
class Vocabulary:
    """What a publisher's manifests say of their profile; ``terms`` is the namespace behind the prefix ``dlc:``."""

    profile: str
    profile_name: str
    profile_version: str
    terms: str
    workspace_name: str
    workspace_type: str = "application/x-hdf5"
    editions: dict[str, str] = field(default_factory=dict)
    process_name: str = "Process Run Crate"
    process_version: str = "0.6"


def text(value: str | None) -> str | None:
    return None if value is None else canon.string_text(value)


def ref(ident: str | None) -> str | None:
    return None if ident is None else f'{{"@id":{canon.string_text(ident)}}}'


def listed(items: Iterable[str | None]) -> str:
    return f"[{','.join([i for i in items if i is not None])}]"


def record(always: dict[str, str | None], maybe: dict[str, str | None] | None = None) -> str:
    """Canonical JSON of an object from canonical values: null is written for ``always``, left out for ``maybe``; keys are ASCII."""
    cells = {k: "null" if v is None else v for k, v in always.items()}
    for k, v in (maybe or {}).items():
        if v is not None:
            cells[k] = v
    return "{" + ",".join([f'"{k}":{cells[k]}' for k in sorted(cells)]) + "}"


def _canonical(found: str | None) -> str | None:
    """Canonical form of JSON text; None for text that has none."""
    try:
        return None if found is None else canon.canonical_json(canon.load_json(found))
    except (ValueError, RecursionError):
        return None


def _joined(*parts: str | int | None) -> str | None:
    """Parts as one text; None if one is None."""
    return None if None in parts else "".join(map(str, parts))


def parameters(found: str | None) -> list[tuple[str, str, str | None]]:
    """``(name, json, literal)`` of each parameter in its place: its canonical text, and how it stands as a value."""
    out = []
    for name, value in (canon.load_json(found) if found else {}).items():
        plain = canon.canonical_json(value)
        out.append((name, plain, None if value is None else plain if isinstance(value, str | bool | int | float) else canon.canonical_json(plain)))
    return out


_SOFTWARE, _WORK, _BINDING, _VALUE = map(canon.string_text, ("SoftwareApplication", "CreativeWork", "dlc:RoleBinding", "PropertyValue"))


def entities(environments: list[dict], states: list[dict], activities: list[dict], vocabulary: Vocabulary) -> dict[str | None, str]:
    """JSON by id of a workspace's environments, packages, states, operations, bindings, artifacts, parameters, actions.

    Of several with one id the first in order of their JSON is kept.
    """
    out: dict[str | None, str] = {}

    def add(ident: str | None, always: dict[str, str | None], maybe: dict[str, str | None] | None = None) -> None:
        always["@id"] = text(ident)
        made = record(always, maybe)
        if ident not in out or made < out[ident]:
            out[ident] = made

    versions = {}
    for e in environments:
        python = e["python"] or {}
        packages = sorted((e["packages"] or ()), key=lambda p: p["key"])
        version = "unknown" if e["edition_version"] is None else e["edition_version"]
        versions[e["environment_id"]] = version
        needed = [(p["key"], "None" if p["value"] is None else p["value"]) for p in packages]
        shown = " ".join("None" if python.get(k) is None else python[k] for k in ("implementation", "version"))
        add(
            _joined("#environment-", e["environment_id"]),
            {
                "@type": text("dlc:Environment"), "name": text(f"{'None' if e['edition'] is None else e['edition']} environment"), "identifier": text(e["environment_id"]), "dlc:edition": text(e["edition"]), "dlc:editionVersion": text(version),
                "dlc:python": text(shown), "dlc:platform": text(e["platform"]), "dlc:pyodide": text(e["pyodide"]), "softwareRequirements": listed(ref(f"#package-{n}-{v}") for n, v in needed),
            },
        )
        for n, v in needed:
            add(f"#package-{n}-{v}", {"@type": _SOFTWARE, "name": text(n), "softwareVersion": text(v)})
    for s in states:
        add(
            _joined("#state-", s["state_key"]),
            {"@type": _WORK, "name": text(_joined(s["kind"], " state")), "dlc:kind": text(s["kind"]), "dlc:objectUuid": text(s["object_uuid"]), "dlc:sequence": _joined(s["sequence"]), "dlc:fingerprint": text(s["fp_value"]), "dlc:fingerprintScheme": text(s["fp_scheme"])},
            {"dlc:locator": text(s["path"]), "isPartOf": None if s["path"] is None else ref(WORKSPACE), "dlc:roi": text(_canonical(s["roi"])), "dlc:producedBy": ref(_joined("#activity-", s["produced_by"]))},
        )
    for a in activities:
        act, op, impl, edition = _joined("#activity-", a["activity_id"]), a["operation"], a["implementation"] or {}, a["edition"]
        tool_name, tool_version = next((n for n in (impl.get("python_name") or None, a["func_name"]) if n is not None), "unknown"), impl.get("version") or None
        tool_id = f"#implementation-{tool_name}-{tool_version or 'unknown'}"
        if op is not None:
            version = _joined(op["contract_version"])
            tool_id = _joined("#operation-", op["id"], "-v", version)
            add(tool_id, {"@type": _SOFTWARE, "name": text(op["id"]), "softwareVersion": text(version), "dlc:operationId": text(op["id"]), "dlc:contractVersion": version})
        else:
            add(tool_id, {"@type": _SOFTWARE, "name": text(tool_name)}, {"softwareVersion": text(tool_version), "dlc:package": text(impl.get("package") or None)})
        shown = versions.get(a["environment_id"], "unknown") if a["environment_id"] is not None else "unknown"
        edition_id = None if edition is None else f"#edition-{edition}-{shown}"
        if edition is not None:
            add(edition_id, {"@type": _SOFTWARE, "name": text(vocabulary.editions.get(edition, edition)), "softwareVersion": text(shown)})
        for side, bindings in (("input", a["inputs"]), ("output", a["outputs"])):
            for at, b in enumerate(bindings or ()):
                b = b or {}
                held = (b.get("binding") or {}) if side == "input" else b
                state_id, artifact, objects = held.get("state_id"), held.get("artifact"), held.get("object_uuids")
                artifact_id = None if state_id is not None or artifact is None else _joined(act, "-artifact-", at)
                add(
                    _joined(act, f"-{side}-", at),
                    {"@type": _BINDING, "name": text(b.get("role")), "position": str(at)},
                    {"dlc:state": ref(_joined("#state-", state_id)), "dlc:objectUuid": text(objects[0]) if state_id is None and objects else None, "dlc:artifact": ref(artifact_id)},
                )
                if state_id is None and artifact is not None:
                    add(artifact_id, {"@type": _WORK, "name": text(artifact["key"]), "dlc:artifactKind": text(artifact["kind"]), "dlc:objectUuid": text(artifact["object_uuid"]), "dlc:key": text(artifact["key"])}, {"dlc:resultDigest": text(artifact["digest"])})
        given = parameters(a["parameters"])
        for name, plain, literal in given:
            add(_joined(act, "-parameter-", name), {"@type": _VALUE, "name": text(name), "dlc:jsonValue": text(plain)}, {"value": literal})
        numbered = lambda side, items: listed(ref(_joined(act, f"-{side}-", i)) for i in range(len(items or ())))
        sources = None if a["inputs"] is None else [((i or {}).get("binding") or {}).get("state_id") for i in a["inputs"]]
        results = None if a["outputs"] is None else [_joined("#state-", (o or {}).get("state_id")) or _joined(act, "-artifact-", i) for i, o in enumerate(a["outputs"])]
        add(
            act,
            {
                "@type": text("UpdateAction" if a["origin"] == "recompute_in_place" else "CreateAction"),
                "name": text(tool_name if op is None or op["id"] is None else op["id"]), "instrument": listed([ref(tool_id), ref(edition_id)]),
                "object": None if sources is None else listed(ref(_joined("#state-", s)) for s in sources), "result": None if results is None else listed(map(ref, results)),
                "actionStatus": ref("http://schema.org/CompletedActionStatus"), "dlc:inputs": numbered("input", a["inputs"]), "dlc:outputs": numbered("output", a["outputs"]),
                "dlc:parameters": listed(ref(_joined(act, "-parameter-", name)) for name, _, _ in given),
                "dlc:replayable": "false" if op is None else "true", "dlc:origin": text(a["origin"]), "dlc:limits": listed(map(text, a["limits"] or ())),
            },
            {
                "dlc:environment": ref(_joined("#environment-", a["environment_id"])), "dlc:legacy": text(_canonical(a["legacy"])), "dlc:observedState": ref(_joined("#state-", a["observed"])),
                "dlc:commandId": text(a["command_id"] or None), "dlc:xAlignment": text(_canonical(a["x_alignment"])), "startTime": text(a["started_at"] or None), "endTime": text(a["finished_at"] or None),
            },
        )
    return out


def _manifest(root: dict, files: list[dict], body: dict[str | None, str], activities: list[dict], vocabulary: Vocabulary) -> tuple[str, str]:
    """``(fingerprint, text)`` of one manifest."""
    place = WORKSPACE if root["workspace_ref"] is None else root["workspace_ref"]
    mentions = [_joined("#activity-", a["activity_id"]) for a in sorted(activities, key=lambda a: (a["ord"], a["activity_id"] or ""))]
    parts = sorted(
        (f["ord"], record({"@id": text(f["id"]), "@type": text("File"), "name": text(f["name"]), "encodingFormat": text(f["encodingFormat"]), "contentSize": text(f["contentSize"]), "sha256": text(f["sha256"]), manifest.ATTACHED: "true"}, {"description": text(f["description"])}), ref(f["id"]))
        for f in files
    )
    plain = lambda ident, **more: record({"@id": text(ident), "@type": _WORK} | more)
    said = {
        "@id": text("./"), "@type": text("Dataset"), "name": text(root["name"]), "description": text(root["description"]), "datePublished": text(root["published"]), "license": text(root["license"]), "conformsTo": listed([ref(manifest.PROCESS_PROFILE), ref(vocabulary.profile)]),
        "hasPart": listed([ref(place), *(r for _, _, r in parts)]), "mentions": listed(map(ref, mentions)), "dlc:workspaceId": text(root["workspace_id"]),
    }
    sha = root["workspace_sha256"]
    before = plain(MANIFEST, about=ref("./"), conformsTo=ref(manifest.CRATE))
    after = [
        plain(manifest.PROCESS_PROFILE, name=text(vocabulary.process_name), version=text(vocabulary.process_version)),
        plain(vocabulary.profile, name=text(vocabulary.profile_name), version=text(vocabulary.profile_version)),
        record({"@id": text(place), "@type": text("File"), "name": text(vocabulary.workspace_name), "encodingFormat": text(vocabulary.workspace_type), "contentSize": text(_joined(root["workspace_size"])), "sha256": text(None if sha is None else sha.removeprefix("sha256:"))}, {manifest.REFERENCED: None if root["workspace_ref"] is None else "true"}),
        *(made for _, made, _ in parts),
        *(body[k] for k in sorted(body, key=lambda k: (k is not None, k or ""))),
    ]
    tail = ",".join(after)
    context = f'"@context":[{canon.string_text(manifest.CRATE_CONTEXT)},{{"dlc":{canon.string_text(vocabulary.terms)}}}],"@graph":['
    whole = lambda signed: f"{{{context}{before},{record(said, {manifest.REVISION: text(root['revision_of']), manifest.FINGERPRINT: signed})},{tail}]}}"
    fingerprint = canon.digest_of(whole(None).encode())
    return fingerprint, whole(text(fingerprint))


def build(found: ledgers.Ledgers, locators: DataFrame, roots: DataFrame, vocabulary: Vocabulary, attachments: DataFrame | None = None) -> DataFrame:
    """``(workspace_id, fingerprint, text)``: the manifest of each ledger as canonical JSON.

    ``roots(workspace_id, name, description, license, published, revision_of, workspace_ref, workspace_sha256,
    workspace_size)``, one a workspace; ``attachments(workspace_id, ord, name, media_type, size, sha256, description)``.
    Fixed entities come first, then the others by id. All rows of a workspace go through one shuffle, and a manifest is
    put together in one task; the size policy bounds it.
    """
    placed = found.states.join(locators.select("state_id", "path").dropDuplicates(["state_id"]), "state_id", "left")
    env, acts = found.environments, found.activities
    call = F.col("call")
    parts = {
        "root": roots.select("workspace_id", F.struct("workspace_id", "name", "description", "license", "published", "revision_of", "workspace_ref", "workspace_sha256", "workspace_size").alias("root")),
        "environments": env.select("workspace_id", F.struct("environment_id", "edition", "edition_version", "python", "platform", "pyodide", F.map_entries("packages").alias("packages")).alias("environments")),
        "states": placed.select("workspace_id", F.struct("state_key", "kind", "object_uuid", "sequence", "fp_value", "fp_scheme", "path", F.col("roi.definition").alias("roi"), "produced_by").alias("states")),
        "activities": acts.select(
            "workspace_id",
            F.struct(
                "ord", "activity_id", call["operation"].alias("operation"), call["parameters"].alias("parameters"), call["inputs"].alias("inputs"), "implementation", "outputs", "limits", "environment_id", "edition", "origin", "command_id", "started_at", "finished_at", "legacy",
                F.get_json_object("legacy", "$.record.func_name").alias("func_name"), F.get_json_object("legacy", "$.observed_state_id").alias("observed"), F.get_json_object("context", "$.x_alignment").alias("x_alignment"),
            ).alias("activities"),
        ),
    }
    if attachments is not None:
        made = manifest.attachment_entities(attachments.select("workspace_id", "ord", "name", "media_type", "size", "sha256", "description"), ["workspace_id", "ord"]).where("problem is null")
        parts["files"] = made.select("workspace_id", F.struct("ord", "id", "name", "encodingFormat", "contentSize", "sha256", "description").alias("files"))
    rows = None
    for part in parts.values():
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    names = list(parts)
    gathered = rows.groupBy("workspace_id").agg(*[F.collect_list(n).alias(n) for n in names]).where(F.size("root") > 0)
    gathered = gathered.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("held"))  # read much faster than nested columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for found in batch.column(0):
                held = json.loads(found.as_py())
                body = entities(held["environments"], held["states"], held["activities"], vocabulary)
                for root in held["root"]:
                    out.append((root["workspace_id"], *_manifest(root, held.get("files", []), body, held["activities"], vocabulary)))
                    size += len(out[-1][2])
                if size > 1 << 22:
                    yield _batch(out)
                    out, size = [], 0
            yield _batch(out)

    return gathered.mapInArrow(run, "workspace_id string, fingerprint string, text string")


def _batch(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    names = ["workspace_id", "fingerprint", "text"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [()] * 3)], names=names)
