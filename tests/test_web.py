"""The registry over HTTP: routes, statuses, limits, idempotent publication, and a client that trusts nothing."""

import json
import threading
from hashlib import sha256

import pytest
from test_records import PROFILE, TERMS, U, activity, document, ledgers_of, state

from provspark.functions import canon
from provspark.operators.archive import ATTACHMENTS, MANIFEST, WORKSPACE, SizePolicy
from provspark.plans import build
from provspark.sources import capsule, web

WORDS = [*TERMS, "identifier", "softwareRequirements", "isPartOf", "startTime", "endTime", "version"]


def archive(spark, note=b"a note"):
    found = ledgers_of(spark, document("w", [state(1, 101, sequence=0), state(2, 102, 201, 1)], [activity(201, [("source", 1)], [("result", 2)])]))
    roots = spark.createDataFrame([("w", "n", "d", "CC0", "2026-01-01", None, None, sha256(b"work").hexdigest(), 4)], "workspace_id string, name string, description string, license string, published string, revision_of string, workspace_ref string, workspace_sha256 string, workspace_size long")
    files = spark.createDataFrame([("w", 0, "note.txt", "text/plain", len(note), "sha256:" + sha256(note).hexdigest(), "")], "workspace_id string, ord int, name string, media_type string, size long, sha256 string, description string")
    locators = spark.createDataFrame([], "state_id string, kind string, path string")
    made = build.build(found, locators, roots, build.Vocabulary(PROFILE, "profile", "0.1", "https://example.org/terms#", "workspace"), files).first()
    return made.fingerprint, capsule.archive_bytes([(MANIFEST, made.text.encode()), (WORKSPACE, b"work"), (ATTACHMENTS + "note.txt", note)])


@pytest.fixture
def shelf(spark, tmp_path):
    made = web.Shelf(spark, str(tmp_path / "shelf"), PROFILE, WORDS, SizePolicy(attachment=1000))
    served = web.server(made, token="secret")
    threading.Thread(target=served.serve_forever, daemon=True).start()
    yield made, f"http://127.0.0.1:{served.server_port}"
    served.shutdown()


def test_a_revision_over_http(spark, shelf):
    kept, url = shelf
    fingerprint, data = archive(spark)
    client = web.Client(url, "secret")
    assert client.status()["token_required"] is True and client.revisions() == []
    body = {"review": "r", "review_version": 1, "target": fingerprint, "reviewer": {"name": "me"}, "date": "2026-01-02", "statement": "fine", "verdict": None, "reports": [{"activity_id": U(201), "verdict": "exact"}]}
    signed = json.dumps(body | {"review_fingerprint": canon.json_digest(body)}).encode()
    assert client.publish(data, [signed]) == {"fingerprint": fingerprint, "created": True, "attachments": 1, "reviews": 1}
    assert client.publish(data)["created"] is False
    assert [r["fingerprint"] for r in client.revisions()] == [fingerprint]
    found = client.fetch(spark, fingerprint, PROFILE, WORDS)
    assert found["attachments"] == {"note.txt": ("valid", b"a note")} and [s for s, _ in found["reviews"]] == ["valid"]
    assert json.loads(client._ask("GET", "/reviews/" + web._quoted(json.loads(signed)["review_fingerprint"])))["statement"] == "fine"
    assert kept.table("blobs").count() == kept.table("attachments").count() == kept.table("revisions").count() == 1
    assert not kept.table("blobs").where("content = X'776f726b'").count()  # the workspace is not there

    def refused(status, call):
        with pytest.raises(web.Refused) as error:
            call()
        assert error.value.status == status, error.value.detail

    refused(401, lambda: web.Client(url).publish(data))
    refused(401, lambda: web.Client(url, "other").publish(data))
    refused(404, lambda: client.manifest("sha256:" + "0" * 64))
    refused(404, lambda: client._ask("GET", "/nowhere"))
    refused(404, lambda: client._ask("PUT", f"/revisions/{web._quoted(fingerprint)}/attachments/other.txt", b"x"))
    refused(422, lambda: client._ask("PUT", f"/revisions/{web._quoted(fingerprint)}/attachments/note.txt", b"b note"))
    refused(413, lambda: client._ask("PUT", f"/revisions/{web._quoted(fingerprint)}/attachments/note.txt", b"x" * 1001))
    refused(422, lambda: client._ask("POST", "/revisions", b"{}"))
    refused(422, lambda: client._ask("POST", "/reviews", signed.replace(b"fine", b"bad!")))
    refused(422, lambda: client._ask("GET", "/revisions?limit=many"))
    refused(413, lambda: client.manifest(fingerprint, limit=10))
    refused(422, lambda: client.attachment(fingerprint, "note.txt", "0" * 64, 6))
    with pytest.raises(ValueError):
        web.Client("ftp://x")


def test_damaged_bytes_are_not_served(spark, shelf):
    kept, url = shelf
    fingerprint, data = archive(spark, b"another note")
    web.Client(url, "secret").publish(data)
    digest = sha256(b"another note").hexdigest()
    rows = [(digest, 12, bytearray(b"another nope"))]
    spark.createDataFrame(rows, web.TABLES["blobs"]).write.mode("overwrite").parquet(f"{kept.folder}/blobs")
    with pytest.raises(web.Refused, match="damaged"):
        kept.attachment(fingerprint, "note.txt")
    assert web.Client(url).fetch(spark, fingerprint, PROFILE, WORDS)["attachments"]["note.txt"][1] is None
