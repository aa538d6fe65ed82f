"""The command line over one capsule: created, opened, reviewed, published, fetched."""

import json

from test_records import PROFILE, U, activity, document, state

from provspark import __main__ as cli
from provspark.functions import canon


def run(capsys, *argv):
    code = cli.main([str(a) for a in argv])
    return code, capsys.readouterr().out.strip()


def test_a_capsule_over_its_life(spark, tmp_path, capsys):
    env = {"edition": "desktop", "edition_version": "1", "packages": {"numpy": "2.3.0"}}
    acts = [activity(201, [("source", 1)], [("result", 2)], environment_id=canon.json_digest(env), edition="desktop")]
    (tmp_path / "ledger.json").write_text(document("w", [state(1, 101, sequence=0), state(2, 102, 201, 1)], acts, {canon.json_digest(env): env}))
    (tmp_path / "work.h5").write_bytes(b"bytes of it")
    (tmp_path / "note.txt").write_text("a note")
    made = tmp_path / "one.capsule"
    options = ["--name", "n", "--description", "d", "--license", "CC0", "--date", "2026-01-01", "--profile", PROFILE, "--terms", "https://example.org/terms#"]
    code, out = run(capsys, "create", tmp_path / "ledger.json", tmp_path / "work.h5", made, *options, "--attach", tmp_path / "note.txt")
    fingerprint = json.loads(out)["fingerprint"]
    assert code == 0 and made.exists()
    code, out = run(capsys, "workspace", made, tmp_path / "back.h5")
    assert code == 0 and (tmp_path / "back.h5").read_bytes() == b"bytes of it" and json.loads(out) == {"fingerprint": fingerprint, "name": "n", "attachments": ["note.txt"]}
    code, out = run(capsys, "inspect", made)
    assert code == 0 and json.loads(out)[0]["name"] == "lib.op"
    signed = ["--schema", "review", "--reviewer", "me", "--date", "2026-01-02", "--statement", "fine", "--verdict", "endorsed"]
    assert run(capsys, "review", made, tmp_path / "r.json", *signed, "--cite", f"{U(201)}=exact")[0] == 0
    found = json.loads((tmp_path / "r.json").read_text())
    assert found["target"] == fingerprint and found["review_fingerprint"] == canon.json_digest({k: v for k, v in found.items() if k != "review_fingerprint"})
    assert run(capsys, "review", made, tmp_path / "s.json", *signed, "--cite", "nowhere=exact")[0] == 1 and not (tmp_path / "s.json").exists()
    shelf = tmp_path / "registry"
    assert json.loads(run(capsys, "registry", shelf, "publish", made, "--date", "2026-01-03")[1]) == [{"fingerprint": fingerprint, "created": True}]
    assert json.loads(run(capsys, "registry", shelf, "publish", made)[1]) == [{"fingerprint": fingerprint, "created": False}]
    assert [r["fingerprint"] for r in json.loads(run(capsys, "registry", shelf, "list")[1])] == [fingerprint]
    code, out = run(capsys, "registry", shelf, "fetch", fingerprint, "--to", tmp_path / "m.json")
    assert code == 0 and json.loads(out)["attachments"] == [{"name": "note.txt", "status": "available"}]
    assert run(capsys, "registry", shelf, "fetch", "sha256:" + "0" * 64)[0] == 1


def test_a_broken_ledger_gives_no_capsule(spark, tmp_path, capsys):
    (tmp_path / "ledger.json").write_text(document("w", [], [activity(201, [("source", 9)], [])]))
    (tmp_path / "work.h5").write_bytes(b"x")
    code, out = run(capsys, "create", tmp_path / "ledger.json", tmp_path / "work.h5", tmp_path / "c", "--name", "n", "--description", "d", "--license", "l", "--date", "d", "--profile", PROFILE, "--terms", "t")
    assert code == 1 and "unknown input state" in out and not (tmp_path / "c").exists()
