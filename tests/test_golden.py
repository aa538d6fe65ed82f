"""Published and hand-checked vectors for numbers, canonical JSON, digests and fingerprints."""

import struct

import numpy as np
import pytest

from provspark.functions import canon, fingerprint

# Bits of a double and its canonical text (RFC 8785, appendix B).
NUMBERS = """
0000000000000000 0
8000000000000000 0
0000000000000001 5e-324
8000000000000001 -5e-324
7fefffffffffffff 1.7976931348623157e+308
ffefffffffffffff -1.7976931348623157e+308
4340000000000000 9007199254740992
c340000000000000 -9007199254740992
4430000000000000 295147905179352830000
44b52d02c7e14af5 9.999999999999997e+22
44b52d02c7e14af6 1e+23
44b52d02c7e14af7 1.0000000000000001e+23
444b1ae4d6e2ef4e 999999999999999700000
444b1ae4d6e2ef4f 999999999999999900000
444b1ae4d6e2ef50 1e+21
3eb0c6f7a0b5ed8c 9.999999999999997e-7
3eb0c6f7a0b5ed8d 0.000001
41b3de4355555553 333333333.3333332
41b3de4355555554 333333333.33333325
41b3de4355555555 333333333.3333333
41b3de4355555556 333333333.3333334
41b3de4355555557 333333333.33333343
becbf647612f3696 -0.0000033333333333333333
43143ff3c1cb0959 1424953923781206.2
"""


@pytest.mark.parametrize("line", NUMBERS.strip().splitlines())
def test_numbers(line):
    bits, text = line.split()
    assert canon.number_text(struct.unpack(">d", bytes.fromhex(bits))[0]) == text


def test_keys_are_ordered_by_utf16():
    keys = ["€", "\r", "דּ", "1", "\U0001f600", "\u0080", "ö"]
    text = canon.canonical_json(dict.fromkeys(keys, 0))
    assert list(canon.load_json(text)) == ["\r", "1", "\u0080", "ö", "€", "\U0001f600", "דּ"]


def test_digest_of_a_document():
    document = {"@context": "https://w3id.org/ro/crate/1.3/context", "@graph": [{"@id": "./", "@type": "Dataset", "name": "sample €", "size": 1.0, "parts": [1e30, 4.5, 0.002]}]}
    assert canon.json_digest(document) == "sha256:eefe60978fbd00ffdb7b6fb6dd5e0386ecdbd2273b3f8dcde2df8daf36ba5b5a"


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), 2**53 + 1, "\ud800", {1: 2}, {1, 2}, [object()]])
def test_values_without_canonical_form(bad):
    with pytest.raises(canon.CanonicalError):
        canon.canonical_json(bad)


def test_strings_and_depth():
    assert canon.canonical_json("\b\f\n\r\t\"\\\x1f\x7f€") == '"\\b\\f\\n\\r\\t\\"\\\\\\u001f\x7f€"'
    assert canon.depth_of('{"a": ["[[[", {"b\\"[": []}]}') == 4
    with pytest.raises(canon.CanonicalError):
        canon.load_json("[" * 65 + "]" * 65)


X, Y = [0.0, 0.25, 0.5, 0.75], np.array([-2.0, 0.0, 1.0, 4.0])


@pytest.mark.parametrize(
    ("y", "dy", "yunit", "scheme", "value"),
    [
        (Y, None, "", fingerprint.SIGNAL_V1, "a6fd76dfcb9412db706ad7dbfd3fc68dd4ed57ae0de5032ead395b1ccde4e2ac"),
        (np.array([-0.5, 0.0, 0.25, 1.0]), None, "", fingerprint.SIGNAL_V1, "3be7f81fb37dbe6a6afd757d0bf4739b7c83b1503113fde64048d3edd1976ed6"),
        (np.frombuffer(bytes.fromhex("00000000000000003fd55555555555553fe00000000000003ff0000000000000"), ">f8"), None, "", fingerprint.SIGNAL_V1, "5c3be8fc62dfa915bc9a0da1e263b737026ec07fbff829ce2b69fd1d808ecb40"),
        (Y.astype("<f4"), None, "V", fingerprint.SIGNAL_V2, "6d3dcd4955f9a09a8130e085492e7eb86285b5958cee8d48271eadc08af90505"),
        (Y + 1j * np.array([0.0, 1.0, -1.0, 0.0]), np.array([0.5, 0.5, 0.25, 0.25], "<c16"), "V", fingerprint.SIGNAL_V2, "812538e391ee872c826702302dfe0423f944cee5209f19c78e52a834c7490ff9"),
        (Y, np.array([0.5, 0.5, 0.25, 0.25]), "V", fingerprint.SIGNAL_V1, "a0f8e252c8c0912f805878227830abbb5227084fb826d7859964b93f35bcadf8"),
        (Y, np.full(4, np.nan), "", fingerprint.SIGNAL_V1, "a6fd76dfcb9412db706ad7dbfd3fc68dd4ed57ae0de5032ead395b1ccde4e2ac"),
    ],
)
def test_signals(y, dy, yunit, scheme, value):
    assert fingerprint.signal_fingerprint(X, y, None, dy, "s", yunit) == {"scheme": scheme, "value": f"sha256:{value}"}


UNITS = {"xunit": "mm", "yunit": "mm", "zunit": "counts"}
EVEN = {"x0": -1.0, "y0": 0.0, "dx": 0.5, "dy": 2.0}


@pytest.mark.parametrize(
    ("data", "coords", "value"),
    [
        (np.array([[1, 2, 3], [4, 5, 6]], "<u2"), EVEN, "66a22484bd3fb8aa0c8d9bcc2440a56fc79602d8f31f2791522c5a968fba4f28"),
        (np.array([[0.5, -1.0], [2.0, 0.25]]), {"xcoords": [0.0, 3.0], "ycoords": [1.0, 1.5]}, "d352c4c50fd8122e107741b83b81a87b5208ff396874d1992d57719387395ffd"),
        (np.array([[1, 2j, -3], [4 - 4j, 0, 12j]], "<c16"), EVEN, "b72a50b3c3a6455f6d523033d7812894eb654e638cf86576aa82d06643abf54e"),
        (np.array([[1, 4], [2, 5], [3, 6]], ">u2").T, EVEN, "66a22484bd3fb8aa0c8d9bcc2440a56fc79602d8f31f2791522c5a968fba4f28"),
    ],
)
def test_images(data, coords, value):
    assert fingerprint.image_fingerprint(data, **coords, **UNITS) == {"scheme": fingerprint.IMAGE_V1, "value": f"sha256:{value}"}


def test_columns(spark):
    rows = [('{"b":1,"a":[1.0,1e21]}',), ("[" * 70 + "]" * 70,), (None,), ("{bad",)]
    df = spark.createDataFrame(rows, "t string")
    got = [tuple(r) for r in df.select(canon.canonical_text(df.t), canon.canonical_digest(df.t)).collect()]
    assert got[0] == ('{"a":[1,1e+21],"b":1}', canon.json_digest({"a": [1, 1e21], "b": 1})) and got[1:] == [(None, None)] * 3


def test_flat_json_in_the_jvm(spark):
    texts = ['plain', 'q"b\\s\n\r\t\b\f\x01\x1f', "é€😀\x7f", ""]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, n int")
    got = {r.n: r.j for r in df.select("n", canon.flat_json({"z": canon.json_string(df.t), "a": df.n.cast("string")}).alias("j")).collect()}
    assert got == {i: canon.canonical_json({"z": t, "a": i}) for i, t in enumerate(texts)}


def test_state_facts(spark):
    rows = [("u1", "signal", X, Y.tolist(), None, "s", None), ("u2", "image", None, None, [float(i) for i in range(6)], "", [2, 3]), ("u3", "signal", X, [1.0], None, "", None)]
    df = spark.createDataFrame(rows, "object_uuid string, kind string, x array<double>, y array<double>, data array<double>, xunit string, shape array<long>")
    got = {r.object_uuid: r for r in fingerprint.state_facts(df).collect()}
    assert got["u1"].fp_value.endswith("a6fd76dfcb9412db706ad7dbfd3fc68dd4ed57ae0de5032ead395b1ccde4e2ac") and got["u1"].rows == ["x", "y"]
    assert got["u2"].shape == [2, 3] and got["u2"].fp_scheme == fingerprint.IMAGE_V1
    assert got["u3"].fp_value is None and "length" in got["u3"].problem
