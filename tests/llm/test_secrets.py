import base64
import hashlib
import json
import re

import pyarrow as pa

from millrace.llm import secrets


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def number(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


RSA = der(0x30, number(0) + b"".join(number(3**k) for k in (200, 3, 190, 80, 81, 70, 71, 60)))
PKCS8 = der(0x30, number(0) + der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + der(5, b"")) + der(4, RSA))
SSH = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"\0" * 40


def url64(data):
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


JWT = ".".join((url64(json.dumps({"alg": "HS256"}).encode()), url64(json.dumps({"sub": "1"}).encode()), url64(b"x" * 32)))


def plain_base(text):
    out = []
    for k, (name, rx, least, group) in enumerate((("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2), ("access", r"AKIA[A-Z0-9]+", 18, 0), ("hex", r"[0-9a-f]+", 16, 0))):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(rx, text, re.A) if len(m[group]) >= least]
    return ",".join(x[2] for x in sorted(out))


def test_structures():
    for key, kind in ((RSA, "der_key"), (PKCS8, "der_key"), (SSH, "ssh_key")):
        coded = base64.b64encode(key).decode()
        lines = "\n".join(coded[i : i + 64] for i in range(0, len(coded), 64))
        for text in (f"é {coded} end", f"-----BEGIN KEY-----\n{lines}\n-----END KEY-----", f"k: {key.hex()} ."):
            assert [s[2] for s in secrets.confirmed_spans(text)] == [kind], text
    assert [s[2] for s in secrets.confirmed_spans(f"see {JWT}, and")] == ["jwt"]


def test_broken_structures_are_not_reported():
    for bad in (RSA[:-1], RSA + b"\0", RSA.replace(b"\x02", b"\x03", 1), b"\x30\x84\xff\xff\xff\xff" + RSA, SSH[:20]):
        assert not secrets.confirmed_spans("x " + base64.b64encode(bad).decode() + " y")
    assert not secrets.confirmed_spans("a.b.c www.example.com/abcdefghijkl.mnopqrst.uvw " + url64(b"{}") + "." + url64(b"[1]") + ".")


def test_whole_table_against_plain_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()
    got = secrets.op10_secrets(spark, sf_dir).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for d, t in zip(docs.doc_id, docs.text):
        base = plain_base(t or "")
        assert got.base_sha256[d] == hashlib.sha256(base.encode()).hexdigest()
        assert got.n_hex[d] == base.count("hex:") and got.n_assign[d] == base.count("assign:") and got.n_access[d] == base.count("access:")


def test_odd_rows(spark):
    key = base64.b64encode(PKCS8).decode()
    rows = [(1, None, 1), (2, "", 1), (None, "é token: abcdefghijklmnop", 1), (4, "word " * 50000 + f"é {key} AKIA" + "A" * 16, 1), (4, "PASSWD='x' token: token: abcdefghijklmnop", 1)]
    got = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans long")).collect()
    assert [(r.n_assign, r.n_access, r.n_hex, r.n_confirmed) for r in got] == [(0, 0, 0, 0), (0, 0, 0, 0), (1, 0, 0, 0), (0, 1, 0, 1), (0, 0, 0, 0)]
    assert got[2].spans == "assign:2:25"
    assert got[3].spans.startswith(f"der_key:250002:{250002 + len(key)}")
    assert secrets.scan_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keys_among_lines_of_letters():
    whole_ssh = SSH[:-40] + b"".join(len(x).to_bytes(4, "big") + x for x in (b"p" * 51, b"q" * 84))
    rsa = [base64.b64encode(RSA).decode().rstrip("="), "der_key"]
    pkcs8 = [base64.b64encode(PKCS8).decode().rstrip("="), "der_key"]
    ssh = [base64.b64encode(whole_ssh).decode().rstrip("="), "ssh_key"]
    words = ["apple", "pear", "plum", "cherry", "quince", "fig"]
    for end in ("\n", "\r\n"):
        for keys in ([rsa], [ssh], [rsa, pkcs8], [ssh, rsa], [pkcs8, ssh, rsa]):
            for first in ([], ["a" * 40]):
                lines, want, at = [*first], [], sum(len(x + end) for x in first)
                for coded, kind in keys:
                    want.append((at, at + len(end.join(coded[i : i + 64] for i in range(0, len(coded), 64))), kind))
                    lines += [coded[i : i + 64] for i in range(0, len(coded), 64)]
                    at = sum(len(x + end) for x in lines)
                text = end.join([*lines, *words])
                assert secrets.confirmed_spans(text) == want


EC = der(0x30, number(1) + der(4, b"k" * 32) + der(0xA0, der(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07")))
ED25519 = der(0x30, b"\x02\x01\x00" + der(0x30, der(6, b"\x2b\x65\x70")) + der(4, der(4, b"s" * 32)))
DSA = der(0x30, b"\x02\x01\x00" + b"".join(number(7**k) for k in (90, 50, 90, 88, 49)))
ENCRYPTED = der(0x30, der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x05\x0d") + der(0x30, b"")) + der(4, b"\x9c" * 120))
DIGEST = der(0x30, der(0x30, der(6, b"\x60\x86\x48\x01\x65\x03\x04\x02\x01") + der(5, b"")) + der(4, b"h" * 32))


def wrapped(text, n, end):
    return end.join(text[i : i + n] for i in range(0, len(text), n))


def test_every_form_of_a_key_is_found_where_it_stands():
    for key in (RSA, PKCS8, EC, ED25519, DSA, ENCRYPTED):
        plain = base64.b64encode(key).decode()
        url = base64.urlsafe_b64encode(key).decode()
        hexed = key.hex()
        mixed = "".join(c.upper() if i % 3 else c for i, c in enumerate(hexed))
        forms = [plain, plain.rstrip("="), url, url.rstrip("="), wrapped(plain, 64, "\n"), wrapped(plain, 76, "\r\n    "), wrapped(plain, 64, "\\n")]
        forms += [hexed, hexed.upper(), mixed, wrapped(hexed, 64, "\n"), wrapped(hexed, 60, "\n  "), wrapped(hexed, 2, ":")]
        for form in forms:
            for before in ("", "é ", "x" * 40 + "\n", "path/to/", "key=", '"', "  ", "-----BEGIN KEY-----\n", "-----BEGIN KEY-----\\n"):
                if before == "path/to/" and form.lower().startswith("30"):
                    before = "0x"
                for after in ("", "\nword\nword\n", '"', "\n" + "y" * 30, "."):
                    got = secrets.confirmed_spans(before + form + after)
                    assert got == [(len(before), len(before) + len(form), "der_key")], (before, form, after)
            whole = secrets._scan(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some text " + form]})]))
            assert next(whole).column("spans")[0].as_py().count(f"der_key:10:{10 + len(form)}") == 1
    assert not secrets.confirmed_spans(base64.b64encode(DIGEST).decode() + " " + DIGEST.hex())


def test_many_starts_cost_little():
    assert secrets.confirmed_spans("MIIJQgIBADANBgkqhkiG9w0BAQEF" * 20_000 + " " + "3082094202010030" * 20_000) == []
