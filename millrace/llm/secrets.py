"""Secret scan with structural confirmation.

Base findings come from three patterns. On top, base64, base64url and hex candidates are decoded and
parsed; a span is added only where the bytes have the structure of a key or a signed token. A key begins
where a run of letters does, on any line, after a part of a path or after ``0x``; its own lengths say how many
letters belong to it, and no further letter may follow on its last line. Its letters may be wrapped over
lines, indented, separated by written-out line ends (``\\n``) or, as hex, by colons.

Edge cases: a null text counts as empty and has no findings; a text is scanned whole whatever its length;
rows with null or repeated ids are scanned like any other; an empty table gives an empty result; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import table
from ._text import column, runs, slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
TOKEN = re.compile(r"(?<![\w-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)", re.A)
#: Where an encoded key may begin: a sequence of any length that starts with its version or, encrypted, with
#: an algorithm; or the mark of an OpenSSH key.
BASE64_START = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=[A-Za-z0-9.~][/_-])|(?<=\\n))(?:M(?:[A-H]|I[E-L])(?=[A-Za-z0-9+/_-]{14})|b3BlbnNzaC1rZXktdjEA)")
HEX_START = re.compile(r"(?:(?<![0-9A-Za-z])|(?<=0x)|(?<=\\n))(?:30:?(?:[0-7][0-9a-f]|8[12])|6f:?70:?65:?6e:?73:?73:?68)", re.I)
_GAP = r"[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*"
BASE64_RUN, HEX_RUN = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[0-9A-Fa-f]+")
BASE64_GAP, HEX_GAP = re.compile(_GAP), re.compile(f":?{_GAP}|:")
_URL = str.maketrans("-_", "+/")
#: Object identifiers of password-based encryption, under which an encrypted key is kept.
ENCRYPTED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
#: Kinds in the order in which spans that start together are listed; the first three are the base ones.
KINDS = ("assign", "access", "hex", "jwt", "der_key", "ssh_key")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_COLONS = np.zeros(256, bool)
_COLONS[list(b"0123456789abcdefABCDEF:")] = True
_CODED = np.zeros(256, bool)
_CODED[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-.=")] = True


def tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """One DER element: its tag, and where its content starts and ends; None unless it fits before ``end``."""
    if at + 2 > end:
        return None
    tag, first = data[at], data[at + 1]
    at += 2
    if first < 0x80:
        size = first
    else:
        n = first & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        at += n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The DER elements that fill ``data[at:end]`` exactly, else None."""
    found = []
    while at < end:
        if (one := tlv(data, at, end)) is None:
            return None
        found.append(one)
        at = one[2]
    return found


def is_der_key(data: bytes) -> bool:
    """A private key as RSA, DSA, EC or PKCS#8 encodings nest it, also encrypted: every length must agree."""
    whole = elements(data, 0, len(data))
    if not whole or len(whole) != 1 or whole[0][0] != 0x30:
        return False
    parts = elements(data, *whole[0][1:])
    if not parts or len(parts) < 2:
        return False
    tags = [p[0] for p in parts]
    if tags == [0x30, 0x04]:
        inner = elements(data, *parts[0][1:])
        return bool(inner) and inner[0][0] == 0x06 and data[inner[0][1] : inner[0][2]].startswith(ENCRYPTED)
    if tags[0] != 0x02:
        return False
    version = data[parts[0][1] : parts[0][2]]
    if version in (b"\0", b"\1") and (len(tags) >= 9 and set(tags[:9]) == {0x02} or version == b"\0" and tags == [0x02] * 6):
        return True
    if version == b"\1" and tags[1] == 0x04:
        return True
    if version in (b"\0", b"\1") and tags[1:3] == [0x30, 0x04]:
        inner = elements(data, *parts[1][1:])
        return bool(inner) and inner[0][0] == 0x06
    return False


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key: the magic, then length-prefixed cipher, kdf and options, then keys."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at + 4 <= len(data) and int.from_bytes(data[at : at + 4], "big") >= 1


def _json(part: str) -> object:
    try:
        return json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return None


def is_signed_token(header: str, payload: str) -> bool:
    """A JOSE header that names its algorithm, before an object as payload."""
    head = _json(header)
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(_json(payload), dict)


def _ssh_size(data: bytes) -> int | None:
    """The bytes of the OpenSSH key that ``data`` begins with, from its lengths; None if they don't fit."""
    at, fields = len(b"openssh-key-v1\0"), []
    for _ in range(3):
        fields.append(data[at + 4 : at + 4 + int.from_bytes(data[at : at + 4], "big")])
        at += 4 + len(fields[-1])
    # the public keys, then the private part
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    while count >= 0 and at + 4 <= len(data):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        count -= 1
    at += 16 if fields[0].startswith((b"aes128-gcm", b"aes256-gcm", b"chacha20-poly1305")) else 0
    return at if count < 0 and at <= len(data) else None


def _gather(text: str, at: int, wanted: int, run: re.Pattern, gap: re.Pattern) -> tuple[str, int]:
    """At most ``wanted`` letters of a coded value from ``at`` on, over gaps, and the place after the last."""
    parts, have, end = [], 0, at
    while have < wanted and (m := run.match(text, at)):
        piece = m[0][: wanted - have]
        parts.append(piece)
        have, end = have + len(piece), m.start() + len(piece)
        if not (g := gap.match(text, m.end())):
            break
        at = g.end()
    return "".join(parts), end


def _unbase64(letters: str) -> bytes:
    letters = letters.translate(_URL)
    letters = letters[:-1] if len(letters) % 4 == 1 else letters
    return base64.b64decode(letters + "=" * (-len(letters) % 4), validate=True)


def _unhex(letters: str) -> bytes:
    return bytes.fromhex(letters[: len(letters) & ~1])


#: How the letters of an encoding are found and read, and how many letters hold so many bytes.
CODES = (
    (BASE64_START, BASE64_RUN, BASE64_GAP, _unbase64, lambda size: -(-size * 4 // 3)),
    (HEX_START, HEX_RUN, HEX_GAP, _unhex, lambda size: size * 2),
)


def _promising(head: bytes) -> int | None:
    """The bytes that the sequence takes that ``head`` begins, if what it holds may be a key; else None."""
    outer = tlv(head, 0, 1 << 40) if len(head) >= 8 else None
    if not outer or outer[0] != 0x30 or outer[2] - outer[1] < 16:
        return None
    inner = head[outer[1] : outer[1] + 3]
    return outer[2] if inner in (b"\2\1\0", b"\2\1\1") or inner[:1] == b"\x30" else None


def _coded_keys(text: str) -> Iterator[tuple[int, int, str]]:
    """Keys in base64, base64url or hex; the search goes on after the end of each."""
    for start, run, gap, decoded, letters_of in CODES:
        at = 0
        while m := start.search(text, at):
            s, at, kind = m.start(), m.start() + 1, None
            head = decoded(_gather(text, s, 24, run, gap)[0])
            if head.startswith(b"openssh"):
                letters, end = _gather(text, s, 1 << 24, run, gap)
                if is_ssh_key(data := decoded(letters)):
                    kind = "ssh_key"
                    if size := _ssh_size(data):
                        exact = _gather(text, s, letters_of(size), run, gap)
                        letters, end = (letters, end) if run.match(text, exact[1]) else exact
            elif size := _promising(head):
                letters, end = _gather(text, s, letters_of(size), run, gap)
                if not run.match(text, end) and is_der_key(decoded(letters)[:size]):
                    kind = "der_key"
            if kind:
                while run is BASE64_RUN and len(letters) % 4 and text.startswith("=", end):
                    letters, end = letters + "=", end + 1
                yield s, end, kind
                at = end


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Base findings as (start, end, kind), in code points, unsorted."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 16]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Candidates whose decoded bytes have the structure of a key or a signed token."""
    found = [(m.start(), m.end(), "jwt") for m in TOKEN.finditer(text) if is_signed_token(m[1], m[2])]
    return found + list(_coded_keys(text))


def listed(spans: list[tuple[int, int, str]]) -> str:
    """Spans as kind:start:end by start, then kind in the order of KINDS."""
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for whole in batches:
        for batch in slices(whole):
            raw, offsets = column(batch, "text")
            n = batch.num_rows
            marked = np.zeros(n, bool)
            for kind, least in ((_HEX, 16), (_COLONS, 40), (_CODED, 20)):
                s, e, row = runs(kind[raw], offsets)
                marked[row[e - s >= least]] = True
            lowered = _LOWER[raw].tobytes()
            for word in (*WORDS, b"akia"):
                at = lowered.find(word)
                while at >= 0:
                    marked[np.searchsorted(offsets, at, "right") - 1] = True
                    at = lowered.find(word, at + 1)
            counts = np.zeros((4, n), np.int64)
            sha, spans = [nothing] * n, [""] * n
            for i in np.flatnonzero(marked):
                text = raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                base, more = base_spans(text), confirmed_spans(text)
                for k in range(3):
                    counts[k, i] = sum(x[2] == KINDS[k] for x in base)
                counts[3, i] = len(more)
                sha[i] = hashlib.sha256(listed(base).encode()).hexdigest()
                spans[i] = listed(base + more)
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in counts[:3]), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(counts[3])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Findings per document of ``docs(doc_id, text)``; one pass, no shuffle.

    ``spans`` has every base span and every confirmed one as kind:start:end in code points.
    """
    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, SCHEMA)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret findings of every document."""
    return scan_secrets(table(spark, sf_dir, "documents"))
