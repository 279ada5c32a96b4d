"""Secret scans with structural confirmation.

Patterns give base spans.  Beyond those, base64 and hex candidates are decoded and reported
only where what they hold parses as a key or a signed token:

* ``pem``: a BEGIN/END block whose body decodes to a DER key or an OpenSSH key, or whose
  headers name a cipher and whose body decodes to whole blocks of it;
* ``jwt``: three base64url parts, the first two JSON objects, the header naming ``alg``;
* ``der``: base64 or hex of a DER sequence whose nested lengths fill it and which has the
  shape of a private key (PKCS#1, PKCS#8 or SEC 1);
* ``openssh``: base64 or hex of the OpenSSH private key format with consistent lengths.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_text

#: Kinds in the order in which spans with the same start are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "jwt", "der", "openssh")


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = re.compile(rf"""(?=[PpSsTtAa])({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----([A-Za-z0-9+/=\s:,\\-]*?)-----END \1-----")
JWT = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]{8,}(?![A-Za-z0-9_-])")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")

#: A line end, also as written in strings; starts of wrapped keys, whose lines are of one width but for the last.
EOL = r"[ \t]*(?:\r?\n|\\+[rn])(?:\s|\\+[rn])*"
WRAPPED64 = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:M|b3BlbnNzaC1rZXkt)[A-Za-z0-9+/_-]{{15,}}(?={EOL}[A-Za-z0-9+/_-])")
WRAPPED_HEX = re.compile(rf"(?<![0-9A-Fa-f])(?:30|6[Ff]70656[Ee]7373682[Dd]6[Bb]6579)[0-9A-Fa-f]{{14,}}(?={EOL}[0-9A-Fa-f])")
LINE64, LINE_HEX = re.compile(rf"{EOL}([A-Za-z0-9+/_-]+={{0,2}})"), re.compile(rf"{EOL}([0-9A-Fa-f]+)(?![0-9A-Fa-f])")


def decode64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of consecutive DER values that fill ``data`` exactly, else None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n >= 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > len(data) or data[at] == 0:
                return None
            n, at = int.from_bytes(data[at : at + size]), at + size
            if n < 0x80:
                return None
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


#: Object identifiers of password-based encryption begin so: PKCS#5 and PKCS#12.
ENCRYPTIONS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def is_der_key(data: bytes) -> bool:
    """A private key: PKCS#1 (version and eight integers), PKCS#8 (version, algorithm with
    an object identifier, octet string), encrypted PKCS#8 (password-based algorithm, octet
    string) or SEC 1 (version 1, octet string)."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    top = der_items(data)
    if not top or len(top) != 1:
        return False
    inside = der_items(top[0][1])
    if inside and [t for t, _ in inside] == [0x30, 0x04]:
        algorithm = der_items(inside[0][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and algorithm[0][1].startswith(ENCRYPTIONS) and len(inside[1][1]) >= 16
    if not inside or len(inside) < 2 or inside[0][0] != 0x02 or len(inside[0][1]) != 1:
        return False
    tags = [t for t, _ in inside]
    if tags[:9] == [0x02] * 9 and all(x for _, x in inside[:9]):
        return True
    if tags[:3] == [0x02, 0x30, 0x04]:
        algorithm = der_items(inside[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(inside[2][1]) >= 16
    return tags[:2] == [0x02, 0x04] and inside[0][1] == b"\x01" and len(inside[1][1]) >= 16


def is_openssh_key(data: bytes) -> bool:
    """The OpenSSH private key format: its name, three strings, a count, then that many
    public keys and one private part, all lengths inside the data."""
    name = b"openssh-key-v1\0"
    if not data.startswith(name):
        return False
    at = len(name)

    def string() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        n, at = int.from_bytes(data[at : at + 4]), at + 4
        if at + n > len(data):
            return None
        at += n
        return data[at - n : at]

    if any(string() is None for _ in range(3)) or at + 4 > len(data):
        return False
    keys, at = int.from_bytes(data[at : at + 4]), at + 4
    return 1 <= keys <= 16 and all(string() for _ in range(keys + 1))


def is_signed_token(s: str) -> bool:
    parts = s.split(".")
    objects = []
    for part in parts[:2]:
        raw = decode64(part)
        try:
            objects.append(json.loads(raw.decode("utf-8")) if raw else None)
        except (ValueError, RecursionError):
            return False
    return len(parts) == 3 and all(isinstance(x, dict) for x in objects) and isinstance(objects[0].get("alg"), str) and decode64(parts[2]) is not None


def key_kind(data: bytes | None) -> str | None:
    if data is None:
        return None
    return "der" if is_der_key(data) else "openssh" if is_openssh_key(data) else None


def unhex(s: str) -> bytes | None:
    return bytes.fromhex(s) if len(s) % 2 == 0 else None


def is_pem_key(body: str) -> bool:
    """What stands between BEGIN and END: headers, if any, and base64 of a key or, as headers say, of its cipher text."""
    body = re.sub(r"\\+[rn]", "\n", body)
    data = decode64(re.sub(r"(?m)^[A-Za-z-]+:.*$|\s", "", body))
    if key_kind(data):
        return True
    cipher = re.search(r"(?m)^[ \t]*DEK-Info:[ \t]*([A-Za-z0-9-]+),[ \t]*([0-9A-Fa-f]+)[ \t]*$", body)
    if not data or not cipher or not re.search(r"(?m)^[ \t]*Proc-Type:[ \t]*4,[ \t]*ENCRYPTED[ \t]*$", body):
        return False
    block = 8 if cipher[1].upper().startswith("DES-") else 16
    return len(cipher[2]) == 2 * block and len(data) >= 32 and len(data) % block == 0


def der_size(data: bytes | None) -> int:
    """Bytes of the DER sequence that ``data`` begins; 0 if it doesn't begin one."""
    if not data or len(data) < 6 or data[0] != 0x30:
        return 0
    size = data[1] & 0x7F
    if data[1] < 0x80:
        return 2 + size
    return 2 + size + int.from_bytes(data[2 : 2 + size]) if 1 <= size <= 4 else 0


def wrapped(text: str, start: re.Pattern, line: re.Pattern, decode) -> list[tuple[int, int, str]]:
    """Spans of keys over several lines."""
    out, done = [], 0
    for m in start.finditer(text):
        if m.start() < done:
            continue
        head, width = decode(m[0][:16]), len(m[0])
        most = len(text) if head and head.startswith(b"openssh-") else 2 * der_size(head)
        if not most:
            continue
        most += 4
        lines, ends, size = [m[0]], [m.end()], width
        while len(lines[-1]) == width and size < most and (n := line.match(text, ends[-1])) and len(n[1]) <= width:
            lines.append(n[1])
            ends.append(n.end())
            size += len(n[1])
        for k in range(len(lines), max(1, len(lines) - 2), -1):
            if kind := key_kind(decode("".join(lines[:k]))):
                done = ends[k - 1]
                out.append((m.start(), done, kind))
                break
    return out


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start, then kind as listed; code points, end exclusive."""
    if not text:
        return []
    out = []
    if ":" in text or "=" in text:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        out += [(*m.span(), "pem") for m in PEM.finditer(text) if is_pem_key(m[2])]
    if "." in text:
        out += [(*m.span(), "jwt") for m in JWT.finditer(text) if is_signed_token(m[0])]
    taken = [(a, b) for a, b, kind in out if kind in ("pem", "jwt")]
    for start, line, decode in ((WRAPPED64, LINE64, decode64), (WRAPPED_HEX, LINE_HEX, unhex)):
        out += [x for x in wrapped(text, start, line, decode) if not any(a <= x[0] < b for a, b in taken)]
    for m in BASE64.finditer(text):
        if not any(a <= m.start() < b for a, b in taken) and (kind := key_kind(decode64(m[0]))):
            out.append((*m.span(), kind))
    for m in HEX_ANY.finditer(text):
        if kind := key_kind(bytes.fromhex(m[0])):
            out.append((*m.span(), kind))
    return sorted(set(out), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_<kind> for each kind, base_sha256, spans`` of every row.

    Null and empty texts have no spans (``base_sha256`` is that of the empty string).  Ids
    are passed on as they are, null or repeated; other columns are left out.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    counts = [f"n_{k}" for k in KINDS]
    arrow = pa.schema([*((c, pa.int64()) for c in counts), ("base_sha256", pa.string()), ("spans", pa.string())])

    def work(ids, texts):
        found = [scan(t) for t in texts]
        out = {f"n_{k}": [sum(s[2] == k for s in spans) for spans in found] for k in KINDS}
        base = [joined([s for s in spans if s[2] in BASE_KINDS]) for spans in found]
        return out | {"base_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in base], "spans": [joined(s) for s in found]}

    def run(batches):
        each = by_text(work, id_col, text_col, arrow)
        for batch in batches:
            done = 0
            for out in each([batch]):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, out.num_rows), *out.columns], names=[id_col, *arrow.names])
                done += out.num_rows

    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{c} bigint" for c in counts) + ", base_sha256 string, spans string"
    return df.select(id_col, text_col).mapInArrow(run, schema)


def redacted(text: str | None) -> str | None:
    """The text with each secret, overlapping spans as one, put as ``<SECRET>``."""
    if not text:
        return text
    out, at = [], 0
    for a, b, _ in scan(text):
        if a >= at:
            out += [text[at:a], "<SECRET>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the secrets in ``text_col`` replaced by ``<SECRET>``; all rows and columns
    stay, null texts stay null."""
    from .common import slices

    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                texts = [redacted(t) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, type=part.schema.field(at).type))

    return df.mapInArrow(run, df.schema)
