"""Operator 3: secret scans with structural confirmation.

Three base patterns report as they match. Beyond them, base64 and hex
candidates are decoded and reported only if their structure holds: private
keys in DER (every nested length must fit exactly), OpenSSH key files (magic
and length-prefixed fields) and signed tokens (JSON header with an algorithm,
JSON payload). The encoded lengths also tell where a key ends.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, ddl, require, slices

#: In the order in which spans with one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "jwt", "der", "openssh")
BASE = KINDS[:3]
SPAN = "struct<kind:string,start:long,end:long>"

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 16 or more: a shorter run holds no match, a longer one is one match from its start.
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
#: A DER sequence begins with the byte 30; an OpenSSH file with its magic. The letter of an escaped line end isn't part of the run.
_BASE64 = re.compile(r"(?:(?<![A-Za-z0-9])|(?<=\\[nr]))(?:M[A-P]|b3BlbnNzaC1rZXkt)[A-Za-z0-9+/_-]{20,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]+")
#: Between the lines of one key: a line end, also an escaped one, with indentation.
_BREAK = re.compile(r"[\x20\t]*(?:\r?\n|(?:\\+r)?\\+n)[\x20\t]*(?=[A-Za-z0-9+/_-])")
_HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])30(?:[0-9a-f]{62,}|[0-9A-F]{62,})")
_MAGIC = b"openssh-key-v1\0"


def _tlv(raw: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, content start and content end of the DER value at at; None if it doesn't fit."""
    if at + 2 > end:
        return None
    tag, n = raw[at], raw[at + 1]
    at += 2
    if n >= 0x80:
        more = n & 0x7F
        if not 1 <= more <= 4 or at + more > end:
            return None
        n = int.from_bytes(raw[at : at + more], "big")
        if n < 0x80 or n >> (8 * (more - 1)) == 0:
            return None  # not the shortest form
        at += more
    return (tag, at, at + n) if at + n <= end else None


def _children(raw: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    """Values that fill at..end exactly, or none."""
    out = []
    while at < end:
        one = _tlv(raw, at, end)
        if one is None:
            return []
        out.append(one)
        at = one[2]
    return out


def private_key_length(raw: bytes) -> int:
    """Bytes of the DER private key that raw begins with; 0 if there is none."""
    top = _tlv(raw, 0, len(raw))
    if top is None or top[0] != 0x30:
        return 0
    kids = _children(raw, top[1], top[2])
    tags = [k[0] for k in kids]
    size = [k[2] - k[1] for k in kids]
    first = raw[kids[0][1] : kids[0][2]] if kids else b""
    numbered = tags[:1] == [2] and first in (b"\0", b"\1")
    if numbered and tags == [2] * len(tags) and len(tags) in (6, 9) and size[1] >= 64:
        return top[2]  # DSA or RSA
    if first == b"\1" and tags[:2] == [2, 4] and size[1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return top[2]  # elliptic curve
    if numbered and tags[:3] == [2, 0x30, 4] and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]):
        named, inner = _children(raw, *kids[1][1:]), _tlv(raw, *kids[2][1:])
        if named and named[0][0] == 6 and inner and inner[2] == kids[2][2]:
            return top[2]  # PKCS 8
    if tags == [0x30, 4]:
        named = _children(raw, *kids[0][1:])
        if named and named[0][0] == 6 and raw[named[0][1] : named[0][2]].startswith((b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c")):
            return top[2]  # encrypted PKCS 8
    return 0


def openssh_length(raw: bytes) -> int:
    """Bytes of the OpenSSH private key file that raw begins with; 0 if there is none."""
    if not raw.startswith(_MAGIC):
        return 0
    at = len(_MAGIC)

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 + n > len(raw):
            return None
        at += 4 + n
        return raw[at - n : at]

    cipher, kdf, options = field(), field(), field()
    if None in (cipher, kdf, options) or not cipher.isascii() or at + 4 > len(raw):
        return 0
    keys = int.from_bytes(raw[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 64:
        return 0
    return at if all([field() is not None for _ in range(keys + 1)]) else 0


def _decode64(text: str) -> bytes:
    text = text.replace("-", "+").replace("_", "/")
    text = text[: len(text) // 4 * 4 + (len(text) % 4 if len(text) % 4 > 1 else 0)]
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4))
    except (binascii.Error, ValueError):
        return b""


def _json(text: str) -> dict:
    try:
        out = json.loads(_decode64(text))
    except (ValueError, RecursionError):
        return {}
    return out if isinstance(out, dict) else {}


def _lines(text: str, at: int, need: int) -> tuple[str, int, bool]:
    """The first need characters of the wrapped run at at, their end in text, whether there are as many."""
    parts, end = [], at
    while run := _RUN.match(text, at):
        end = min(run.end(), at + need)
        parts.append(text[at:end])
        need -= end - at
        gap = _BREAK.match(text, end) if need else None
        if gap is None:
            break
        at = gap.end()
    return "".join(parts), end, not need


def _key_at(text: str, start: int) -> tuple[str, int] | None:
    """Kind and end, without padding, of the base64 key that begins at start.

    Only what the encoded lengths ask for is read, so that what follows a key,
    or what only looks like one, can hold the next.
    """
    if text[start] == "M":
        raw = _decode64(_lines(text, start, 8)[0])
        size = raw[1] & 0x7F if raw[1] >= 0x80 else 0
        total = 2 + size + (int.from_bytes(raw[2 : 2 + size], "big") if size else raw[1])
        if size > 4 or total * 3 > 4 * len(text):
            return None
        shown, end, whole = _lines(text, start, -(-total * 4 // 3))
        return ("der", end) if whole and private_key_length(_decode64(shown)) == total else None
    need, whole = 1024, True
    while whole:
        shown, _, whole = _lines(text, start, need)
        if n := openssh_length(_decode64(shown)):
            return "openssh", _lines(text, start, -(-n * 4 // 3))[1]
        need *= 4
    return None


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as in KINDS."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if "eyJ" in text:
        for m in _TOKEN.finditer(text):
            algorithm = _json(m[1]).get("alg")
            if isinstance(algorithm, str) and _json(m[2]) and (m[3] or algorithm.lower() == "none"):
                out.append(("jwt", *m.span()))
    at = 0
    while m := _BASE64.search(text, at):
        found = _key_at(text, m.start())
        at = found[1] if found else m.start() + 1
        if found:
            out.append((found[0], m.start(), at + len(re.match(r"={0,2}", text[at : at + 2])[0])))
    for m in _HEX_KEY.finditer(text):
        if n := private_key_length(bytes.fromhex(m[0][: len(m[0]) // 2 * 2])):
            out.append(("der", m.start(), m.start() + 2 * n))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def mask(text: str, spans: list[tuple[str, int, int]], sign: str = "[{}]") -> str:
    """Text with each run of overlapping spans replaced by the name of its first kind."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], sign.format(kind)]
        at, i = end, i + 1
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", masked: bool = False, carry: bool = False) -> DataFrame:
    """Rows (id_col, spans) and, if masked, the text with its secrets replaced.

    spans is an array of (kind, start, end) in code points, end exclusive. One
    pass over whole texts, no shuffle; one row out per row in. Null and empty
    texts have no spans (masked: null stays null); very long texts are read
    whole. Spans with one start are listed by kind; repeated rows and null ids
    stay as they are; an empty table gives no rows. Other columns are not read, or with carry come
    along as they are; spans and masked replace columns of these names.
    """
    require(docs, id_col, text_col)
    more = carried(docs, carry, id_col, text_col, "spans", "masked")
    key = docs.select(id_col).dtypes[0][1]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                spans = [find_spans(t) if t else [] for t in texts]
                columns = [part.column(0), pa.array([[dict(zip(("kind", "start", "end"), s)) for s in x] for x in spans], kind)]
                if masked:
                    columns.append(pa.array([mask(t, s) if s else t for t, s in zip(texts, spans)], pa.string()))
                names = [id_col, "spans", "masked"][: len(columns)]
                yield pa.RecordBatch.from_arrays([*columns, *part.columns[2:]], names=[*names, *more])

    schema = f"`{id_col}` {key}, spans array<{SPAN}>" + ", masked string" * masked + ddl(docs, more)
    return docs.select(id_col, F.col(text_col).cast("string"), *(f"`{c}`" for c in more)).mapInArrow(run, schema)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of all documents, as counts, a digest and a list."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    many = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(many(k).alias(f"n_{k}") for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *(many(k).alias(f"n_{k}") for k in KINDS[3:]))
