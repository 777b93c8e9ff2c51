"""Secret scans with structural confirmation.

Patterns for assignments, access keys and hex runs give the base findings. Runs that could be base64 or hex are
decoded, and only what parses as key material is reported besides: ASN.1 keys whose nested lengths add up, OpenSSH key
files, and signed tokens whose header is a JSON object that names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import small_batches

#: Order of kinds at the same start.
KINDS = ("assign", "access", "hex", "der_base64", "der_hex", "openssh", "signed_token")
#: Fixed by the contract: the base patterns and their least lengths.
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

_BASE64 = re.compile(r"[A-Za-z0-9+/]{24,}(?:\r?\n[A-Za-z0-9+/]{4,})*={0,2}")
_ANY_HEX = re.compile(r"(?:[0-9a-fA-F]{2}){16,}")
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
_OPENSSH = b"openssh-key-v1\x00"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and without overlap within a kind."""
    found = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return found + [(*m.span(), "hex") for m in _HEX.finditer(text)]


def _element(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, content start, content end) of the ASN.1 element at a place; lengths must be the shortest form."""
    if at + 2 > len(data):
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length >= 128:
        n = length - 128
        if not 1 <= n <= 4 or at + n > len(data):
            return None
        length = int.from_bytes(data[at : at + n], "big")
        if length < 128 or length.bit_length() <= 8 * (n - 1):
            return None
        at += n
    return (tag, at, at + length) if at + length <= len(data) else None


def _nested(data: bytes, start: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """Elements that fill a range exactly, with nested sequences checked as well."""
    found = []
    while start < end:
        element = _element(data[:end], start)
        if element is None or len(found) >= 64:
            return None
        if element[0] in (0x30, 0x31) and (depth > 8 or _nested(data, element[1], element[2], depth + 1) is None):
            return None
        found.append(element)
        start = element[2]
    return found


def is_key(data: bytes) -> bool:
    """Whether bytes are one ASN.1 sequence of a private key: a small version, then integers, an algorithm or octets."""
    top = _element(data, 0)
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _nested(data, top[1], top[2])
    if not parts or len(parts) < 3 or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1 or data[parts[0][1]] > 3:
        return False
    tags = [p[0] for p in parts[1:]]
    return (len(tags) >= 5 and set(tags) == {0x02}) or tags[:2] == [0x30, 0x04] or tags[0] == 0x04


def _from_base64(run: str) -> bytes | None:
    run = "".join(run.split())
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4) if "=" not in run else run, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(head: str, body: str) -> bool:
    """Whether a header and body, both URL-safe base64, are JSON objects and the header names its algorithm."""
    try:
        one, two = (json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in (head, body))
    except (binascii.Error, ValueError, RecursionError):
        return False
    return isinstance(one, dict) and isinstance(two, dict) and isinstance(one.get("alg"), str)


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of runs whose decoded bytes have the structure of a key or a signed token."""
    found = []
    for m in _BASE64.finditer(text):
        head = m[0][:2]
        if head not in ("MI", "MC", "MD", "ME", "MF", "MG", "MH", "b3"):  # a sequence tag, or the OpenSSH magic
            continue
        data = _from_base64(m[0])
        if data and is_key(data):
            found.append((*m.span(), "der_base64"))
        elif data and data.startswith(_OPENSSH):
            found.append((*m.span(), "openssh"))
    for m in _ANY_HEX.finditer(text):
        if m[0][:2] == "30" and is_key(bytes.fromhex(m[0])):
            found.append((*m.span(), "der_hex"))
    return found + [(*m.span(), "signed_token") for m in _SIGNED.finditer(text) if m[1][:2] in ("ey", "ew", "eC") and is_signed_token(m[1], m[2])]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rank = {k: i for i, k in enumerate(KINDS)}
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    for batch in small_batches(batches):
        base, more = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            for out, spans in ((base, base_spans(text)), (more, confirmed_spans(text))):
                spans.sort(key=lambda s: (s[0], rank[s[2]], s[1]))
                out.append([{"start": s, "end": e, "kind": k} for s, e, k in spans])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(more, span)], names=["doc_id", "base", "confirmed"])


_SPAN = "array<struct<start:bigint,end:bigint,kind:string>>"


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, base, confirmed) for every row of ``docs``: spans in code points, the end excluded, by start and kind.

    A null text counts as empty and has no spans. Repeated rows and null doc_ids are kept; an empty table gives an
    empty result. Each text is scanned whole, in one pass over the rows where they lie.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _scan, f"doc_id bigint, base {_SPAN}, confirmed {_SPAN}"
    )


def secret_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) as the registered query returns them."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    order = F.transform(F.array(*[F.lit(k) for k in KINDS]), lambda k, i: F.struct(k.alias("kind"), i.alias("at")))
    rank = F.map_from_entries(order)
    every = F.array_sort(F.transform(
        F.concat("base", "confirmed"),
        lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("at"), s["end"].alias("end"), s["kind"].alias("kind")),
    ))
    return secrets(docs).select(
        "doc_id", *[count(k) for k in KINDS[:3]], F.sha2(F.encode(text(F.col("base")), "UTF-8"), 256).alias("base_sha256"), text(every).alias("spans")
    )
