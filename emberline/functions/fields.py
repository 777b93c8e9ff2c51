"""Expressions that normalise and check single log fields.

Each function takes the SQL text of an input expression and returns SQL text for ``expr``/``selectExpr``.
Row validation is a few hundred such expressions; as text they cost one call each to build.
"""

from __future__ import annotations

from collections.abc import Iterable

from emberline.schema import EMPTY_MARKERS

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_HEX = "[0-9a-f]{1,4}"
# Groups as written, with or without one "::"; the group count is checked after expansion.
_IPV6_SHAPE = f"^({_HEX}(:{_HEX})*)?(::)?({_HEX}(:{_HEX})*)?$"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}([Tt _]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s?([Zz]|[+-]\d{2}:?\d{2})?)?$"
NUMBER = r"^[+-]?\d+(\.\d+)?$"


def quoted(values: Iterable[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def let(value: str, name: str, body: str) -> str:
    """Bind ``value`` to the lambda variable ``name`` inside ``body``, so it is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def strip(c: str) -> str:
    return rf"trim(BOTH ' \t\n\r\f\u000B' FROM {c})"


def enum_text(c: str) -> str:
    """Trimmed, lower-cased, blanks and hyphens as underscores."""
    return f"translate(lower({strip(c)}), ' -', '__')"


def enum_member(c: str, members: list[str]) -> str:
    """The normalised member, or null when the text names none."""
    return f"CASE WHEN {enum_text(c)} IN ({quoted(members)}) THEN {enum_text(c)} END"


def blank_marker_to_null(c: str) -> str:
    return f"CASE WHEN lower({strip(c)}) NOT IN ({quoted(EMPTY_MARKERS)}) THEN {c} END"


def ipv4_from_number(c: str) -> str:
    octets = ", ".join(f"shiftright(cast({c} AS BIGINT), {shift}) & 255" for shift in (24, 16, 8, 0))
    whole = f"{c} >= 0 AND {c} < 4294967296 AND {c} = floor({c})"
    return f"CASE WHEN {whole} THEN concat_ws('.', {octets}) END"


def _embedded_v4_as_groups(text: str) -> str:
    """Rewrite a dotted tail (``::ffff:1.2.3.4``) as two hex groups."""
    tail = rf"regexp_extract({text}, r'([\d.]+)$', 1)"
    high, low = (f"lower(hex(cast(o[{i}] AS INT) * 256 + cast(o[{i + 1}] AS INT)))" for i in (0, 2))
    rewritten = let(rf"split({tail}, r'\.')", "o", rf"concat(regexp_replace({text}, r'[\d.]+$', ''), {high}, ':', {low})")
    return f"CASE WHEN {tail} RLIKE r'{IPV4}' THEN {rewritten} ELSE {text} END"


def _compress_zero_run(joined: str) -> str:
    """The leftmost longest run of two or more zero groups becomes ``::``."""
    choices = []
    for run in range(8, 1, -1):
        pattern = "r'^(.*?)(?:^|:)0(?::0){%d}(?::|$)(.*)$'" % (run - 1)
        choices.append(f"WHEN {joined} RLIKE {pattern} THEN regexp_replace({joined}, {pattern}, '$1::$2')")
    return f"CASE {' '.join(choices)} ELSE {joined} END"


def _ipv6_groups(text: str) -> str:
    """The eight groups without leading zeros, or null when ``text`` is malformed."""

    def parts(half: str) -> str:
        return f"CASE WHEN coalesce({half}, '') = '' THEN cast(array() AS ARRAY<STRING>) ELSE split({half}, ':') END"

    left, right = parts("h[0]"), parts("get(h, 1)")
    zeros = f"8 - size({left}) - size({right})"
    expanded = (
        f"CASE WHEN size(h) = 1 AND size({left}) = 8 THEN {left} "
        f"WHEN size(h) = 2 AND {zeros} > 0 THEN concat({left}, array_repeat('0', {zeros}), {right}) END"
    )
    groups = f"CASE WHEN {text} RLIKE '{_IPV6_SHAPE}' THEN {let(f'''split({text}, '::')''', 'h', expanded)} END"
    return f"transform({groups}, g -> regexp_replace(g, '^0+(?=.)', ''))"


def ipv6_text(c: str) -> str:
    """Canonical compressed IPv6 text, or null when ``c`` is not an address."""
    scope = rf"regexp_extract({c}, r'(%[^%/\s]+)$', 1)"
    bare = rf"lower(regexp_replace({c}, r'%[^%/\s]+$', ''))"
    joined = let(_embedded_v4_as_groups("t"), "u", f"array_join({_ipv6_groups('u')}, ':')")
    return f"concat({let(let(bare, 't', joined), 'j', _compress_zero_run('j'))}, {scope})"


def ip_text(c: str) -> str:
    """Canonical v4 or v6 address text, or null."""
    return f"CASE WHEN {c} RLIKE r'{IPV4}' THEN {c} WHEN contains({c}, ':') THEN {ipv6_text(c)} END"


def _in_port_range(number: str) -> str:
    return f"CASE WHEN {number} BETWEEN 0 AND 65535 THEN cast({number} AS INT) END"


def port_from_text(c: str) -> str:
    return rf"CASE WHEN {strip(c)} RLIKE r'^[+-]?\d+$' THEN {_in_port_range(f'try_cast({strip(c)} AS BIGINT)')} END"


def port_from_number(c: str) -> str:
    """A JSON number, truncated toward zero."""
    return f"CASE WHEN {c} > -1 AND {c} < 65536 THEN cast({c} AS INT) END"


def time_from_number(c: str) -> str:
    """Epoch seconds, or milliseconds for magnitudes above 2e10."""
    seconds = f"CASE WHEN abs({c}) > 2e10 THEN {c} / 1000 ELSE {c} END"
    return f"CASE WHEN abs({c}) < 2.5e14 THEN timestamp_micros(cast({seconds} * 1000000 AS BIGINT)) END"


def time_from_text(c: str) -> str:
    text = strip(c)
    return (
        f"CASE WHEN {text} RLIKE r'{ISO_TIME}' THEN try_to_timestamp(upper(regexp_replace({text}, '[_ ]', 'T'))) "
        f"WHEN {text} RLIKE r'{NUMBER}' THEN {time_from_number(f'try_cast({text} AS DOUBLE)')} END"
    )


def outside_unit(c: str) -> str:
    """True where a score is not within [0, 1]; NaN and null count as outside."""
    return f"NOT coalesce({c} BETWEEN 0 AND 1, false)"

