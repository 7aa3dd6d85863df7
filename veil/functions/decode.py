"""Payload decoders (expression text); null when the input does not decode to printable text."""

from __future__ import annotations

from veil.functions.spans import let, lit

PRINTABLE = r"^[\t\n\r\u0020-\u007E\u00A0-\uFFFD]{4,}$"


def _printable(raw: str) -> str:
    return let(f"cast({raw} AS string)",
               lambda s: f"if(is_valid_utf8({s}) AND rlike({s}, {lit(PRINTABLE)}), {s}, NULL)")


def from_base64(v: str) -> str:
    std = f"translate({v}, '-_', '+/')"
    return _printable(f"try_to_binary(rpad({std}, int(ceil(length({v}) / 4) * 4), '='), 'base64')")


def from_hex(v: str) -> str:
    return _printable(f"try_to_binary({v}, 'hex')")


def from_url(v: str) -> str:
    return f"if(contains({v}, '%'), try_url_decode({v}), NULL)"
