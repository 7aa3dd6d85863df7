"""Check-digit tests (expression text)."""

from __future__ import annotations

from veil.functions.spans import lit, var

# Multiplication in the dihedral group D5, rows 0..9.
D5 = ("0123456789", "1234067895", "2340178956", "3401289567", "4012395678",
      "5987604321", "6598710432", "7659821043", "8765932104", "9876543210")
# The digit permutation by position (mod 8).
PERM = ("0123456789", "1576283094", "5803796142", "8916043527",
        "9453126870", "4286573901", "2793806415", "7046913258")


def digits_only(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def luhn_ok(v: str) -> str:
    return f"luhn_check({digits_only(v)})"


def verhoeff_ok(v: str) -> str:
    """Verhoeff check of the digits of ``v`` (right to left, the product must end at 0)."""
    z, ch = var("z"), var("ch")
    perm = f"int(substring({lit(''.join(PERM))}, {z}.i % 8 * 10 + int({ch}) + 1, 1))"
    product = f"int(substring({lit(''.join(D5))}, {z}.c * 10 + {perm} + 1, 1))"
    return (f"aggregate(reverse(regexp_extract_all({v}, '[0-9]', 0)), named_struct('c', 0, 'i', 0), "
            f"({z}, {ch}) -> named_struct('c', {product}, 'i', {z}.i + 1), {z} -> {z}.c = 0)")
