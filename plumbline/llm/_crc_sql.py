"""CRC-32 in DuckDB's SQL, which has no such function: a table made from the polynomial, then a fold over the bytes."""

from __future__ import annotations

# Eight halvings of each byte, as a fold over eight dummies.
CRC_TABLE = (
    "crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], "
    "lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"
)


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, with ``crc`` among the tables."""
    codes = f"list_transform(range(CAST(strlen({text}) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"CASE WHEN {text} IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) END"
