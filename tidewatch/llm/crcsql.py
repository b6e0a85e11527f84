"""CRC-32 in SQL that DuckDB runs, for queries whose contract uses it."""

from __future__ import annotations

# The table of the usual reflected CRC-32, one entry for each byte, by its rule.
CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc_of)"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of ``text``; the FROM clause must have ``crc_table``."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce({data}, lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
