"""CRC-32 in DuckDB's SQL, which has no such function: a table made by the rule, folded over a text's bytes."""

from __future__ import annotations

from functools import reduce

_POLYNOMIAL = 0xEDB88320
_TABLE = [reduce(lambda c, _: c >> 1 ^ (_POLYNOMIAL if c & 1 else 0), range(8), n) for n in range(256)]


def crc32_sql(text: str) -> str:
    """An expression of the unsigned CRC-32 of the UTF-8 bytes of the expression `text`; of an empty text 0."""
    digits = f"hex(encode({text}))"
    data = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda byte_at: ('0x' || substr({digits}, (2 * byte_at - 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, ({_TABLE}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295)"
