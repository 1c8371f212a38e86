"""CRC-32 in DuckDB SQL, by the usual table of 256 remainders, which a query makes from the polynomial."""

# A list of the remainders of all bytes; the reflected polynomial is 0xEDB88320.
TABLE = ("list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda c, x: "
         "xor(c >> 1, 3988292384 * (c & 1)), b))")


def crc32(text: str, table: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of the SQL expression ``text``; ``table`` is a column holding TABLE."""
    hexes = f"hex(encode({text}))"
    digit = "(instr('0123456789ABCDEF', substr({h}, {at}, 1)) - 1)"
    byte = f"(16 * {digit.format(h=hexes, at='2 * i - 1')} + {digit.format(h=hexes, at='2 * i')})::BIGINT"
    bytes_ = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: {byte})"
    return (f"xor(list_reduce({bytes_}, lambda c, x: xor(c >> 8, {table}[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295)")
