"""The printable characters that byte-level vocabularies write for the 256 byte values."""

from __future__ import annotations


def byte_of_char() -> dict[str, int]:
    """Printable Latin-1 stands for itself; every other byte takes the next character from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + n): b for n, b in enumerate(others)}


def token_bytes(token: str, table: dict[str, int]) -> bytes:
    return bytes(table[c] for c in token)
