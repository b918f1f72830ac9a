"""CRC-32C (Castagnoli, reflected), for whoever must compare with files of other programs; the index itself uses xxhash64 and SHA-256."""

from __future__ import annotations


def _table() -> list[int]:
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0x82F63B78 if byte & 1 else 0)
        out.append(byte)
    return out


_TABLE = _table()


def crc32c(data: bytes, value: int = 0) -> int:
    """The checksum of data; `value` continues that of what came before."""
    crc = ~value & 0xFFFFFFFF
    for b in data:
        crc = _TABLE[(crc ^ b) & 0xFF] ^ crc >> 8
    return ~crc & 0xFFFFFFFF
