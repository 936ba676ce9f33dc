"""Packed DNA: a length, two bits a base and, if there is any N, one bit a base for it."""

from __future__ import annotations

_BITS = {"A": 0, "C": 1, "G": 2, "T": 3, "N": 0}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def encode(sequence: str) -> bytes:
    """Case is folded; a character outside ACGTN raises ValueError."""
    s = sequence.upper()
    if set(s) - _BITS.keys():
        raise ValueError(f"cannot pack {sequence!r}")
    bases = sum(_BITS[c] << 2 * i for i, c in enumerate(s)).to_bytes(-(-len(s) // 4), "little")
    if "N" not in s:
        return _varint(len(s)) + bases + b"\0"
    mask = sum((c == "N") << i for i, c in enumerate(s)).to_bytes(-(-len(s) // 8), "little")
    return _varint(len(s)) + bases + _varint(len(mask)) + mask


def decode(data: bytes) -> str:
    def read(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return n, at

    size, at = read(0)
    bases = int.from_bytes(data[at : at + -(-size // 4)], "little")
    masked, at = read(at + -(-size // 4))
    mask = int.from_bytes(data[at : at + masked], "little")
    return "".join("N" if mask >> i & 1 else "ACGT"[bases >> 2 * i & 3] for i in range(size))
