"""The design language: where barcodes stand in an index or a read.

A design is tokens separated by ``|``: ``8L`` (or ``8``) looked up, ``8I`` kept as it is,
``8X`` left out, ``GATC*GRTC`` fixed alternatives of one length. Parsing happens on the
driver; tokens turn into Columns with fixed offsets.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from readloom.functions import iupac

DESIGNS = ("bcIndex1", "bcIndex2", "bcRead1", "bcRead2")
SIDES = {"bcIndex1": "i1", "bcIndex2": "i2", "bcRead1": "r1", "bcRead2": "r2"}
_LARGEST = 2**31 - 1


class DesignError(ValueError):
    pass


@dataclass(frozen=True)
class Segment:
    kind: str  # L, I, X or S
    size: int
    start: int
    number: int  # counted from 1 over all tokens
    sequences: tuple[str, ...] = ()

    @property
    def end(self) -> int:
        """The last base, counted from 0."""
        return self.start + self.size - 1


@dataclass(frozen=True)
class Design:
    segments: tuple[Segment, ...] = ()

    @property
    def total(self) -> int:
        return sum(s.size for s in self.segments)

    @property
    def tokens(self) -> tuple[Segment, ...]:
        """What is reported: all but X."""
        return tuple(s for s in self.segments if s.kind != "X")

    @property
    def starts(self) -> list[int]:
        return [s.start for s in self.segments] or [0]

    @property
    def ends(self) -> list[int]:
        return [s.end for s in self.segments]

    def __bool__(self) -> bool:
        return bool(self.segments)

    def __str__(self) -> str:
        return "|".join("*".join(s.sequences) if s.kind == "S" else f"{s.size}{s.kind}" for s in self.segments)


def _parts(text: str, separator: str) -> list[str]:
    """One empty part at the end does not count."""
    parts = text.split(separator)
    return parts[:-1] if parts[-1] == "" else parts


def _token(text: str) -> tuple[str, int, tuple[str, ...]]:
    if not text:
        raise DesignError("empty token")
    if counted := re.fullmatch(r"([^LIX]*)([LIX])", text):
        if re.fullmatch("[0-9]+", counted[1]):
            return counted[2], _size(counted[1]), ()
        if not re.fullmatch("[A-Z*]+", text) or counted[2] in "LIX":
            raise DesignError(f"not a size: {text!r}")
    if re.fullmatch("[0-9]+", text):
        return "L", _size(text), ()
    sequences = tuple(_parts(text, "*"))
    if not sequences or "" in sequences or not all(map(iupac.is_valid, sequences)):
        raise DesignError(f"not a token: {text!r}")
    if len({len(s) for s in sequences}) > 1:
        raise DesignError(f"alternatives differ in length: {text!r}")
    return "S", len(sequences[0]), sequences


def _size(digits: str) -> int:
    if not 0 < int(digits) <= _LARGEST:
        raise DesignError(f"size out of range: {digits}")
    return int(digits)


def parse(text: str | None) -> Design:
    if text is None or not text.strip():
        return Design()
    segments, start = [], 0
    for number, part in enumerate(_parts(text, "|"), 1):
        kind, size, sequences = _token(part)
        segments.append(Segment(kind, size, start, number, sequences))
        start += size
    return Design(tuple(segments))


@dataclass(frozen=True)
class Token:
    """A reported token of one of the four designs; ``column`` names its place in wide rows."""

    design: str
    segment: Segment

    @property
    def side(self) -> str:
        return SIDES[self.design]

    @property
    def column(self) -> str:
        return f"{self.side}_t{self.segment.number}"


def tokens(designs: dict[str, Design]) -> list[Token]:
    """In the order of headers: index 1, index 2, read 1, read 2."""
    return [Token(d, s) for d in DESIGNS for s in designs.get(d, Design()).tokens]


def resolve(spec: str, designs: dict[str, Design]) -> list[Token]:
    """Tokens named by ``bcIndex1-t2|bcRead1-t1``: those of indexes first, repeats kept. All faults are reported at once."""
    found, faults = [], []
    for part in _parts(spec, "|"):
        name = part.strip()
        m = re.fullmatch(r"(bc(?:Index|Read)[12])-t([0-9]+)", name)
        segments = designs.get(m[1], Design()).segments if m else ()
        if not m:
            faults.append(f"unknown token {name!r}")
        elif not segments:
            faults.append(f"{m[1]} has no design")
        elif not 1 <= int(m[2]) <= len(segments):
            faults.append(f"{m[1]} has no token {m[2]}")
        elif segments[int(m[2]) - 1].kind == "X":
            faults.append(f"{name} is left out by its design")
        else:
            found.append(Token(m[1], segments[int(m[2]) - 1]))
    if faults:
        raise DesignError("; ".join(faults))
    index = lambda t: t.design.startswith("bcIndex")
    return [t for t in found if index(t)] + [t for t in found if not index(t)]
