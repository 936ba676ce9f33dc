"""Lookup tables: a tab-separated file of name, sequence and optional orientation and scope."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from readloom.functions import iupac
from readloom.plans.design import Design, Token, tokens


class LookupError_(ValueError):
    """A line of the lookup table that cannot be used."""


@dataclass(frozen=True)
class Row:
    name: str
    sequence: str
    orientation: str
    scope: tuple[str, ...]  # empty: any token


@dataclass(frozen=True)
class Entry:
    name: str
    is_rc: bool


def parse(text: str) -> list[Row]:
    """Comments start at the first ``#`` or ``//``. Lines of fewer than two columns are skipped."""
    rows = []
    for line in text.split("\n"):
        line = line.lstrip()
        if cut := re.search("#|//", line):
            line = line[: cut.start()].strip()
        fields = line.split("\t")
        if len(fields) > 1 and fields[-1] == "":
            fields.pop()
        if len(fields) < 2:
            continue
        if not iupac.is_valid(fields[1]):
            raise LookupError_(f"not a sequence: {fields[1]!r}")
        rows.append(Row(fields[0], fields[1], *_third(fields[2] if len(fields) > 2 else "SR|any")))
    return rows


def _third(text: str) -> tuple[str, tuple[str, ...]]:
    if "|" in text:
        orientation, _, scope = text.partition("|")
        orientation = orientation.upper()
    elif text in ("S", "R", "SR", "RS"):
        orientation, scope = text, "any"
    elif text.startswith("bc"):
        orientation, scope = "SR", text
    else:
        raise LookupError_(f"not an orientation or scope: {text!r}")
    if not scope:
        raise LookupError_("empty scope")
    if scope == "any":
        return orientation, ()
    names = tuple(s.strip() for s in scope.split("*"))
    if not all(re.fullmatch(r"bc(Index|Read)[12]-t[0-9]+", n) for n in names):
        raise LookupError_(f"not a scope: {scope!r}")
    return orientation, names


def by_token(rows: list[Row], designs: dict[str, Design]) -> dict[Token, dict[str, Entry]]:
    """For each looked-up token its sequences: the later row wins the name, the sense one the orientation."""
    looked_up = [t for t in tokens(designs) if t.segment.kind == "L"]
    known = {f"{t.design}-t{t.segment.number}": t for t in tokens(designs)}
    out: dict[Token, dict[str, Entry]] = {t: {} for t in looked_up}
    for row in rows:
        if row.scope and not any(s in known for s in row.scope):
            raise LookupError_(f"the scope of {row.name} names no token of any design: {'*'.join(row.scope)}")
        for token in looked_up:
            if row.scope and f"{token.design}-t{token.segment.number}" not in row.scope:
                continue
            table = out[token]
            if row.orientation in ("S", "SR", "RS"):
                table[row.sequence] = Entry(row.name, False)
            if row.orientation in ("R", "SR", "RS"):
                other = iupac.reverse_complement(row.sequence)
                table[other] = Entry(row.name, table[other].is_rc if other in table else True)
    return out


def smallest_distance(table: dict[str, Entry]) -> tuple[int, str, str] | None:
    """The smallest literal distance between entries of one length and different names; None if there are no two.

    Two sequences that differ in d places agree in one of d + 1 blocks, so only entries of
    equal blocks are compared, for growing d: exact for tables of any size.
    """
    best: tuple[int, str, str] | None = None
    for n in sorted({len(s) for s in table}):
        items = sorted((s, e.name) for s, e in table.items() if len(s) == n)
        bases = np.array([list(s.encode()) for s, _ in items], np.uint8).reshape(len(items), n)
        names = np.unique([name for _, name in items], return_inverse=True)[1]
        if names.max(initial=0) == 0:
            continue
        for d in range(n + 1):
            if best is not None and d > best[0]:
                break
            found = min((x for i in range(d + 1) for x in _closest(bases, names, i * n // (d + 1), (i + 1) * n // (d + 1))), default=None)
            if found is not None and found[0] <= d:
                own = (found[0], items[found[1]][0], items[found[2]][0])
                best = own if best is None else min(best, own)
                break
    return best


def _closest(bases: np.ndarray, names: np.ndarray, low: int, high: int, most: int = 512) -> Iterator[tuple[int, int, int]]:
    """The closest pairs of different names among entries whose bases from ``low`` to ``high`` are equal."""
    order = np.lexsort(bases[:, low:high].T[::-1]) if high > low else np.arange(len(bases))
    part = bases[order, low:high]
    ends = np.append(np.flatnonzero((part[1:] != part[:-1]).any(axis=1)) + 1, len(order)) if high > low else np.array([len(order)])
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        group = np.sort(order[a:b])
        for i in range(0, len(group) if b - a > 1 else 0, most):
            rows = group[i : i + most]
            for j in range(i, len(group), most):
                others = group[j : j + most]
                apart = (bases[rows][:, None, :] != bases[others][None, :, :]).sum(axis=2)
                apart = np.where((names[rows][:, None] != names[others][None, :]) & (rows[:, None] < others[None, :]), apart, bases.shape[1] + 1)
                at = int(apart.argmin())
                if apart.flat[at] <= bases.shape[1]:
                    yield int(apart.flat[at]), int(rows[at // len(others)]), int(others[at % len(others)])


def density_warning(table: dict[str, Entry], mismatches: int) -> str | None:
    """A warning where barcodes are so close that ``mismatches`` makes assignments ambiguous."""
    if mismatches < 1:
        return None
    found = smallest_distance(table)
    if found is None or found[0] > 2 * mismatches:
        return None
    return f"{found[1]} and {found[2]} differ in {found[0]} bases; at most {max(0, (found[0] - 1) // 2)} mismatches are safe"
