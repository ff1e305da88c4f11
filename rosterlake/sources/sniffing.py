"""The separator, quote and line ends of a delimited file, told from its first lines."""

from __future__ import annotations

import csv
from dataclasses import dataclass

SEPARATORS, QUOTES = (",", "\t", ";", "|"), ('"', "'")


@dataclass(frozen=True)
class Dialect:
    sep: str
    quote: str = '"'
    terminator: str = "\n"
    bom: bool = False


class DialectError(ValueError):
    """No separator gives the first lines equal numbers of cells."""


def _ends(sample: str) -> str:
    """The line end that is met first outside double quotes."""
    inside = False
    for i, c in enumerate(sample):
        if c == '"':
            inside = not inside
        elif not inside and c in "\r\n":
            return "\r\n" if sample[i : i + 2] == "\r\n" else c
    return "\n"


def _read(lines: list[str], sep: str, quote: str) -> tuple[list[int], int] | None:
    """Each record's number of cells, and how many cells begin with a quote that was left in them; None where a quoted cell isn't closed or goes on behind its quote."""
    try:
        rows = [r for r in csv.reader(lines, delimiter=sep, quotechar=quote, doublequote=True, strict=True) if r]
    except csv.Error:
        return None
    return [len(r) for r in rows], sum(c.strip().startswith(QUOTES) for r in rows for c in r)


def sniff(sample: str, whole: bool = False) -> Dialect:
    """The dialect of a sample of the first lines (cut anywhere unless ``whole``).

    For each separator and quote the sample is read; what gives most records the
    header's number of cells wins, then what leaves fewest cells with a quote at
    their start, then the most cells, then the double quote, then the order of
    SEPARATORS.  One column is only taken where no separator
    occurs in the header.
    """
    bom = sample.startswith("﻿")
    sample = sample.removeprefix("﻿")
    terminator = _ends(sample)
    lines = sample.split(terminator)
    if not whole and len(lines) > 1:
        lines = lines[:-1]
    lines = [x + "\n" for x in lines]
    best = None
    for q, quote in enumerate(QUOTES):
        for s, sep in enumerate(SEPARATORS):
            read = _read(lines, sep, quote)
            for cut in range(len(lines) - 1, 0, -1) if read is None and not whole else ():  # the sample ends inside a quoted cell
                if len(lines) - cut > 50:
                    break
                if (read := _read(lines[:cut], sep, quote)) is not None:
                    break
            if read and read[0] and read[0][0] > 1:
                widths, left = read
                even = sum(w == widths[0] for w in widths) / len(widths)
                score = (even, -left, widths[0], -q, -s)
                if best is None or score > best[0]:
                    best = (score, sep, quote)
    if best is None:
        if any(sep in lines[0] for sep in SEPARATORS):
            raise DialectError("no separator gives the first lines equal numbers of cells")
        return Dialect(",", '"', terminator, bom)
    return Dialect(best[1], best[2], terminator, bom)
