"""Which releases to load: classification of file names, ordering, missing months."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

MONTHS = "january february march april may june july august september october november december".split()
_MONTHLY = re.compile(r"_(January|February|March|April|May|June|July|August|September|October|November|December)_(\d{4})(?:_V(\d+))?\.zip$", re.IGNORECASE)
_WEEKLY = re.compile(r"_(\d{6})_(\d{6})_Weekly(?:_V(\d+))?\.zip$", re.IGNORECASE)


@dataclass(frozen=True, order=True)
class Release:
    day: dt.date
    weekly: bool
    version: int
    name: str


def classify(name: str) -> Release | None:
    """A monthly or weekly registry file, dated by its month's first or its week's last day; other names are none."""
    if m := _MONTHLY.search(name):
        return Release(dt.date(int(m[2]), MONTHS.index(m[1].lower()) + 1, 1), False, int(m[3] or 1), name)
    if m := _WEEKLY.search(name):
        return Release(dt.datetime.strptime(m[2], "%m%d%y").date(), True, int(m[3] or 1), name)
    return None


def plan(names: list[str], loaded: dt.date | None = None) -> list[Release]:
    """The newest monthly file and the weekly ones after it, or, if something is loaded, what is newer; the newest version of each, in order."""
    known = [r for r in map(classify, names) if r]
    best: dict[tuple, Release] = {}
    for r in known:
        key = (r.day, r.weekly)
        best[key] = max(best.get(key, r), r, key=lambda x: x.version)
    found = sorted(best.values())
    monthly = [r for r in found if not r.weekly]
    if loaded is None:
        base = monthly[-1:]
        return base + [r for r in found if r.weekly and (not base or r.day > base[0].day)]
    return [r for r in found if r.day > loaded]


def missing_months(have: list[dt.date], first: dt.date, last: dt.date) -> list[dt.date]:
    out, at, known = [], first.replace(day=1), {d.replace(day=1) for d in have}
    while at <= last:
        if at not in known:
            out.append(at)
        at = (at + dt.timedelta(days=32)).replace(day=1)
    return out
