"""Cells between the ruling lines of one page. What is looked up is sorted, so a dense page costs its lines and cells, not their pairs with segments."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from itertools import accumulate, pairwise

#: A segment: orientation (h or v), position, first and last point along it.
Segment = tuple[str, int, int, int]


def anchored(positions: list[int], reach: int) -> dict[int, int]:
    """Each position's anchor: the first one within reach, from the least on."""
    out, last = {}, None
    for p in sorted(set(positions)):
        last = last if last is not None and p - last <= reach else p
        out[p] = last
    return out


def crossings(lines: list[int], others: list[tuple[int, int, int]], window: int) -> list[int]:
    """For each of the sorted ``lines`` the number of positions of ``others`` (position, first, last) one of whose ranges, widened by the window, holds it."""
    ranges = defaultdict(list)
    for pos, lo, hi in others:
        ranges[pos].append((lo - window, hi + window))
    steps = [0] * (len(lines) + 1)
    for held in ranges.values():
        after = 0  # lines before this one are counted for the position
        for lo, hi in sorted(held):
            first, end = max(after, bisect_left(lines, lo)), bisect_right(lines, hi)
            if end > first:
                steps[first] += 1
                steps[end] -= 1
                after = end
    return list(accumulate(steps[:-1]))


def closed(lines: list[int], gaps: list[tuple[int, int]], segments: list[tuple[int, int, int]], tolerance: int) -> dict[int, list[bool]]:
    """For each line whether a segment (position, first, last) near it covers each gap, all within the tolerance."""
    ordered = sorted(segments)
    at = [s[0] for s in ordered]
    out = {}
    for line in lines:
        near = sorted(s[1:] for s in ordered[bisect_left(at, line - tolerance) : bisect_right(at, line + tolerance)])
        starts, ends = [s[0] for s in near], list(accumulate((s[1] for s in near), max))
        held = [(bisect_right(starts, a + tolerance), b - tolerance) for a, b in gaps]
        out[line] = [n > 0 and ends[n - 1] >= b for n, b in held]
    return out


def cells(segments: list[Segment], reach: int, window: int, least: int, widths: tuple[int, int], heights: tuple[int, int], tolerance: int) -> list[tuple[int, int, int, int]]:
    """Boxes between neighbouring lines that are closed on three sides at least: lines are positions merged within reach and crossed ``least`` times."""
    by = {o: [s[1:] for s in segments if s[0] == o] for o in "hv"}
    for o, found in by.items():
        anchor = anchored([s[0] for s in found], reach)
        by[o] = [(anchor[p], lo, hi) for p, lo, hi in found]
    kept = {}
    for o, other in (("h", "v"), ("v", "h")):
        lines = sorted({s[0] for s in by[o]})
        kept[o] = [p for p, n in zip(lines, crossings(lines, by[other], window), strict=True) if n >= least]
    rows = [g for g in pairwise(kept["h"]) if heights[0] <= g[1] - g[0] <= heights[1]]
    columns = [g for g in pairwise(kept["v"]) if widths[0] <= g[1] - g[0] <= widths[1]]
    if not rows or not columns:
        return []
    flat, upright = closed(kept["h"], columns, by["h"], tolerance), closed(kept["v"], rows, by["v"], tolerance)
    return [
        (x1, y1, x2, y2)
        for i, (y1, y2) in enumerate(rows)
        for j, (x1, x2) in enumerate(columns)
        if flat[y1][j] + flat[y2][j] + upright[x1][i] + upright[x2][i] >= 3
    ]
