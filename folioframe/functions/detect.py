"""Detectors on grey images in numpy: edges, line segments and outer contours.

Every function is deterministic; the segment search draws its points by a seed. Coordinates are pixels, x to the right.
"""

from __future__ import annotations

import numpy as np

from .raster import dilated


def run_labels(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, start, end and component of each horizontal run of set pixels; components are numbered by their first run.

    Runs of neighbouring rows that touch are joined by handing the smallest number on until nothing changes, with numbers
    that point to numbers followed at each round, so a long winding component takes few rounds.
    """
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    n = len(row)
    if not n:
        return row, start, end, np.zeros(0, np.int64)
    reach = int(diagonal)
    wide = mask.shape[1] + 2
    # Runs of the row above that end behind this one's start and start before its end are neighbours in this order.
    low = np.searchsorted((row + 1) * wide + end, row * wide + start + 1 - reach, "left")
    high = np.searchsorted((row + 1) * wide + start, row * wide + end - 1 + reach, "right")
    count = np.maximum(high - low, 0)
    below = np.repeat(np.arange(n), count)
    above = np.repeat(low, count) + np.arange(len(below)) - np.repeat(np.cumsum(count) - count, count)
    label = np.arange(n)
    while True:
        least = label.copy()
        both = np.minimum(label[below], label[above])
        np.minimum.at(least, label[below], both)
        np.minimum.at(least, label[above], both)
        while (least[least] != least).any():
            least = least[least]
        least = least[label]
        if (least == label).all():
            return row, start, end, label
        label = least


def painted(shape: tuple[int, int], row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The mask of runs."""
    out = np.zeros((shape[0], shape[1] + 1), np.int32)
    np.add.at(out, (row, start), 1)
    np.add.at(out, (row, end), -1)
    return out.cumsum(1)[:, :-1] > 0


def edges(image: np.ndarray, low: float = 20, high: float = 80) -> np.ndarray:
    """Edge pixels: ridges of the gradient over ``low`` that hang together with one over ``high``."""
    p = np.pad(image.astype(np.int32), 1, mode="edge")
    right, left = p[:, 2:], p[:, :-2]
    gx = (right - left)[:-2] + 2 * (right - left)[1:-1] + (right - left)[2:]
    down = p[2:] - p[:-2]
    gy = down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
    size = np.abs(gx) + np.abs(gy)
    s = np.pad(size, 1)
    at = lambda dy, dx: s[1 + dy : s.shape[0] - 1 + dy, 1 + dx : s.shape[1] - 1 + dx]
    ax, ay = np.abs(gx), np.abs(gy)
    flat, steep = ay < ax * np.tan(np.pi / 8), ay > ax * np.tan(3 * np.pi / 8)
    rising = (gx < 0) != (gy < 0)
    one = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(rising, at(-1, 1), at(-1, -1))))
    two = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(rising, at(1, -1), at(1, 1))))
    weak = (size > low) & (size > one) & (size >= two)
    strong = weak & (size > high)
    row, start, end, label = run_labels(weak)
    if not len(row):
        return weak
    up = np.pad(strong.cumsum(1), ((0, 0), (1, 0)))
    kept = np.zeros(len(row), bool)
    np.logical_or.at(kept, label, up[row, end] > up[row, start])
    keep = kept[label]
    return painted(weak.shape, row[keep], start[keep], end[keep])


Segment = tuple[int, int, int, int]


def _along(mask: np.ndarray, x: float, y: float, dx: float, dy: float, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Set pixels on a walk from a point by steps of (dx, dy), or beside it, up to the last one before more than ``gap`` steps without one."""
    h, w = mask.shape
    room = [((w - 1 - x) if dx > 0 else x) / abs(dx) if dx else np.inf, ((h - 1 - y) if dy > 0 else y) / abs(dy) if dy else np.inf]
    k = np.arange(int(min(room)) + 1)
    across = np.array([0, -1, 1])[:, None]  # the pixel itself, then its neighbours across the walk
    wide = abs(dx) >= abs(dy)
    xs = np.rint(x + k * dx).astype(np.intp) + (0 if wide else across)
    ys = np.rint(y + k * dy).astype(np.intp) + (across if wide else 0)
    xs, ys = np.broadcast_arrays(xs, ys)
    inside = (xs >= 0) & (xs < w) & (ys >= 0) & (ys < h)
    there = inside & mask[np.clip(ys, 0, h - 1), np.clip(xs, 0, w - 1)]
    hit = np.flatnonzero(there.any(0))
    far = np.flatnonzero(np.diff(hit, prepend=0) > gap + 1)
    hit = hit[: far[0]] if len(far) else hit
    side = there[:, hit].argmax(0)
    return xs[side, hit], ys[side, hit]


def line_segments(mask: np.ndarray, votes: int = 20, min_length: int = 15, max_gap: int = 15, seed: int = 1) -> list[Segment]:
    """Segments (x1, y1, x2, y2) of a mask by a probabilistic Hough search.

    Points are drawn in a seeded order and vote for the lines through them, a degree and a pixel apart. When a line has votes
    enough, the segment around the point is walked both ways, twice: the ends of the first walk give a finer direction. Its
    pixels leave the mask and take their votes back.
    """
    rest = mask.copy()
    ys, xs = np.nonzero(mask)
    h, w = mask.shape
    angle = np.arange(180) * np.pi / 180
    cos, sin = np.cos(angle), np.sin(angle)
    shift = h + w
    count = np.zeros((180, 2 * shift + 1), np.int32)
    voted = np.zeros(mask.shape, bool)
    row = np.arange(180)
    out = []

    def walked(x: float, y: float, dx: float, dy: float) -> tuple[np.ndarray, np.ndarray]:
        """Pixels from one end through the point to the other; a step is a pixel in the direction in which the line is longer."""
        size = max(abs(dx), abs(dy))
        (ax, ay), (bx, by) = _along(rest, x, y, dx / size, dy / size, max_gap), _along(rest, x, y, -dx / size, -dy / size, max_gap)
        return np.concatenate([ax[::-1], bx]), np.concatenate([ay[::-1], by])

    for k in np.random.default_rng(seed).permutation(len(xs)):
        x, y = int(xs[k]), int(ys[k])
        if not rest[y, x]:
            continue
        place = np.rint(x * cos + y * sin).astype(np.intp) + shift
        count[row, place] += 1
        voted[y, x] = True
        best = int(np.argmax(count[row, place]))
        if count[best, place[best]] < votes:
            continue
        px, py = walked(x, y, -sin[best], cos[best])  # a line goes at a right angle to its normal
        if px[0] != px[-1] or py[0] != py[-1]:
            qx, qy = walked(x, y, float(px[-1] - px[0]), float(py[-1] - py[0]))
            if len(qx) > len(px):
                px, py = qx, qy
        back = np.unique(np.stack([py, px], 1), axis=0)
        rest[back[:, 0], back[:, 1]] = False
        if max(abs(int(px[0]) - int(px[-1])), abs(int(py[0]) - int(py[-1]))) >= min_length:
            gave = back[voted[back[:, 0], back[:, 1]]]
            where = np.rint(gave[:, 1:] * cos + gave[:, :1] * sin).astype(np.intp) + shift
            np.subtract.at(count, (np.broadcast_to(row, where.shape), where), 1)
            voted[gave[:, 0], gave[:, 1]] = False
            out.append((int(px[0]), int(py[0]), int(px[-1]), int(py[-1])))
    return out


#: The eight neighbours of a pixel, clockwise from the left one, as (dx, dy).
AROUND = ((-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1))


def border(mask: np.ndarray, x: int, y: int) -> list[tuple[int, int]]:
    """The outer border of the component whose topmost, then leftmost pixel is (x, y), clockwise; ``mask`` has an empty frame."""
    at, came, out = (x, y), 0, []
    first = None
    while True:
        for k in range(8):
            dx, dy = AROUND[(came + k) % 8]
            if mask[at[1] + dy, at[0] + dx]:
                break
        else:
            return [(x, y)]
        move = (at, (dx, dy))
        if move == first:
            return out
        first = first or move
        out.append(at)
        at = (at[0] + dx, at[1] + dy)
        # Go on from the neighbour after the one that we came from.
        came = (AROUND.index((-dx, -dy)) + 1) % 8


def polygon_area(points: list[tuple[int, int]]) -> float:
    """Area within a closed line through the points."""
    p = np.array(points, np.float64)
    x, y = p[:, 0], p[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def simplified(points: list[tuple[int, int]], reach: float) -> list[tuple[int, int]]:
    """The corners of a closed line: points further than ``reach`` from the chord of their stretch, as Douglas and Peucker choose them."""
    if len(points) < 3:
        return list(points)
    p = np.array(points, np.float64)
    far = int(np.argmax(((p - p[0]) ** 2).sum(1)))
    p = np.concatenate([p, p[:1]])
    keep, open_parts = {0, far}, [(0, far), (far, len(points))]
    while open_parts:
        a, b = open_parts.pop()
        if b - a < 2:
            continue
        chord = p[b] - p[a]
        part = p[a + 1 : b] - p[a]
        length = np.hypot(*chord)
        away = np.abs(chord[0] * part[:, 1] - chord[1] * part[:, 0]) / length if length else np.hypot(part[:, 0], part[:, 1])
        k = int(np.argmax(away))
        if away[k] > reach:
            keep.add(a + 1 + k)
            open_parts += [(a, a + 1 + k), (a + 1 + k, b)]
    return [points[k] for k in sorted(keep)]


Contour = tuple[tuple[int, int, int, int], float, int]


def outer_contours(mask: np.ndarray, min_w: int = 1, min_h: int = 1, reach: float = 2.0) -> list[Contour]:
    """Box, enclosed area and number of corners of components that lie in no hole of another, from their borders.

    Components whose box is smaller than ``min_w`` by ``min_h`` are passed over before their border is followed.
    """
    p = np.pad(mask, 1)
    row, start, end, label = run_labels(p)
    if not len(row):
        return []
    outside = run_labels(~p, diagonal=False)
    open_ground = painted(p.shape, *(c[outside[3] == outside[3][0]] for c in outside[:3]))
    low = np.full(len(row), p.shape[1])
    high, last = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    np.minimum.at(low, label, start)
    np.maximum.at(high, label, end)
    np.maximum.at(last, label, row + 1)
    out = []
    for k in np.flatnonzero(label == np.arange(len(row))):
        x, y = int(start[k]), int(row[k])
        if high[k] - low[k] < min_w or last[k] - y < min_h or not open_ground[y, x - 1]:
            continue
        line = border(p, x, y)
        out.append(((int(low[k]) - 1, y - 1, int(high[k]) - 1, int(last[k]) - 1), polygon_area(line), len(simplified(line, reach))))
    return out


def closed(mask: np.ndarray) -> np.ndarray:
    """Small breaks filled: grown and shrunk by one pixel; what lies beyond the image counts as set when shrinking."""
    grown = dilated(np.pad(mask, 1))
    inner = ~dilated(~grown)
    return inner[1:-1, 1:-1]
