"""Grey images as numpy arrays: measurements and cell detection without an imaging library."""

from __future__ import annotations

import numpy as np

Box = tuple[int, int, int, int]


def white_share(image: np.ndarray, box: Box, inset: int = 2, level: int = 180) -> float | None:
    """Share of light pixels inside a box; None where the inset leaves nothing."""
    x1, y1, x2, y2 = box
    if x2 - x1 <= 2 * inset or y2 - y1 <= 2 * inset:
        return None
    part = image[y1 + inset : y2 - inset, x1 + inset : x2 - inset]
    return float((part > level).mean()) if part.size else None


def dark_corners(image: np.ndarray, box: Box, margin: int, level: int = 128) -> int:
    """How many corners of a box have a dark pixel in the square around them."""
    x1, y1, x2, y2 = box
    around = (image[max(0, y - margin) : y + margin, max(0, x - margin) : x + margin] for y in (y1, y2) for x in (x1, x2))
    return sum(bool((part < level).any()) for part in around if part.size)


def mean_level(image: np.ndarray, box: Box, margin: int = 2) -> float:
    """Mean of a box widened by the margin; white where it lies outside."""
    x1, y1, x2, y2 = box
    part = image[max(0, y1 - margin) : y2 + margin, max(0, x1 - margin) : x2 + margin]
    return float(part.mean()) if part.size else 255.0


def bar_between(image: np.ndarray, a: Box, b: Box, dark: int = 120, share: float = 0.28) -> bool:
    """Whether a dark row lies between a line and the one below it; no where there is no gap or it is 1.8 times the taller line."""
    top, bottom = a[3], b[1]
    if bottom <= top or bottom - top > 1.8 * max(a[3] - a[1], b[3] - b[1]):
        return False
    part = image[max(0, top - 2) : bottom + 3, max(0, min(a[0], b[0])) : max(a[2], b[2])]
    return bool(part.size and (part < dark).mean(axis=1).max() > share)


def otsu(image: np.ndarray) -> int:
    """The level that parts dark from light best."""
    counts = np.bincount(image.ravel(), minlength=256).astype(np.float64)
    below = np.cumsum(counts)
    sums = np.cumsum(counts * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (sums[-1] / below[-1] * below - sums) ** 2 / (below * (below[-1] - below))
    return int(np.nanargmax(between[:-1])) if np.isfinite(between[:-1]).any() else 127


def local_mean(image: np.ndarray, block: int, gaussian: bool = True) -> np.ndarray:
    """Mean of the square of odd width ``block`` around each pixel, the border continued outwards.

    The plain mean is four look-ups in a summed-area table whatever the width; the Gaussian one, whose spread follows from the
    width, is one pass a direction.
    """
    if block % 2 == 0:
        raise ValueError("the width of the square must be odd")
    r = block // 2
    p = np.pad(image.astype(np.float64), r, mode="edge")
    h, w = image.shape
    if not gaussian:
        table = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return (table[block:, block:] - table[:-block, block:] - table[block:, :-block] + table[:-block, :-block]) / block**2
    spread = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    taps = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * spread**2))
    taps /= taps.sum()
    rows = sum(t * p[:, k : k + w] for k, t in enumerate(taps))
    return sum(t * rows[k : k + h] for k, t in enumerate(taps))


def locally_dark(image: np.ndarray, block: int = 21, margin: int = 6, gaussian: bool = True) -> np.ndarray:
    """Pixels darker than the mean around them by the margin: pale lines on shaded ground too."""
    return image <= np.rint(local_mean(image, block, gaussian)) - margin


def ink(image: np.ndarray, block: int = 21, margin: int = 6) -> np.ndarray:
    """Dark pixels by the local or by the page's own threshold."""
    return locally_dark(image, block, margin) | (image <= otsu(image))


def runs(mask: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(row, start, end) of every run of set pixels in a row, ``least`` long at least."""
    h, w = mask.shape
    framed = np.zeros((h, w + 2), bool)  # rows begin and end unset, so changes along all rows are starts and ends in turn
    framed[:, 1:-1] = mask
    flat = framed.ravel()
    changes = np.flatnonzero(flat[1:] != flat[:-1])
    starts, ends = changes[::2], changes[1::2]
    if least > 1:
        keep = ends - starts >= least
        starts, ends = starts[keep], ends[keep]
    rows = starts // (w + 2)
    left = rows * (w + 2)
    return list(zip(rows.tolist(), (starts - left).tolist(), (ends - left).tolist(), strict=True))


def opened(mask: np.ndarray, length: int) -> np.ndarray:
    """Set pixels that lie in horizontal runs of the length: an opening by a flat line."""
    out = np.zeros_like(mask)
    for r, a, b in runs(mask, length):
        out[r, a:b] = True
    return out


def dilated(mask: np.ndarray, times: int = 1) -> np.ndarray:
    """Grown by one pixel in all eight directions, several times."""
    for _ in range(times):
        p = np.pad(mask, 1)
        h, w = mask.shape
        mask = np.logical_or.reduce([p[y : y + h, x : x + w] for y in range(3) for x in range(3)])
    return mask


def components(mask: np.ndarray) -> list[tuple[Box, int]]:
    """Box and pixels of every 8-connected component, by runs of rows joined in a union-find; two rows are gone through side by side."""
    spans = runs(mask, 1)
    parent = list(range(len(spans)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    first, above, end, at = 0, 0, 0, -2  # where the row starts; the run of the row before that is next, and where those end
    for k, (r, a, b) in enumerate(spans):
        if r != at:
            above, end = (first, k) if r == at + 1 else (k, k)
            first, at = k, r
        while above < end and spans[above][2] < a:
            above += 1
        o = above  # the last run that touches may touch the next one too
        while o < end and spans[o][1] <= b:
            x, y = find(k), find(o)
            if x != y:
                parent[x] = y
            o += 1
    found: dict[int, list[int]] = {}
    for k, (r, a, b) in enumerate(spans):
        f = found.setdefault(find(k), [a, r, b, r + 1, 0])
        f[:] = [min(f[0], a), min(f[1], r), max(f[2], b), max(f[3], r + 1), f[4] + b - a]
    return [((f[0], f[1], f[2], f[3]), f[4]) for f in found.values()]


def line_mask(image: np.ndarray, length: int = 35) -> np.ndarray:
    """Dark pixels, by the local or the page's own threshold, in horizontal or vertical lines of the length, grown twice."""
    dark = ink(image)
    return dilated(opened(dark, length) | opened(dark.T, length).T, 2)


def cells_by_components(image: np.ndarray, length: int = 35, min_area: int = 200, max_share: float = 0.85, max_aspect: float = 40.0) -> list[Box]:
    """The light regions that ruling lines enclose."""
    total = image.shape[0] * image.shape[1]
    out = []
    for box, pixels in components(~line_mask(image, length)):
        w, h = box[2] - box[0], box[3] - box[1]
        if pixels >= min_area and w * h <= max_share * total and max(w, h) / max(1, min(w, h)) <= max_aspect:
            out.append(box)
    return sorted(out, key=lambda b: (b[1], b[0]))


def ruling_lines(image: np.ndarray, length: int = 80) -> list[tuple[str, int, int, int]]:
    """(orient, pos, lo, hi) of long dark lines, one for each position."""
    dark = image <= otsu(image)
    found: dict[tuple[str, int], list[int]] = {}
    for orient, mask in (("h", dark), ("v", dark.T)):
        for pos, lo, hi in runs(mask, length):
            f = found.setdefault((orient, pos), [lo, hi])
            f[:] = [min(f[0], lo), max(f[1], hi)]
    return [(o, p, lo, hi) for (o, p), (lo, hi) in sorted(found.items())]


def shrunk(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """The image in fewer pixels, each the mean of the pixels that it covers."""
    ys, xs = np.arange(h) * image.shape[0] // h, np.arange(w) * image.shape[1] // w
    sums = np.add.reduceat(np.add.reduceat(image.astype(np.int64), ys, axis=0), xs, axis=1)
    covers = np.diff(np.append(ys, image.shape[0]))[:, None] * np.diff(np.append(xs, image.shape[1]))[None, :]
    return np.rint(sums / covers).astype(np.uint8)
