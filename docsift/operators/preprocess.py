"""Finding a document in a photograph, straightening it, raising its contrast: NumPy kernels on the arrays of images.py, and their chain.

Edges, outlines, lines and rectangles follow the definitions in the literature; borders and roundings may differ from an image library's.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from docsift.operators import images
from docsift.operators.images import _bytes, adaptive_threshold, four_point_transform, gaussian_blur, to_gray


def labelled(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Connected regions: numbers from 1 on, 0 where mask is false, and how many there are. Runs of rows are joined, not pixels."""
    d, wide = int(diagonal), mask.shape[1] + 3
    change = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(change == 1)
    ends = np.nonzero(change == -1)[1]
    above = (rows - 1) * wide
    lo = np.searchsorted(rows * wide + ends, above + starts - d, "right")
    hi = np.searchsorted(rows * wide + starts, above + ends + d, "left")
    met = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(rows)), met)
    b = np.arange(met.sum()) - np.repeat(np.cumsum(met) - met, met) + np.repeat(lo, met)
    root = np.arange(len(rows))
    while (root[a] != root[b]).any():
        ra, rb = root[a], root[b]
        np.minimum.at(root, ra, np.minimum(ra, rb))
        np.minimum.at(root, rb, np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    heads, number = np.unique(root, return_inverse=True)
    out = np.zeros(mask.shape, np.int64)
    out[mask] = np.repeat(number + 1, ends - starts)
    return out, len(heads)


def shifted(x: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """Each pixel's neighbour at (dy, dx), zero (or false) beyond the border; dy and dx from -1 to 1."""
    wide = np.pad(x, 1)
    return wide[1 + dy : 1 + dy + x.shape[0], 1 + dx : 1 + dx + x.shape[1]]


def edges(gray: np.ndarray, low: float, high: float) -> np.ndarray:
    """Canny's edges: ridges of the gradient above low that hang together with some place above high."""
    wide = np.pad(gray.astype(np.int64), 1, mode="edge")
    smooth = lambda x: x[:-2] + 2 * x[1:-1] + x[2:]
    gx, gy = smooth(wide)[:, 2:] - smooth(wide)[:, :-2], (smooth(wide.T)[:, 2:] - smooth(wide.T)[:, :-2]).T
    ax, ay = np.abs(gx), np.abs(gy)
    size = ax + ay
    level, steep = ay < np.tan(np.pi / 8) * ax, ay > np.tan(3 * np.pi / 8) * ax
    falling = (gx < 0) != (gy < 0)
    ridge = np.where(level, (size > shifted(size, 0, -1)) & (size >= shifted(size, 0, 1)), False)
    ridge |= np.where(steep, (size > shifted(size, -1, 0)) & (size >= shifted(size, 1, 0)), False)
    slanted = ~level & ~steep
    ridge |= slanted & falling & (size > shifted(size, -1, 1)) & (size > shifted(size, 1, -1))
    ridge |= slanted & ~falling & (size > shifted(size, -1, -1)) & (size > shifted(size, 1, 1))
    weak = ridge & (size > low)
    region, n = labelled(weak)
    strong = np.zeros(n + 1, bool)
    strong[region[weak & (size > high)]] = True
    strong[0] = False
    return strong[region]


#: The eight neighbours, clockwise from the right: (dy, dx).
AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def outline(mask: np.ndarray) -> np.ndarray:
    """The outer border of the region that holds the first pixel of mask, in order, as (x, y)."""
    inside = np.pad(mask, 1)
    y, x = (int(v[0]) for v in np.nonzero(inside))
    out, start, back, first = [], (y, x), 4, None
    for _ in range(4 * int(mask.sum()) + 4):
        step = next((k for k in ((back + i) % 8 for i in range(1, 9)) if inside[y + AROUND[k][0], x + AROUND[k][1]]), None)
        if step is None:
            return np.array([[x - 1, y - 1]])
        if (y, x) == start and step == first:
            break
        first = step if first is None else first
        out.append((x - 1, y - 1))
        # seen from the next pixel, the last one outside
        seen = AROUND[(step - 1) % 8]
        back = AROUND.index((seen[0] - AROUND[step][0], seen[1] - AROUND[step][1]))
        y, x = y + AROUND[step][0], x + AROUND[step][1]
    return np.array(out)


def area(polygon: np.ndarray) -> float:
    x, y = polygon[:, 0].astype(float), polygon[:, 1].astype(float)
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def perimeter(polygon: np.ndarray) -> float:
    return float(np.hypot(*(np.roll(polygon, -1, 0) - polygon).T).sum())


def off_line(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far points are from the line through a and b."""
    d, r = (b - a).astype(float), (points - a).astype(float)
    long = float(np.hypot(*d))
    return np.hypot(*r.T) if not long else np.abs(d[0] * r[:, 1] - d[1] * r[:, 0]) / long


def simplified(polygon: np.ndarray, most: float) -> np.ndarray:
    """Douglas and Peucker's polygon with fewer corners, none of the old ones further off than most."""
    far = lambda p: int(np.argmax(np.hypot(*(polygon - p).T)))
    polygon = np.roll(polygon, -far(polygon[0]), 0)
    cut, ring = far(polygon[0]), np.concatenate([polygon, polygon[:1]])
    keep, open_ = {0, cut}, [(0, cut), (cut, len(polygon))]
    while open_:
        a, b = open_.pop()
        if b - a > 1:
            off = off_line(ring[a + 1 : b], ring[a], ring[b])
            if off.max() > most:
                k = a + 1 + int(off.argmax())
                keep.add(k)
                open_ += [(a, k), (k, b)]
    out = [polygon[k] for k in sorted(keep)]
    # a corner where the cut began may lie on a side
    for p in list(out):
        i = next(i for i, q in enumerate(out) if q is p)
        if len(out) > 3 and off_line(p[None], out[i - 1], out[(i + 1) % len(out)])[0] <= most:
            del out[i]
    return np.array(out)


def ordered(corners: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left."""
    down, across = corners.sum(1), corners[:, 1] - corners[:, 0]
    return corners[[down.argmin(), across.argmin(), down.argmax(), across.argmax()]]


def detect_document(image: np.ndarray, least_share: float = 0.1) -> np.ndarray:
    """The first quadrilateral among the five largest outer outlines, upright; the image itself if none of them covers least_share of it and has four corners."""
    found = edges(gaussian_blur(to_gray(image), 5), 50, 200)
    for _ in range(2):
        found = np.logical_or.reduce([shifted(found, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    if not found.any():
        return image
    region, n = labelled(found)
    ground, _ = labelled(np.pad(~found, 1, constant_values=True), diagonal=False)
    outside = (ground == ground[0, 0])[1:-1, 1:-1]
    border = np.ones(found.shape, bool)
    border[1:-1, 1:-1] = False
    touching = found & (border | np.logical_or.reduce([shifted(outside, *s) for s in AROUND[::2]]))
    least, outlines = least_share * found.size, []
    for k in np.unique(region[touching]).tolist():
        ys, xs = np.nonzero(region == k) if n < 50 else np.divmod(np.flatnonzero(region.ravel() == k), found.shape[1])
        if np.ptp(ys) * np.ptp(xs) >= least:  # an outline is no larger than its box
            outlines.append(outline(region == k))
    for polygon in sorted((p for p in outlines if area(p) >= least), key=area, reverse=True)[:5]:
        corners = simplified(polygon, 0.02 * perimeter(polygon))
        if len(corners) == 4:
            return four_point_transform(image, ordered(corners))
    return image


def near_level(angle: float) -> bool:
    return abs(angle) < 45


def skew_by_lines(image: np.ndarray, votes: int = 100, length: int = 100, gap: int = 10) -> float:
    """The median angle, in degrees, of the near-level lines of edges; 0 if there are none.

    Hough's votes by whole degrees; from the strongest line on, the stretches of edge pixels along it that are long enough and have no
    wider gap are lines, and their pixels are used up.
    """
    ys, xs = np.nonzero(edges(to_gray(image), 50, 150))
    if len(ys) < votes:
        return 0.0
    offset = int(np.hypot(*image.shape[:2])) + 1
    alive, candidates, by_angle = np.ones(len(ys), bool), [], {}
    for degrees in range(-45, 46):
        c, s = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
        rho = np.rint(ys * c - xs * s).astype(int) + offset
        counts = np.bincount(rho)
        candidates += [(int(counts[r]), degrees, int(r)) for r in np.flatnonzero(counts >= votes)]
        order = np.argsort(rho, kind="stable")
        by_angle[degrees] = (order, rho[order], c, s)
    angles = []
    for _, degrees, r in sorted(candidates, key=lambda x: (-x[0], abs(x[1]), x[1], x[2])):
        order, sorted_rho, c, s = by_angle[degrees]
        a, b = np.searchsorted(sorted_rho, [r, r + 1])
        own = order[a:b][alive[order[a:b]]]
        if len(own) < votes:
            continue
        a, b = np.searchsorted(sorted_rho, [r - 1, r + 2])  # a thick line
        own = order[a:b][alive[order[a:b]]]
        along = xs[own] * c + ys[own] * s
        own = own[np.argsort(along, kind="stable")]
        along = np.sort(along)
        for part in np.split(own, np.flatnonzero(np.diff(along) > gap + 1) + 1):
            dx, dy = int(xs[part[-1]] - xs[part[0]]), int(ys[part[-1]] - ys[part[0]])
            if max(abs(dx), abs(dy)) >= length:
                alive[part] = False
                angle = float(np.degrees(np.arctan2(dy, dx)))
                if near_level(angle):
                    angles.append(angle)
    return float(np.median(angles)) if angles else 0.0


def otsu(gray: np.ndarray) -> int:
    """The level that parts dark from light with the most variance between them."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    below, sums = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(invalid="ignore", divide="ignore"):
        between = below * above * (sums / below - (sums[-1] - sums) / above) ** 2
    return int(np.argmax(np.nan_to_num(between)))


def hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The convex hull's corners in order."""

    def chain(points):
        out = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    points = sorted(set(points))
    return chain(points) + chain(points[::-1]) if len(points) > 1 else points


def skew_by_area(image: np.ndarray) -> float:
    """The angle, from -45 to 45 degrees, of the least rectangle around dark pixels, taken as (row, column), so that its sign is
    opposite to a line's; 0 if there are fewer than ten."""
    gray = to_gray(image)
    dark = gray <= otsu(gray)
    if dark.sum() < 10:
        return 0.0
    rows = np.flatnonzero(dark.any(1))
    ends = [(int(r), int(c)) for of in (dark.argmax(1), dark.shape[1] - 1 - dark[:, ::-1].argmax(1)) for r, c in zip(rows, of[rows], strict=True)]
    corners = np.array(hull(ends), float)
    sides = np.roll(corners, -1, 0) - corners

    def box(angle: float) -> float:
        c, s = np.cos(angle), np.sin(angle)
        return float(np.ptp(corners @ (c, s)) * np.ptp(corners @ (-s, c)))

    angle = float(np.degrees(min(np.arctan2(sides[:, 1], sides[:, 0]).tolist(), key=box))) % 90
    return angle - 90 if angle > 45 else angle


def cubic_warp(image: np.ndarray, back: np.ndarray, h: int, w: int, fill: int = 255) -> np.ndarray:
    """As images.warp, for affine maps, by cubic convolution with a = -0.75."""

    def weight(t):
        t = np.abs(t)
        return np.where(t <= 1, 1.25 * t**3 - 2.25 * t**2 + 1, np.where(t < 2, -0.75 * (t**3 - 5 * t**2 + 8 * t - 4), 0))

    ys, xs = np.mgrid[:h, :w]
    x, y = (back[i, 0] * xs + back[i, 1] * ys + back[i, 2] for i in (0, 1))
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros((h, w, *image.shape[2:]))
    for dy in range(-1, 3):
        for dx in range(-1, 3):
            value = image[np.clip(y0 + dy, 0, image.shape[0] - 1), np.clip(x0 + dx, 0, image.shape[1] - 1)].astype(float)
            value[(x0 + dx < 0) | (x0 + dx >= image.shape[1]) | (y0 + dy < 0) | (y0 + dy >= image.shape[0])] = fill
            out += (weight(x - x0 - dx) * weight(y - y0 - dy)).reshape(h, w, *[1] * (image.ndim - 2)) * value
    return _bytes(out)


#: Estimates of skew by name.
SKEWS = {"hough": skew_by_lines, "minAreaRect": skew_by_area}


def deskew(image: np.ndarray, method: str = "hough", most: float = 45.0) -> np.ndarray:
    """Turned back by its skew, on a larger white canvas; left alone if that is under five degrees or over most."""
    if method not in SKEWS:
        raise ValueError(f"unknown method: {method}")
    angle = SKEWS[method](image)
    if not images.skew_guard(angle, most):
        return image
    (h, w), c, s = image.shape[:2], np.cos(np.deg2rad(angle)), np.sin(np.deg2rad(angle))
    tall, wide = int(h * abs(c) + w * abs(s)), int(h * abs(s) + w * abs(c))
    x, y = w // 2, h // 2
    turn = np.array([[c, -s, x], [s, c, y], [0, 0, 1]])
    return cubic_warp(image, turn @ np.array([[1, 0, -x - (wide - w) / 2], [0, 1, -y - (tall - h) / 2], [0, 0, 1]]), tall, wide)


def clahe(image: np.ndarray, clip: float = 2.0, tiles: tuple[int, int] = (8, 8)) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation: each of tiles (across, down) has a curve of its own, and pixels blend those around them."""
    gray = to_gray(image)
    (h, w), (across, down) = gray.shape, tiles
    th, tw = -(-h // down), -(-w // across)
    whole = np.pad(gray, ((0, th * down - h), (0, tw * across - w)), mode="reflect" if min(h, w) > max(th, tw) else "symmetric")
    cells = whole.reshape(down, th, across, tw).swapaxes(1, 2).reshape(down * across, th * tw)
    counts = np.bincount((np.arange(len(cells))[:, None] * 256 + cells).ravel(), minlength=256 * len(cells)).reshape(-1, 256)
    if clip > 0:
        limit = max(1, int(clip * th * tw / 256))
        excess = np.maximum(counts - limit, 0).sum(1)
        counts = np.minimum(counts, limit) + (excess // 256)[:, None]
        for own, left in zip(counts, (excess % 256).tolist(), strict=True):  # what is left is spread evenly
            if left:
                own[np.arange(0, 256, max(256 // left, 1))[:left]] += 1
    curves = np.clip(np.rint(np.cumsum(counts, 1) * (255 / (th * tw))), 0, 255).reshape(down, across, 256)

    def between(n: int, step: int, most: int):
        at = np.arange(n) / step - 0.5
        lo = np.floor(at).astype(int)
        return np.clip(lo, 0, most - 1), np.clip(lo + 1, 0, most - 1), at - lo

    y0, y1, fy = (v[:, None] for v in between(h, th, down))
    x0, x1, fx = (v[None] for v in between(w, tw, across))
    upper = curves[y0, x0, gray] * (1 - fx) + curves[y0, x1, gray] * fx
    lower = curves[y1, x0, gray] * (1 - fx) + curves[y1, x1, gray] * fx
    return _bytes(upper * (1 - fy) + lower * fy)


def bilateral_filter(image: np.ndarray, size: int = 9, color: float = 75, space: float = 75) -> np.ndarray:
    """Means over a disc, of near pixels of like colour: differences add up over channels."""
    r = size // 2
    wide = np.pad(image.astype(float), [(r, r), (r, r), *[(0, 0)] * (image.ndim - 2)], mode="reflect" if min(image.shape[:2]) > r else "edge")
    total, weights = np.zeros(image.shape), np.zeros(image.shape[:2])
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dy * dy + dx * dx <= r * r:
                near = wide[r + dy : r + dy + image.shape[0], r + dx : r + dx + image.shape[1]]
                off = np.abs(near - image)
                weight = np.exp(-((off if image.ndim == 2 else off.sum(2)) ** 2) / (2 * color**2) - (dy * dy + dx * dx) / (2 * space**2))
                total += near * (weight if image.ndim == 2 else weight[..., None])
                weights += weight
    return _bytes(total / (weights if image.ndim == 2 else weights[..., None]))


def enhance(image: np.ndarray, gray: bool = True, contrast: bool = True, clip: float = 2.0, tiles: tuple[int, int] = (8, 8), blur: bool = True, blur_size: int = 3, threshold: bool = True, block: int = 11, constant: float = 2, method: str = "gaussian") -> np.ndarray:
    """Grey, contrast, blur, threshold: each as asked, in this order. Contrast and threshold make an image grey too."""
    image = to_gray(image) if gray else image
    image = clahe(image, clip, tiles) if contrast else image
    image = gaussian_blur(image, blur_size) if blur else image
    return adaptive_threshold(image, block, constant, method) if threshold else image


@dataclass(frozen=True)
class Steps:
    """What is done to an image before recognition."""

    detect: bool = True
    deskew: bool = True
    contrast: bool = True
    threshold: bool = False
    bilateral: bool = True


def preprocess(image: np.ndarray, steps: Steps = Steps()) -> np.ndarray:
    """Detection, straightening, the bilateral filter, enhancement; the result is always grey and blurred."""
    image = detect_document(image) if steps.detect else image
    image = deskew(image) if steps.deskew else image
    image = bilateral_filter(image) if steps.bilateral else image
    return enhance(image, contrast=steps.contrast, threshold=steps.threshold)


def preprocessed(table: DataFrame, steps: Steps = Steps(), id_col: str = "doc_id") -> DataFrame:
    """A table of images (see images.transformed) through the chain, in one pass; one that fails keeps its error."""
    return images.transformed(table, lambda image: preprocess(image, steps), id_col)


#: Mean and deviation of red, green and blue that image classifiers are fed with.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def smoothly_resized(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """By a triangle as wide as a pixel of the smaller image."""

    def weights(n: int, m: int) -> np.ndarray:
        step = m / n
        off = np.abs(np.arange(m) + 0.5 - ((np.arange(n) + 0.5) * step)[:, None]) / max(1.0, step)
        own = np.maximum(1 - off, 0)
        return own / own.sum(1, keepdims=True)

    across = _bytes(np.einsum("wx,yxc->ywc", weights(w, image.shape[1]), image))
    return _bytes(np.einsum("hy,ywc->hwc", weights(h, image.shape[0]), across))


def model_input(image: np.ndarray, size: int = 224, seed: int | None = None) -> np.ndarray:
    """A classifier's input: red, green, blue by channel, scaled, of size x size. With a seed as in training: perhaps mirrored (0.3), turned by up
    to five degrees on black, brightness and contrast changed by up to a fifth."""
    x = smoothly_resized(images.to_three(image)[..., ::-1], size, size)
    if seed is not None:
        dice = np.random.default_rng(seed)
        x = x[:, ::-1] if dice.random() < 0.3 else x
        a = np.deg2rad(dice.uniform(-5, 5))
        c, s, mid = np.cos(a), np.sin(a), (size - 1) / 2
        ys, xs = np.mgrid[:size, :size] - mid
        at = np.rint(np.stack([s * xs + c * ys, c * xs - s * ys]) + mid).astype(int)
        inside = ((at >= 0) & (at < size)).all(0)
        x = np.where(inside[..., None], x[tuple(np.clip(at, 0, size - 1))], 0).astype(np.uint8)
        bright, contrast = dice.uniform(0.8, 1.2, 2)
        for step in dice.permutation(2):
            x = _bytes(x * bright) if step else _bytes(contrast * x + (1 - contrast) * np.rint((x @ (0.299, 0.587, 0.114)).mean()))
    return ((x / 255 - MEAN) / DEVIATION).transpose(2, 0, 1).astype(np.float32)
