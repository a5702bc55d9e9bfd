"""Image kernels in NumPy, on uint8 arrays (height, width) or (height, width, 3) in blue, green, red order, and one step to run a chain of them.

Document detection, deskewing and contrast are in preprocess.py.
"""

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def to_gray(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return np.clip(np.rint(image[..., 0] * 0.114 + image[..., 1] * 0.587 + image[..., 2] * 0.299), 0, 255).astype(np.uint8)


def to_three(image: np.ndarray) -> np.ndarray:
    return np.repeat(image[..., None], 3, 2) if image.ndim == 2 else image


def _filtered(image: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    half = len(kernel) // 2
    pad = [(half, half) if a == axis else (0, 0) for a in range(image.ndim)]
    wide = np.pad(image.astype(float), pad, mode="reflect" if image.shape[axis] > half else "edge")
    n = image.shape[axis]
    return sum(k * np.take(wide, np.arange(i, i + n), axis) for i, k in enumerate(kernel))


def gaussian_kernel(size: int, sigma: float) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def gaussian_blur(image: np.ndarray, size: int = 3, sigma: float = 0.0) -> np.ndarray:
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = gaussian_kernel(size, sigma)
    return _bytes(_filtered(_filtered(image, k, 0), k, 1))


def adaptive_threshold(image: np.ndarray, block: int = 11, constant: float = 2, method: str = "gaussian") -> np.ndarray:
    gray = to_gray(image)
    k = gaussian_kernel(block, 0.3 * ((block - 1) * 0.5 - 1) + 0.8) if method == "gaussian" else np.full(block, 1 / block)
    mean = np.rint(_filtered(_filtered(gray, k, 0), k, 1))
    return np.where(gray > mean - constant, 255, 0).astype(np.uint8)


def closing(image: np.ndarray, kernel: tuple[int, int] = (2, 2), iterations: int = 1) -> np.ndarray:
    """Dilation, then erosion, by a rectangle."""

    def slide(x, f, fill):
        h, w = kernel[1], kernel[0]
        pad = np.pad(x, [(h // 2, h - 1 - h // 2), (w // 2, w - 1 - w // 2), *[(0, 0)] * (x.ndim - 2)], constant_values=fill)
        return f([pad[i : i + x.shape[0], j : j + x.shape[1]] for i in range(h) for j in range(w)], axis=0)

    for _ in range(iterations):
        image = slide(image, np.max, 0)
    for _ in range(iterations):
        image = slide(image, np.min, 255)
    return image


def scale(image: np.ndarray, factor: float) -> np.ndarray:
    """Bilinear; sizes are truncated; 1 and more leave the image as it is."""
    if factor >= 1:
        return image
    return resize(image, max(1, int(image.shape[0] * factor)), max(1, int(image.shape[1] * factor)))


def resize(image: np.ndarray, h: int, w: int) -> np.ndarray:
    def grid(n, m):
        at = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, m - 1), at - lo

    (y0, y1, fy), (x0, x1, fx) = grid(h, image.shape[0]), grid(w, image.shape[1])
    fy = fy.reshape(-1, *[1] * (image.ndim - 1))
    fx = fx.reshape(1, -1, *[1] * (image.ndim - 2))
    rows = image[y0] * (1 - fy) + image[y1] * fy
    return _bytes(rows[:, x0] * (1 - fx) + rows[:, x1] * fx)


def warp(image: np.ndarray, back: np.ndarray, h: int, w: int, fill: int = 255) -> np.ndarray:
    """Each pixel of the result is taken, bilinearly, from where the 3 x 3 matrix back sends it."""
    ys, xs = np.mgrid[:h, :w]
    p = back @ np.stack([xs.ravel(), ys.ravel(), np.ones(h * w)])
    x, y = (p[0] / p[2]).reshape(h, w), (p[1] / p[2]).reshape(h, w)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros((h, w, *image.shape[2:]))
    for dy in (0, 1):
        for dx in (0, 1):
            weight = (1 - np.abs(x - x0 - dx)) * (1 - np.abs(y - y0 - dy))
            inside = (x0 + dx >= 0) & (x0 + dx < image.shape[1]) & (y0 + dy >= 0) & (y0 + dy < image.shape[0])
            value = image[np.clip(y0 + dy, 0, image.shape[0] - 1), np.clip(x0 + dx, 0, image.shape[1] - 1)].astype(float)
            value[~inside] = fill
            out += weight.reshape(h, w, *[1] * (image.ndim - 2)) * value
    return _bytes(out)


def rotate(image: np.ndarray, degrees: float, expand: bool = False) -> np.ndarray:
    """About the centre, counter-clockwise, on white."""
    h, w = image.shape[:2]
    a = np.deg2rad(degrees)
    c, s = np.cos(a), np.sin(a)
    nh, nw = (int(h * abs(c) + w * abs(s)), int(h * abs(s) + w * abs(c))) if expand else (h, w)
    back = np.array([[1, 0, w / 2], [0, 1, h / 2], [0, 0, 1]]) @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]) @ np.array([[1, 0, -nw / 2], [0, 1, -nh / 2], [0, 0, 1]])
    return warp(image, back, nh, nw)


def four_point_transform(image: np.ndarray, corners) -> np.ndarray:
    """The quadrilateral [top left, top right, bottom right, bottom left] as an upright rectangle with its longest opposite sides."""
    q = np.array(corners, float)
    side = lambda i, j: float(np.hypot(*(q[i] - q[j])))
    w, h = max(1, int(max(side(2, 3), side(1, 0)))), max(1, int(max(side(1, 2), side(0, 3))))
    target = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
    rows = []
    for (x, y), (u, v) in zip(target, q, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, u], [0, 0, 0, x, y, 1, -v * x, -v * y, v]]
    rows = np.array(rows)
    m = np.append(np.linalg.lstsq(rows[:, :8], rows[:, 8], rcond=None)[0], 1).reshape(3, 3)
    return warp(image, m, h, w, 0)


def skew_guard(angle: float, most: float = 45.0, least: float = 5.0) -> bool:
    """Whether an image is turned at all."""
    return least <= abs(angle) <= most


#: The JPEG standard's example quantization tables, for brightness and for colour.
LUMA = """
16 11 10 16 24 40 51 61
12 12 14 19 26 58 60 55
14 13 16 24 40 57 69 56
14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77
24 35 55 64 81 104 113 92
49 64 78 87 103 121 120 101
72 92 95 98 112 100 103 99
"""
CHROMA = """
17 18 24 47 99 99 99 99
18 21 26 66 99 99 99 99
24 26 56 99 99 99 99 99
47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
"""


def jpeg(image: np.ndarray, quality: int = 10) -> np.ndarray:
    """What is left of an image after JPEG at a quality from 1 to 100, colours at half the resolution. Only rounding loses anything, so
    no bytes are coded."""
    share = 5000 / quality if quality < 50 else 200 - 2 * quality
    k, x = np.mgrid[:8, :8]
    cosines = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)

    def kept(plane: np.ndarray, table: str) -> np.ndarray:
        steps = np.clip((np.array(table.split(), float).reshape(8, 8) * share + 50) // 100, 1, 255)
        h, w = plane.shape
        whole = np.pad(plane - 128.0, ((0, -h % 8), (0, -w % 8)), mode="edge")
        blocks = whole.reshape(whole.shape[0] // 8, 8, whole.shape[1] // 8, 8).swapaxes(1, 2)
        blocks = np.rint(cosines @ blocks @ cosines.T / steps) * steps
        back = (cosines.T @ blocks @ cosines).swapaxes(1, 2).reshape(whole.shape)
        return _bytes(back[:h, :w] + 128)

    if image.ndim == 2:
        return kept(image, LUMA)
    h, w = image.shape[:2]
    blue, green, red = np.moveaxis(image.astype(float), 2, 0)
    y = 0.299 * red + 0.587 * green + 0.114 * blue
    halves = []
    for other, full in ((blue, 1.772), (red, 1.402)):
        even = np.pad(128 + (other - y) / full, ((0, h % 2), (0, w % 2)), mode="edge")
        half = kept(_bytes(even.reshape(even.shape[0] // 2, 2, even.shape[1] // 2, 2).mean((1, 3))), CHROMA)
        halves.append(resize(half, *even.shape)[:h, :w].astype(float) - 128)
    y, (cb, cr) = kept(_bytes(y), LUMA).astype(float), halves
    blue, red = y + 1.772 * cb, y + 1.402 * cr
    return _bytes(np.stack([blue, (y - 0.299 * red - 0.114 * blue) / 0.587, red], 2))


def motion_blur(image: np.ndarray, size: int = 15) -> np.ndarray:
    return _bytes(_filtered(image, np.full(size, 1 / size), 1))


def gaussian_noise(image: np.ndarray, std: float, seed: int = 42) -> np.ndarray:
    return np.clip(image + np.random.default_rng(seed).normal(0, std, image.shape), 0, 255).astype(np.uint8)


def salt_and_pepper(image: np.ndarray, amount: float = 0.03, seed: int = 42) -> np.ndarray:
    r, out = np.random.default_rng(seed), image.copy()
    n = int(amount * image.size * 0.5)
    for value in (255, 0):
        out[r.integers(0, image.shape[0], n), r.integers(0, image.shape[1], n)] = value
    return out


def area_shrunk(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """A smaller image whose pixels are the means of the areas that they cover, parts of pixels counting by their share."""

    def sums(x: np.ndarray, n: int) -> np.ndarray:
        edges = np.arange(n + 1) * (len(x) / n)
        whole = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0)])
        low = np.minimum(edges.astype(int), len(x) - 1)
        share = (edges - low).reshape(-1, *(1,) * (x.ndim - 1))
        return np.diff(whole[low] + share * x[low], axis=0) / (len(x) / n)

    rows = sums(image.astype(np.float64), height)
    return _bytes(np.swapaxes(sums(np.swapaxes(rows, 0, 1), width), 0, 1))


def low_resolution(image: np.ndarray, factor: float) -> np.ndarray:
    h, w = image.shape[:2]
    return resize(area_shrunk(image, max(1, int(h * factor)), max(1, int(w * factor))), h, w)


def lighting(image: np.ndarray, seed: int = 42) -> np.ndarray:
    """Darker with the distance from a random place, by up to 60 %."""
    h, w = image.shape[:2]
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    far = np.hypot(x - r.integers(0, w), y - r.integers(0, h))
    factor = 1 - 0.6 * far / max(far.max(), 1e-9)
    return np.clip(image * (factor[..., None] if image.ndim == 3 else factor), 0, 255).astype(np.uint8)


def either(angle: float, seed: int) -> float:
    return angle if np.random.default_rng(seed).integers(0, 2) else -angle


def blurred(image: np.ndarray, seed: int, sigma: float) -> np.ndarray:
    return gaussian_blur(image, int(6 * sigma + 1) | 1, sigma)


#: The named degradations with their kernels (of an image, a seed and a parameter) and parameters.
DEGRADATION_TABLE = [
    ("blur_light", blurred, 1.0),
    ("blur_medium", blurred, 3.0),
    ("blur_heavy", blurred, 5.0),
    ("motion_blur", lambda image, seed, size: motion_blur(image, size), 15),
    ("rotation_5", lambda image, seed, degrees: rotate(image, either(degrees, seed)), 5),
    ("rotation_10", lambda image, seed, degrees: rotate(image, either(degrees, seed)), 10),
    ("rotation_15", lambda image, seed, degrees: rotate(image, either(degrees, seed)), 15),
    ("noise_light", lambda image, seed, std: gaussian_noise(image, std, seed), 15),
    ("noise_heavy", lambda image, seed, std: gaussian_noise(image, std, seed), 40),
    ("salt_pepper", lambda image, seed, amount: salt_and_pepper(image, amount, seed), 0.03),
    ("low_res_25", lambda image, seed, factor: low_resolution(image, factor), 0.25),
    ("low_res_50", lambda image, seed, factor: low_resolution(image, factor), 0.5),
    ("jpeg_q10", lambda image, seed, quality: jpeg(image, quality), 10),
    ("jpeg_q20", lambda image, seed, quality: jpeg(image, quality), 20),
    ("jpeg_q30", lambda image, seed, quality: jpeg(image, quality), 30),
    ("lighting", lambda image, seed, _: lighting(image, seed), None),
]
DEGRADATIONS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {name: (lambda image, seed, kernel=kernel, value=value: kernel(image, seed, value)) for name, kernel, value in DEGRADATION_TABLE}


def transformed(images: DataFrame, step: Callable[[np.ndarray], np.ndarray], id_col: str = "doc_id") -> DataFrame:
    """Images (id, height, width, channels, data) through a chain of kernels, in one pass, with the seconds that each took; what fails keeps its error."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                began = time.perf_counter()
                try:
                    shape = (row.height, row.width) if row.channels == 1 else (row.height, row.width, row.channels)
                    x = np.ascontiguousarray(step(np.frombuffer(row.data, np.uint8).reshape(shape)))
                    out.append((getattr(row, id_col), x.shape[0], x.shape[1], 1 if x.ndim == 2 else x.shape[2], x.tobytes(), None, time.perf_counter() - began))
                except Exception as e:  # noqa: BLE001
                    out.append((getattr(row, id_col), row.height, row.width, row.channels, None, str(e), time.perf_counter() - began))
            yield pd.DataFrame(out, columns=[id_col, "height", "width", "channels", "data", "error", "seconds"])

    kind = images.schema[id_col].dataType.simpleString()
    return images.select(id_col, "height", "width", "channels", "data").mapInPandas(run, f"{id_col} {kind}, height int, width int, channels int, data binary, error string, seconds double")
