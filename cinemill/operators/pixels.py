"""Features of pixels, as numpy over Arrow batches: thumbnails, histograms, likeness, edges, blur, optical flow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view as _windows
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinemill.operators.sliced import neighbours


def decode(h: int, w: int, rgb: bytes) -> np.ndarray:
    return np.frombuffer(rgb, dtype=np.uint8).reshape(h, w, 3)


def gray(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def area_resize(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means over the source area of every target pixel."""

    def matrix(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        low, high = edges[:-1, None], edges[1:, None]
        cover = np.clip(np.minimum(high, np.arange(1, n + 1)) - np.maximum(low, np.arange(n)), 0, None)
        return cover / cover.sum(axis=1, keepdims=True)

    return matrix(x.shape[0], h) @ x @ matrix(x.shape[1], w).T


def thumbnail(image: np.ndarray, short: int = 90) -> np.ndarray:
    """Gray, the shorter edge ``short`` pixels; unchanged only if both edges are at most that."""
    g = gray(image)
    h, w = g.shape
    if max(h, w) <= short:
        return g
    scale = short / min(h, w)
    return area_resize(g, max(1, round(h * scale)), max(1, round(w * scale)))


def hsv(image: np.ndarray) -> np.ndarray:
    """Hue in [0, 180), saturation and value in [0, 256)."""
    x = image.astype(np.float64)
    top, low = x.max(axis=2), x.min(axis=2)
    span = top - low
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    safe = np.where(span > 0, span, 1)
    hue = np.where(top == r, (g - b) / safe, np.where(top == g, 2 + (b - r) / safe, 4 + (r - g) / safe))
    hue = np.where(span > 0, (hue * 30) % 180, 0)
    return np.stack([hue, np.where(top > 0, span / np.where(top > 0, top, 1) * 255, 0), top], axis=2)


def histogram(image: np.ndarray, bins: int = 64) -> np.ndarray:
    """Per HSV channel over [0, 256), each channel of length one, joined."""
    x, out = np.rint(hsv(image)), []
    for c in range(3):
        h = np.histogram(x[..., c], bins=bins, range=(0, 256))[0].astype(np.float64)
        n = np.linalg.norm(h)
        out.append(h / n if n > 0 else h)
    return np.concatenate(out).astype(np.float32)


def ssim_distance(a: np.ndarray, b: np.ndarray, window: int = 7, span: float = 255.0) -> float:
    """1 - mean structural similarity with a uniform window, in [0, 1]."""
    n = min(window, *a.shape, *b.shape)
    if a.shape != b.shape or n < 1:
        return 1.0
    mean = lambda x: _windows(x, (n, n)).mean(axis=(2, 3))
    ma, mb = mean(a), mean(b)
    unbiased = n * n / max(n * n - 1, 1)
    va, vb, cov = (unbiased * x for x in (mean(a * a) - ma**2, mean(b * b) - mb**2, mean(a * b) - ma * mb))
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    s = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))
    return float(np.clip(1 - s.mean(), 0, 1))


def _gradient(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = _windows(np.pad(g, 1, mode="edge"), (3, 3))
    side = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    return (w * side).sum(axis=(2, 3)), (w * side.T).sum(axis=(2, 3))


def edges(g: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edge pixels: thinned gradients above ``high``, and those above ``low`` linked to them."""
    gx, gy = _gradient(g)
    size = np.abs(gx) + np.abs(gy)
    p = np.pad(size, 1)
    h, w = size.shape
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    angle = (np.rad2deg(np.arctan2(gy, gx)) + 180) % 180
    pairs = [((0, 1), (0, -1)), ((1, 1), (-1, -1)), ((1, 0), (-1, 0)), ((1, -1), (-1, 1))]
    way = (np.rint(angle / 45).astype(int)) % 4
    thin = np.zeros(size.shape, dtype=bool)
    for k, (u, v) in enumerate(pairs):
        thin |= (way == k) & (size >= at(*u)) & (size > at(*v))
    weak, strong = thin & (size > low), thin & (size > high)
    while True:
        q = np.pad(strong, 1)
        grown = weak & _windows(q, (3, 3)).any(axis=(2, 3))
        if (grown == strong).all():
            return strong
        strong = grown


def edge_difference(a: np.ndarray, b: np.ndarray) -> float:
    return float((edges(a) ^ edges(b)).mean()) if a.shape == b.shape else 1.0


def laplacian_variance(g: np.ndarray) -> float:
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g).var())


def _expansion(g: np.ndarray, n: int = 5, sigma: float = 1.2):
    """Quadratic fits around every pixel: (A11, A12, A22, b1, b2), by weighted least squares."""
    r = n // 2
    y, x = np.mgrid[-r : r + 1, -r : r + 1].astype(float)
    weight = np.exp(-(x**2 + y**2) / (2 * sigma**2)).ravel()
    basis = np.stack([np.ones_like(x), x, y, x * x, y * y, x * y], axis=-1).reshape(-1, 6)
    solve = np.linalg.inv((basis * weight[:, None]).T @ basis) @ (basis * weight[:, None]).T
    c = _windows(np.pad(g, r, mode="edge"), (n, n)).reshape(*g.shape, -1) @ solve.T
    return c[..., 3], c[..., 5] / 2, c[..., 4], c[..., 1], c[..., 2]


def flow(a: np.ndarray, b: np.ndarray, rounds: int = 3, window: int = 15) -> np.ndarray:
    """Dense displacement from a to b by polynomial expansion, over a pyramid of halved sizes."""
    if min(a.shape) >= 32:
        h, w = a.shape
        small = flow(area_resize(a, h // 2, w // 2), area_resize(b, h // 2, w // 2), rounds, window)
        d = 2 * np.stack([np.kron(small[..., i], np.ones((2, 2))) for i in (0, 1)], axis=-1)
        d = np.pad(d, ((0, h - d.shape[0]), (0, w - d.shape[1]), (0, 0)), mode="edge")
    else:
        d = np.zeros((*a.shape, 2))
    one, two = _expansion(a), _expansion(b)
    h, w = a.shape
    yy, xx = np.mgrid[:h, :w]
    n = min(window, h, w)
    r = n // 2
    smooth = lambda x: _windows(np.pad(x, ((r, n - 1 - r), (r, n - 1 - r)), mode="edge"), (n, n)).mean(axis=(2, 3))
    for _ in range(rounds):
        py, px = np.clip(np.rint(yy + d[..., 1]).astype(int), 0, h - 1), np.clip(np.rint(xx + d[..., 0]).astype(int), 0, w - 1)
        moved = [c[py, px] for c in two]
        a11, a12, a22 = ((one[i] + moved[i]) / 2 for i in range(3))
        b1 = (one[3] - moved[3]) / 2 + a11 * d[..., 0] + a12 * d[..., 1]
        b2 = (one[4] - moved[4]) / 2 + a12 * d[..., 0] + a22 * d[..., 1]
        g11, g12, g22 = smooth(a11**2 + a12**2), smooth(a11 * a12 + a12 * a22), smooth(a12**2 + a22**2)
        h1, h2 = smooth(a11 * b1 + a12 * b2), smooth(a12 * b1 + a22 * b2)
        det = g11 * g22 - g12**2 + 1e-9
        d = np.stack([(g22 * h1 - g12 * h2) / det, (g11 * h2 - g12 * h1) / det], axis=-1)
    return d


def motion(a: np.ndarray, b: np.ndarray) -> float:
    """The 90th percentile of displacement through 10 pixels, at most 1; 0 for unlike sizes."""
    if a.shape != b.shape or min(a.shape) < 5:
        return 0.0
    return float(min(np.percentile(np.linalg.norm(flow(a, b), axis=2), 90) / 10.0, 1.0))


def hash_embedding(image: np.ndarray) -> np.ndarray:
    """160 numbers: an 8 x 8 mean-threshold hash, and 3 x 32 colour counts that sum to one."""
    small = area_resize(gray(image), 8, 8)
    counts = np.concatenate([np.histogram(image[..., c], bins=32, range=(0, 256))[0] for c in range(3)]).astype(np.float64)
    return np.concatenate([(small > small.mean()).ravel(), counts / max(counts.sum(), 1)]).astype(np.float32)


def heuristic_scene(image: np.ndarray) -> str:
    top = image[: max(image.shape[0] // 3, 1)].astype(float)
    red, blue = top[..., 0].mean(), top[..., 2].mean()
    if blue > red + 15 and blue > 80:
        return "outdoor field"
    return "unknown" if image.mean() < 30 else "office"


_SINGLE = "histogram array<float>, thumb_h int, thumb_w int, mean double, blur double, embedding array<float>, scene string"


def _single(h: pd.Series, w: pd.Series, rgb: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b, c in zip(h, w, rgb):
        if c is None or a != a or len(c) != int(a) * int(b) * 3 or not len(c):
            rows.append((None,) * 7)
            continue
        image = decode(int(a), int(b), c)
        t = thumbnail(image)
        rows.append((histogram(image), *t.shape, float(image.mean()), laplacian_variance(gray(image)), hash_embedding(image), heuristic_scene(image)))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _SINGLE.split(", ")])


_PAIR = "motion double, ssim double, edge_diff double"


def _pair(h0: pd.Series, w0: pd.Series, a: pd.Series, h1: pd.Series, w1: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = []
    for p, q, x, r, s, y in zip(h0, w0, a, h1, w1, b):
        if x is None or y is None or not len(x) or not len(y):
            rows.append((None,) * 3)
            continue
        u, v = thumbnail(decode(int(p), int(q), x)), thumbnail(decode(int(r), int(s), y))
        rows.append((motion(u, v), ssim_distance(u, v), edge_difference(u, v)))
    return pd.DataFrame(rows, columns=["motion", "ssim", "edge_diff"])


def frame_features(frames: DataFrame, image: str = "image") -> DataFrame:
    """Adds ``px``: histogram, thumbnail size, mean, variance of the Laplacian, embedding, scene; NULL without pixels."""
    return frames.withColumn("px", F.pandas_udf(_single, _SINGLE)(F.col(f"{image}.h"), F.col(f"{image}.w"), F.col(f"{image}.rgb")))


def pair_features(frames: DataFrame, key: str, order: list[str], image: str = "image", slice_: Column | None = None) -> DataFrame:
    """Adds ``pair``: motion, SSIM distance and edge difference against the frame before with an image.

    Only the image before travels with a frame; slices of a stream overlap by that one row.
    """
    rows = neighbours(frames.filter(F.col(image).isNotNull()), key, order, slice_ if slice_ is not None else F.lit(0), carry=[image])
    p, q = f"prev1.{image}", image
    return rows.withColumn("pair", F.pandas_udf(_pair, _PAIR)(*[F.col(f"{s}.{c}") for s in (p, q) for c in ("h", "w", "rgb")])).drop("prev1")
