"""Statistics and distortions of grey images (binary columns of height x width bytes), and QR sizes.

Decoding and encoding of PNG or JPEG and robust QR decoding need libraries that
are not at hand; kernels work on raw grey bytes or binary PGM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE = 512
DARK = 128

#: Bytes that QR versions 1 to 40 hold at error correction level M, byte mode (ISO/IEC 18004).
CAPACITY_M = (
    14, 26, 42, 62, 84, 106, 122, 152, 180, 213, 251, 287, 331, 362, 412, 450, 504, 560, 624, 666,
    711, 779, 857, 911, 997, 1059, 1125, 1190, 1264, 1370, 1452, 1538, 1628, 1722, 1809, 1911, 1989, 2099, 2213, 2331,
)

#: The distortion grid (type, severity, value).
GRID = [
    *(("gaussian_blur", s, float(v)) for s, v in (("mild", 3), ("moderate", 7), ("strong", 11))),
    *(("rotation", f"{v:+d}", float(v)) for v in (-15, -10, -5, 5, 10, 15)),
    *(("jpeg", f"q{v}", float(v)) for v in (90, 60, 30)),
    *(("low_resolution", s, v) for s, v in (("mild", 0.5), ("moderate", 0.3), ("strong", 0.15))),
    *(("perspective", s, v) for s, v in (("mild", 0.05), ("moderate", 0.1))),
]


def qr_version(text: Column) -> Column:
    """The smallest version that holds the UTF-8 bytes at level M in byte mode; null if none does."""
    n = F.octet_length(text)
    return F.coalesce(*(F.when(n <= most, F.lit(v)) for v, most in enumerate(CAPACITY_M, 1)))


def modules_per_side(version: Column) -> Column:
    return 17 + 4 * version


def version_band(version: Column) -> Column:
    return F.when(version <= 3, "v1-v3").when(version <= 6, "v4-v6").otherwise("v7+")


def decode_outcome(expected: Column, payload: Column) -> Column:
    return F.when(payload.isNull() | (payload == ""), "failure").when(payload == expected, "exact").otherwise("mismatch")


def area_resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the area of each new pixel, by differences of running sums."""
    for n in (height, width):
        x = np.ascontiguousarray(x)
        sums = np.zeros((len(x) + 1, x.shape[1]))
        np.cumsum(x, 0, out=sums[1:])
        edges = np.linspace(0, len(x), n + 1)
        low = np.minimum(edges.astype(int), len(x) - 1)
        at = x[low]
        at *= (edges - low)[:, None]
        at += sums[low]
        new = at[1:] - at[:-1]
        new *= n
        new /= len(x)
        x = new.T
    return x


def blurred(x: np.ndarray, size: int) -> np.ndarray:
    """Separable Gaussian of odd width with mirrored edges."""
    sigma, half = 0.3 * ((size - 1) * 0.5 - 1) + 0.8, size // 2
    k = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    k /= k.sum()
    for _ in range(2):
        padded = np.pad(x.astype(float), ((half, half), (0, 0)), mode="reflect")
        x = sum(w * padded[i : i + len(x)] for i, w in enumerate(k)).T
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def low_resolution(x: np.ndarray, share: float) -> np.ndarray:
    h, w = x.shape
    small = area_resized(x.astype(float), max(1, int(h * share)), max(1, int(w * share)))
    rows, columns = np.arange(h) * small.shape[0] // h, np.arange(w) * small.shape[1] // w
    return np.clip(np.rint(small[rows][:, columns]), 0, 255).astype(np.uint8)


def sampled(x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Bilinear values at fractional places; white outside."""
    padded = np.pad(x.astype(float), 1, constant_values=255.0)
    r, c = np.clip(rows + 1, 0, padded.shape[0] - 1.001), np.clip(columns + 1, 0, padded.shape[1] - 1.001)
    i, j = r.astype(int), c.astype(int)
    a, b = r - i, c - j
    out = (1 - a) * ((1 - b) * padded[i, j] + b * padded[i, j + 1]) + a * ((1 - b) * padded[i + 1, j] + b * padded[i + 1, j + 1])
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def rotated(x: np.ndarray, degrees: float) -> np.ndarray:
    """On a canvas large enough for the whole image."""
    t = np.deg2rad(degrees)
    c, s = np.cos(t), np.sin(t)
    h, w = x.shape
    new_h, new_w = int(h * abs(c) + w * abs(s)), int(h * abs(s) + w * abs(c))
    y, z = np.mgrid[:new_h, :new_w]
    y, z = y - (new_h - 1) / 2, z - (new_w - 1) / 2
    return sampled(x, c * y + s * z + (h - 1) / 2, -s * y + c * z + (w - 1) / 2)


def keystone(x: np.ndarray, shift: float) -> np.ndarray:
    """The upper side narrowed by `shift` of the width on both ends."""
    h, w = x.shape
    y, z = np.mgrid[:h, :w].astype(float)
    inset = shift * w * (1 - y / max(1, h - 1))
    return sampled(x, y, (z - inset) * (w - 1) / np.maximum(1e-9, w - 1 - 2 * inset))


KERNELS = {"gaussian_blur": lambda x, v: blurred(x, int(v)), "low_resolution": low_resolution, "rotation": rotated, "perspective": keystone}


def statistics(x: np.ndarray) -> dict[str, float]:
    """Image features on a 512 x 512 copy; the aspect ratio is that of the original.

    Grey values and their Laplacians are whole numbers, so all sums are exact and values are counted, not sorted.
    """
    g = area_resized(x.astype(float), SIDE, SIDE)
    g = np.ascontiguousarray(np.clip(np.rint(g, out=g), 0, 255, out=g).astype(np.uint8))
    counts = np.bincount(g.ravel(), minlength=256)
    values, n = np.arange(256), g.size
    upto = np.cumsum(counts)
    places = np.array([0.01, 0.99]) * (n - 1)
    below, above = (np.searchsorted(upto, np.minimum(np.floor(places) + k, n - 1), "right") for k in (0, 1))
    low, high = below + (above - below) * (places % 1)
    mean = int(counts @ values) / n
    p = np.pad(g.astype(np.int16), 1, mode="reflect")
    laplacian = (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).ravel().astype(float)
    total, squares = int(laplacian.sum()), int(laplacian @ laplacian)
    dark = g < DARK
    rows, columns = np.flatnonzero(dark.any(1)), np.flatnonzero(dark.any(0))
    margin = min(rows[0], columns[0], SIDE - 1 - rows[-1], SIDE - 1 - columns[-1]) / SIDE if len(rows) else np.nan
    return {
        "qr_aspect_ratio": x.shape[1] / x.shape[0], "qr_gray_mean": mean / 255, "qr_gray_std": float(np.sqrt(counts @ (values - mean) ** 2 / n)) / 255, "qr_dark_ratio": int(counts[:DARK].sum()) / n,
        "qr_contrast": (high - low) / 255, "qr_blur_score": (n * squares - total * total) / (n * n), "qr_quiet_zone_ratio": margin,
    }


STATISTICS = ["qr_aspect_ratio", "qr_gray_mean", "qr_gray_std", "qr_dark_ratio", "qr_contrast", "qr_blur_score", "qr_quiet_zone_ratio"]


def with_statistics(images: DataFrame, key: str) -> DataFrame:
    """(key, features) of (key, pixels, height, width)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [statistics(np.frombuffer(p, np.uint8).reshape(h, w)) for p, h, w in zip(b["pixels"], b["height"], b["width"], strict=True)]
            yield pd.DataFrame({key: b[key], **{s: [f[s] for f in found] for s in STATISTICS}})

    return images.select(key, "pixels", "height", "width").mapInPandas(run, f"{key} bigint, " + ", ".join(f"{s} double" for s in STATISTICS))


def distorted(images: DataFrame, key: str, grid: DataFrame, *keep: str) -> DataFrame:
    """Each image under each condition that has a kernel: (key, type, severity, pixels, height, width) and the double columns `keep`."""
    crossed = images.select(key, "pixels", "height", "width", *keep).crossJoin(grid.where(F.col("type").isin(*KERNELS)))  # a fixed grid

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            new = [KERNELS[t](np.frombuffer(p, np.uint8).reshape(h, w), v) for p, h, w, t, v in zip(b["pixels"], b["height"], b["width"], b["type"], b["value"], strict=True)]
            yield pd.DataFrame({key: b[key], "type": b["type"], "severity": b["severity"], "pixels": [x.tobytes() for x in new], "height": [x.shape[0] for x in new], "width": [x.shape[1] for x in new], **{k: b[k] for k in keep}})

    return crossed.mapInPandas(run, ", ".join([f"{key} bigint, type string, severity string, pixels binary, height int, width int", *(f"{k} double" for k in keep)]))


def bright_shares(images: DataFrame, key: str, grid: list[tuple[str, str, float]]) -> DataFrame:
    """(key, type, severity, clean, bright): the share of bright pixels of each image, as it is and under each condition that has a kernel. Pixels stay in their task."""
    some = [c for c in grid if c[0] in KERNELS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, p, h, w in zip(b[key], b["pixels"], b["height"], b["width"], strict=True):
                x = np.frombuffer(p, np.uint8).reshape(h, w)
                clean = np.count_nonzero(x >= DARK) / x.size
                for t, severity, v in some:
                    y = KERNELS[t](x, v)
                    out.append((i, t, severity, clean, np.count_nonzero(y >= DARK) / y.size))
            yield pd.DataFrame(out, columns=[key, "type", "severity", "clean", "bright"])

    return images.select(key, "pixels", "height", "width").mapInPandas(run, f"{key} bigint, type string, severity string, clean double, bright double")


def patterned(rows: DataFrame, key: str, text: str, modules: int = 25, scale: int = 4) -> DataFrame:
    """A module grid drawn from the md5 of a text, with a white border: images for which no encoder is needed.

    A row of text becomes thousands of bytes, so rows are dealt to all tasks before they are drawn.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = F.repeat(F.conv(F.substring(F.md5(text), 1, 12), 16, 2), 64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            images = []
            for s in b["bits"]:
                grid = np.frombuffer(s[: modules * modules].ljust(modules * modules, "0").encode(), np.uint8).reshape(modules, modules)
                x = np.where(grid == ord("1"), 0, 255).astype(np.uint8)
                images.append(np.kron(np.pad(x, 4, constant_values=255), np.ones((scale, scale), np.uint8)))
            yield pd.DataFrame({key: b[key], "pixels": [x.tobytes() for x in images], "height": [x.shape[0] for x in images], "width": [x.shape[1] for x in images]})

    return rows.select(key, bits.alias("bits")).repartition(parts, key).mapInPandas(run, f"{key} bigint, pixels binary, height int, width int")
