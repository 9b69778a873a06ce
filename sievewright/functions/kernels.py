"""Numeric kernels over image arrays in NumPy, and pandas functions that apply them to array columns.

Images are float arrays of height x width (gray) or height x width x 3 in [0, 1].
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Luma weights; order of the quality features.
LUMA = (0.2989, 0.5870, 0.1140)
QUALITY_FEATURES = ("gradient_energy", "laplacian_energy", "blockiness", "residual_noise", "resolution_proxy", "dynamic_range")


def gray(image: np.ndarray) -> np.ndarray:
    image = np.clip(np.asarray(image, np.float64), 0.0, 1.0)
    return image if image.ndim == 2 else image @ np.array(LUMA)


def dct_matrix(n: int) -> np.ndarray:
    """Orthonormal DCT-II."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.where(k == 0, math.sqrt(1 / n), math.sqrt(2 / n)) * np.cos(np.pi * (2 * x + 1) * k / (2 * n))


def _resampled(image: np.ndarray, height: int, width: int, kernel: Callable[[np.ndarray], np.ndarray], reach: float) -> np.ndarray:
    """Separable resampling of a plane with a kernel of that reach, widened when shrinking."""

    def weights(n_in: int, n_out: int) -> np.ndarray:
        scale = n_in / n_out
        wide = max(1.0, scale)
        centre = (np.arange(n_out) + 0.5) * scale
        d = (np.arange(n_in)[None, :] + 0.5 - centre[:, None]) / wide
        w = np.where(np.abs(d) < reach, kernel(d), 0.0)
        return w / w.sum(1, keepdims=True)

    return weights(image.shape[0], height) @ image @ weights(image.shape[1], width).T


def lanczos_resize(image: np.ndarray, height: int, width: int, a: int = 3) -> np.ndarray:
    return _resampled(image, height, width, lambda d: np.sinc(d) * np.sinc(d / a), a)


def _cubic(d: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(d)
    return np.where(x < 1, ((a + 2) * x - (a + 3)) * x * x + 1, a * (((x - 5) * x + 8) * x - 4))


def cubic_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    return _resampled(image, height, width, _cubic, 2)


def linear_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    return _resampled(image, height, width, lambda d: 1 - np.abs(d), 1)


def by_plane(image: np.ndarray, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """work on each plane of an image, clipped to [0, 1]."""
    image = np.asarray(image, float)
    return np.clip(work(image) if image.ndim == 2 else np.stack([work(image[..., c]) for c in range(image.shape[2])], -1), 0, 1)


def perceptual_hash(image: np.ndarray, size: int = 8, factor: int = 4) -> int:
    """64 bits, row by row, highest first: is a low-frequency coefficient over the median of all but the first."""
    m = dct_matrix(size * factor)
    low = (m @ lanczos_resize(gray(image) * 255, size * factor, size * factor) @ m.T)[:size, :size].ravel()
    return int("".join("1" if b else "0" for b in low > np.median(low[1:])), 2)


def quality_features(image: np.ndarray) -> np.ndarray:
    """Six statistics of an image's quality, all as log1p; images of at least 2 x 2."""
    g = gray(image)
    dx, dy = np.abs(np.diff(g, axis=1)), np.abs(np.diff(g, axis=0))
    gradient = (dx.mean() + dy.mean()) / 2
    p = np.pad(g, 1, mode="reflect")
    laplacian = np.abs(p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g).mean()
    edges = [d.mean() if d.size else 0.0 for d in (dx[:, 7::8], dy[7::8, :])]
    local = sum(p[i : i + g.shape[0], j : j + g.shape[1]] for i in range(3) for j in range(3)) / 9
    floor = max(gradient, 1e-6)
    return np.log1p([100 * gradient, 100 * laplacian, sum(edges) / 2 / floor, 100 * np.abs(g - local).mean(), laplacian / floor, 10 * g.std()])


def patch_ratios(image: np.ndarray, patch: int = 8, low: int = 4) -> np.ndarray:
    """For each non-overlapping patch the share of its DCT energy outside the low corner."""
    g = gray(image)
    h, w = g.shape[0] // patch * patch, g.shape[1] // patch * patch
    blocks = g[:h, :w].reshape(h // patch, patch, w // patch, patch).swapaxes(1, 2).reshape(-1, patch, patch)
    m = dct_matrix(patch)
    energy = (m @ blocks @ m.T) ** 2
    i, j = np.indices((patch, patch))
    total = energy.sum((1, 2))
    return np.where(total > 1e-12, (energy * (i + j >= low)).sum((1, 2)) / np.maximum(total, 1e-12), 0.0)


def extreme_patches(image: np.ndarray, k: int, patch: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the k patches with the lowest and the k with the highest share; ties by number."""
    order = np.argsort(patch_ratios(image, patch), kind="stable")
    return order[:k], order[::-1][:k]


def nearest_pixel_residual(image: np.ndarray, factor: int = 2) -> np.ndarray:
    """Image minus its nearest-pixel down- and up-sampling."""
    g = gray(image)
    small = g[::factor, ::factor]
    return g - np.repeat(np.repeat(small, factor, 0), factor, 1)[: g.shape[0], : g.shape[1]]


# One-dimensional kernels, impulse and smoothing first, then differences of rising order; 3 x 3 residual kernels.
LINES = ((0, 0, 1, 0, 0), (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16), (0, -1, 0, 1, 0), (0, 1, -2, 1, 0), (-1, 2, 0, -2, 1), (1, -4, 6, -4, 1))
SMALL_FILTERS = (
    ((0, -1, 0), (-1, 4, -1), (0, -1, 0)),
    ((-1, -1, -1), (-1, 8, -1), (-1, -1, -1)),
    ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1)),
    ((-1, -2, -1), (0, 0, 0), (1, 2, 1)),
    ((1, -2, 1), (-2, 4, -2), (1, -2, 1)),
    ((-1, 2, -1), (2, -4, 2), (-1, 2, -1)),
    ((0, 1, 0), (1, -4, 1), (0, 1, 0)),
    ((1, 0, -1), (0, 0, 0), (-1, 0, 1)),
)


def _balanced(bank: np.ndarray) -> np.ndarray:
    """Zero mean, and absolute values that sum to one."""
    bank = bank - bank.mean((1, 2), keepdims=True)
    return bank / np.abs(bank).sum((1, 2), keepdims=True)


def residual_filters(count: int = 30) -> np.ndarray:
    """The first `count` outer products of two of LINES, row by row, without those of the first two alone."""
    lines = np.array(LINES, float)
    down, across = np.nonzero(np.maximum.outer(np.arange(len(lines)), np.arange(len(lines))) >= 2)
    return _balanced(lines[down[:count], :, None] * lines[across[:count], None, :])


def small_filters() -> np.ndarray:
    return _balanced(np.array(SMALL_FILTERS, float))


def heat_map(values: np.ndarray) -> np.ndarray:
    """Clipped to the 1 and 99 percent quantiles and stretched to [0, 1]."""
    low, high = np.quantile(values, [0.01, 0.99])
    return np.clip((values - low) / max(high - low, 1e-12), 0, 1)


def softmax_gate(features: np.ndarray, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    """Layer norm, two dense layers with a ramp between, softmax: a gate's two fractions from supplied weights."""
    x = (features - features.mean(-1, keepdims=True)) / np.sqrt(features.var(-1, keepdims=True) + eps)
    z = np.maximum(x @ w1 + b1, 0) @ w2 + b2
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def gate_modes(gates: np.ndarray, clean_mean: np.ndarray, order: np.ndarray) -> dict[str, np.ndarray]:
    """The four ways to weigh two branches: as learned, equal, the mean over clean rows, those of other rows."""
    return {"learned": gates, "equal": np.full_like(gates, 0.5), "clean_mean": np.broadcast_to(clean_mean, gates.shape).copy(), "shuffled": gates[order]}


# Transforms of an image array; each keeps its size.


def gaussian_blur(image: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, math.ceil(3 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    out = np.asarray(image, float)
    for axis in (0, 1):
        pad = [(0, 0)] * out.ndim
        pad[axis] = (r, r)
        p = np.pad(out, pad, mode="edge")
        out = sum(w * np.take(p, np.arange(i, i + out.shape[axis]), axis) for i, w in enumerate(k))
    return out


def gaussian_noise(image: np.ndarray, sigma: float, seed: int) -> np.ndarray:
    return np.clip(image + np.random.default_rng(seed).normal(0, sigma, np.shape(image)), 0, 1)


RESIZES = {"bilinear": linear_resize, "bicubic": cubic_resize, "lanczos": lanczos_resize}


def resize_round_trip(image: np.ndarray, scale: float, interpolation: str = "bicubic") -> np.ndarray:
    h, w = np.shape(image)[:2]
    small, resize = (max(1, round(h * scale)), max(1, round(w * scale))), RESIZES[interpolation]
    return by_plane(image, lambda plane: resize(resize(plane, *small), h, w))


def color_jitter(image: np.ndarray, brightness: float = 1.0, contrast: float = 1.0, saturation: float = 1.0) -> np.ndarray:
    out = np.clip(np.asarray(image, float) * brightness, 0, 1)
    out = np.clip((out - gray(out).mean()) * contrast + gray(out).mean(), 0, 1)
    return out if out.ndim == 2 else np.clip(gray(out)[..., None] + (out - gray(out)[..., None]) * saturation, 0, 1)


def center_crop(image: np.ndarray, ratio: float) -> np.ndarray:
    """The middle part, brought back to the whole size."""
    h, w = np.shape(image)[:2]
    ch, cw = max(1, round(h * ratio)), max(1, round(w * ratio))
    top, left = round((h - ch) / 2), round((w - cw) / 2)
    return by_plane(image, lambda plane: cubic_resize(plane[top : top + ch, left : left + cw], h, w))


# The standard's example tables of quantisation, for brightness and for colour; YCbCr of RGB.
BRIGHT_STEPS = (
    (16, 11, 10, 16, 24, 40, 51, 61),
    (12, 12, 14, 19, 26, 58, 60, 55),
    (14, 13, 16, 24, 40, 57, 69, 56),
    (14, 17, 22, 29, 51, 87, 80, 62),
    (18, 22, 37, 56, 68, 109, 103, 77),
    (24, 35, 55, 64, 81, 104, 113, 92),
    (49, 64, 78, 87, 103, 121, 120, 101),
    (72, 92, 95, 98, 112, 100, 103, 99),
)
COLOUR_STEPS = ((17, 18, 24, 47), (18, 21, 26, 66), (24, 26, 56, 99), (47, 66, 99, 99))
YCBCR = ((0.299, 0.587, 0.114), (-0.168736, -0.331264, 0.5), (0.5, -0.418688, -0.081312))


def quantisation(quality: int, colour: bool) -> np.ndarray:
    """The 8 x 8 steps of a quality from 1 to 100; colour steps outside their table are 99."""
    if not 1 <= quality <= 100:
        raise ValueError(f"a JPEG quality is from 1 to 100, not {quality}")
    base = np.full((8, 8), 99)
    if colour:
        base[:4, :4] = COLOUR_STEPS
    else:
        base[:] = BRIGHT_STEPS
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((base * scale + 50) // 100, 1, 255)


def _coded(plane: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """A plane of bytes after its blocks' coefficients were rounded to the steps. What a file holds are these whole numbers, coded without loss."""
    h, w = plane.shape
    padded = np.pad(plane - 128.0, ((0, -h % 8), (0, -w % 8)), mode="edge")
    m = dct_matrix(8)
    blocks = padded.reshape(padded.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)
    back = m.T @ (np.round(m @ blocks @ m.T / steps) * steps) @ m
    return np.clip(np.round(back.swapaxes(1, 2).reshape(padded.shape)[:h, :w] + 128), 0, 255)


def jpeg_round_trip(image: np.ndarray, quality: int, subsampling: int = 2) -> np.ndarray:
    """What baseline JPEG makes of an image: bytes of brightness and colour, colour planes at half the width (subsampling 1) or half of both sides (2), rounded DCT coefficients, and back."""
    if subsampling not in (0, 1, 2):
        raise ValueError(f"subsampling is 0, 1 or 2, not {subsampling}")
    image = np.round(np.clip(np.asarray(image, float), 0, 1) * 255)
    if image.ndim == 2:
        return _coded(image, quantisation(quality, False)) / 255
    h, w = image.shape[:2]
    planes = np.round(image @ np.array(YCBCR).T + (0, 128, 128))
    down, across = (2 if subsampling == 2 else 1), (2 if subsampling else 1)
    out = [_coded(planes[..., 0], quantisation(quality, False))]
    for c in (1, 2):
        wide = np.pad(planes[..., c], ((0, -h % down), (0, -w % across)), mode="edge")
        small = np.round(wide.reshape(wide.shape[0] // down, down, wide.shape[1] // across, across).mean((1, 3)))
        out.append(np.repeat(np.repeat(_coded(small, quantisation(quality, True)), down, 0), across, 1)[:h, :w])
    rgb = (np.stack(out, -1) - (0, 128, 128)) @ np.linalg.inv(np.array(YCBCR)).T
    return np.clip(np.round(rgb), 0, 255) / 255


def harmonised(image: np.ndarray, size: int, quality: int = 90, subsampling: int = 2) -> np.ndarray:
    """An image of any source through the same pixels: a square of that size, then a JPEG round trip, which covers the traces of the codec it came from."""
    if size <= 0:
        raise ValueError(f"a size is positive, not {size}")
    return jpeg_round_trip(by_plane(image, lambda plane: cubic_resize(plane, size, size)), quality, subsampling)


def training_quality(seed: int, row: int, qualities: tuple[int, ...] = (70, 80, 90, 95)) -> int:
    """A row's JPEG quality for training, by its number alone, so never by its label."""
    if not qualities or not all(1 <= q <= 100 for q in qualities):
        raise ValueError(f"qualities are from 1 to 100, and there is one at least, not {qualities}")
    return qualities[int.from_bytes(hashlib.sha256(f"quality:{seed}:{row}".encode()).digest()[:8], "little") % len(qualities)]


# Ranges of the six transforms' strengths in training, and of those that a user may set, in the order in which they are applied.
SIX_PROFILE = "full_training_range_v1"
SIX_RANGES = {"ratio": (0.75, 0.95), "scale": (0.25, 0.75), "brightness": (0.8, 1.2), "contrast": (0.8, 1.2), "saturation": (0.8, 1.2), "blur": (0.1, 2.5), "noise": (0.005, 0.10), "quality": (30, 95)}
CHAIN_SEED = 20260827
CHAIN_RANGES = {
    "center_crop": {"ratio": (0.75, 1.0)},
    "resize": {"scale": (0.25, 1.0)},
    "color_jitter": {"brightness": (0.8, 1.2), "contrast": (0.8, 1.2), "saturation": (0.8, 1.2)},
    "gaussian_blur": {"sigma": (0.0, 2.5)},
    "gaussian_noise": {"sigma": (0.0, 0.10)},
    "jpeg": {"quality": (30, 100)},
}


def random_six(seed: int, profile: str = SIX_PROFILE) -> list[dict]:
    """All six transforms, each with a strength drawn from its range by the seed alone, in a fixed order."""
    if profile != SIX_PROFILE:
        raise ValueError(f"there are no ranges of the name {profile!r}; {SIX_PROFILE!r} has some")
    rng = np.random.default_rng(seed)
    x = {k: float(rng.uniform(*r)) for k, r in SIX_RANGES.items()}
    return [
        {"name": "center_crop", "params": {"ratio": x["ratio"]}},
        {"name": "resize", "params": {"scale": x["scale"], "interpolation": ("bilinear", "bicubic")[int(rng.integers(2))]}},
        {"name": "color_jitter", "params": {k: x[k] for k in ("brightness", "contrast", "saturation")}},
        {"name": "gaussian_blur", "params": {"sigma": x["blur"]}},
        {"name": "gaussian_noise", "params": {"sigma": x["noise"], "seed": int(rng.integers(1 << 31))}},
        {"name": "jpeg", "params": {"quality": round(x["quality"])}},
    ]


def chain(controls: dict[str, dict]) -> list[dict]:
    """The steps of a chain that a user puts together: of the transforms in controls, in the fixed order, with values checked against their ranges."""
    unknown = controls.keys() - CHAIN_RANGES.keys()
    if unknown:
        raise ValueError(f"unknown transforms: {sorted(unknown)}")
    steps = []
    for name, ranges in CHAIN_RANGES.items():
        if name in controls:
            params = dict(controls[name])
            for key, value in params.items():
                if key not in ranges or not ranges[key][0] <= value <= ranges[key][1]:
                    raise ValueError(f"{name}: {key} = {value} is not in {ranges.get(key)}")
            steps.append({"name": name, "params": params | ({"seed": CHAIN_SEED} if name == "gaussian_noise" else {})})
    return steps


def _unchanged(image: np.ndarray) -> np.ndarray:
    return np.asarray(image, float)


def _blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    return gaussian_blur(image, sigma) if sigma > 0 else _unchanged(image)


def _cropped(image: np.ndarray, ratio: float | None = None, fraction: float | None = None) -> np.ndarray:
    if (ratio is None) == (fraction is None):
        raise ValueError("a crop takes a ratio or a fraction")
    return center_crop(image, fraction if ratio is None else ratio)


#: What each transform calls, and the kinds of its parameters; `seed` grows by the row's number.
TRANSFORMS: dict[str, tuple[Callable[..., np.ndarray], dict[str, Callable]]] = {
    "clean": (_unchanged, {}),
    "center_crop": (_cropped, {"ratio": float, "fraction": float}),
    "resize": (resize_round_trip, {"scale": float, "interpolation": str}),
    "color_jitter": (color_jitter, {"brightness": float, "contrast": float, "saturation": float}),
    "gaussian_blur": (_blurred, {"sigma": float}),
    "gaussian_noise": (gaussian_noise, {"sigma": float, "seed": int}),
    "jpeg": (jpeg_round_trip, {"quality": int, "subsampling": int}),
    "harmonise": (harmonised, {"size": int, "quality": int, "subsampling": int}),
}


def steps_of(name: str, params: dict, row: int = 0) -> list[tuple[str, dict]]:
    """The plain transforms that a condition stands for, with checked parameters. A composite is its parts in turn; the random six draw theirs from their seed and the row's number."""
    if name == "strict_random_six":
        drawn = random_six(int(params.get("seed", 0)) + row, params.get("profile", SIX_PROFILE))
        return [step for part in drawn for step in steps_of(part["name"], part["params"])]
    if "transforms" in params:
        return [step for part in params["transforms"] for step in steps_of(part["name"], part.get("params", {}), row)]
    if name not in TRANSFORMS:
        raise ValueError(f"unknown transform {name}")
    kinds = TRANSFORMS[name][1]
    if unknown := params.keys() - kinds.keys():
        raise ValueError(f"{name} has no parameters {sorted(unknown)}")
    checked = {k: kinds[k](v) for k, v in params.items()}
    return [(name, checked | ({"seed": checked.get("seed", 0) + row} if "seed" in kinds else {}))]


def apply_transform(image: np.ndarray, name: str, params: dict, row: int = 0) -> np.ndarray:
    """A condition's transform by name (TRANSFORMS, strict_random_six, or a composite with a list of `transforms`)."""
    for step, checked in steps_of(name, params, row):
        image = TRANSFORMS[step][0](image, **checked)
    return image


def augmentation_policy(seed: int, row: int, names: tuple[str, ...]) -> list[str]:
    """No, one or two transforms with chances 1/4, 1/2, 1/4, chosen by the row's number alone, so never by its label."""
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{row}".encode()).digest()[:8], "little"))
    n = min(int(rng.choice(3, p=[0.25, 0.5, 0.25])), len(names))
    return [names[i] for i in rng.choice(len(names), n, replace=False)]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def quality_features_udf(pixels: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([quality_features(np.asarray(p, float).reshape(-1, int(w))).tolist() for p, w in zip(pixels, width, strict=True)])


@F.pandas_udf(T.StringType())
def perceptual_hash_udf(pixels: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([f"{perceptual_hash(np.asarray(p, float).reshape(-1, int(w))):016x}" for p, w in zip(pixels, width, strict=True)])
