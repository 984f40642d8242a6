"""Kernels over whole images in numpy, applied in Arrow batches; Spark deals out the images.

What has a relational form (histograms, co-occurrence, projections) is in ``pixels``; here are the forms that need an
image at once: components, morphology, filling, hulls, moments, local patterns, resizing, augmentation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply(df: DataFrame, key: str, array: str, width: int, kernel: Callable[[np.ndarray], tuple], schema: str) -> DataFrame:
    """One row an image: the key and what a kernel makes of it. Images that aren't whole rows of ``width`` give nulls."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for values in batch["a"]:
                ok = values is not None and len(values) and len(values) % width == 0
                rows.append(kernel(np.asarray(values, float).reshape(-1, width)) if ok else (None,) * len(names))
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, key, batch["k"].to_numpy())
            yield out

    return df.select(F.col(key).alias("k"), F.col(array).alias("a")).mapInPandas(run, f"{key} long, {schema}")


def dilated(mask: np.ndarray, reach: int = 1) -> np.ndarray:
    p = np.pad(mask, reach)
    h, w = mask.shape
    out = np.zeros_like(mask)
    for dy in range(2 * reach + 1):
        for dx in range(2 * reach + 1):
            out |= p[dy : dy + h, dx : dx + w]
    return out


def eroded(mask: np.ndarray, reach: int = 1) -> np.ndarray:
    return ~dilated(~mask, reach)


def closed(mask: np.ndarray, reach: int = 1) -> np.ndarray:
    return eroded(dilated(mask, reach), reach)


def opened(mask: np.ndarray, reach: int = 1) -> np.ndarray:
    return dilated(eroded(mask, reach), reach)


def grown(seed: np.ndarray, allowed: np.ndarray, turns: int | None = None) -> np.ndarray:
    """A seed spread over the allowed pixels that it touches, until it stops or for so many turns."""
    now = seed & allowed
    while turns is None or turns > 0:
        more = dilated(now) & allowed
        if (more == now).all():
            break
        now, turns = more, None if turns is None else turns - 1
    return now


def labelled(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components, numbered from 1 in the order of their first pixels: every pixel takes the least place around
    it until nothing changes, with jumps to the place's own."""
    h, w = mask.shape
    far = h * w
    place = np.where(mask, np.arange(far).reshape(h, w), far)
    while True:
        p = np.pad(place, 1, constant_values=far)
        least = place
        for dy in range(3):
            for dx in range(3):
                least = np.minimum(least, p[dy : dy + h, dx : dx + w])
        least = np.where(mask, least, far)
        flat = np.append(least.ravel(), far)
        least = flat[least]
        if (least == place).all():
            break
        place = least
    names, out = np.unique(place, return_inverse=True)
    out = out.reshape(h, w) + 1
    out[~mask] = 0
    return out, int((names < far).sum())


def without_small(mask: np.ndarray, least: int) -> np.ndarray:
    labels, _ = labelled(mask)
    sizes = np.bincount(labels.ravel())
    return mask & (sizes[labels] >= least)


def largest(mask: np.ndarray) -> np.ndarray:
    labels, n = labelled(mask)
    return labels == (np.bincount(labels.ravel())[1:].argmax() + 1) if n else mask


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask with its holes: background that doesn't reach the border (by its sides, not its corners)."""
    free = ~np.pad(mask, 1)
    out = np.zeros_like(free)
    out[0, 0] = True
    while True:
        more = out.copy()
        more[1:] |= out[:-1]
        more[:-1] |= out[1:]
        more[:, 1:] |= out[:, :-1]
        more[:, :-1] |= out[:, 1:]
        more &= free
        if (more == out).all():
            return ~out[1:-1, 1:-1]
        out = more


def component_stats(image: np.ndarray) -> tuple:
    labels, n = labelled(image > 0)
    sizes = np.bincount(labels.ravel())[1:]
    return n, int(sizes.max()) if n else 0, float(sizes.mean()) if n else 0.0


def hull_area(points: np.ndarray) -> float:
    """The area of the convex hull of points (x, y)."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return 0.0

    def half(rows):
        chain: list = []
        for x, y in rows:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (y - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (x - chain[-2][0]):
                chain.pop()
            chain.append((x, y))
        return chain[:-1]

    ring = np.array(half(p.tolist()) + half(p[::-1].tolist()), float)
    x, y = ring[:, 0], ring[:, 1]
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)


def invariants(mask: np.ndarray) -> list[float]:
    """The seven moment invariants of a mask."""
    y, x = np.nonzero(mask)
    if not len(x):
        return [0.0] * 7
    x, y, n = x - x.mean(), y - y.mean(), float(len(x))
    e = {(p, q): float((x**p * y**q).sum()) / n ** (1 + (p + q) / 2) for p in range(4) for q in range(4) if 2 <= p + q <= 3}
    a, b, c, d = e[3, 0] + e[1, 2], e[2, 1] + e[0, 3], e[3, 0] - 3 * e[1, 2], 3 * e[2, 1] - e[0, 3]
    s, t = e[2, 0] + e[0, 2], e[2, 0] - e[0, 2]
    u, v = a * a - 3 * b * b, 3 * a * a - b * b
    return [s, t * t + 4 * e[1, 1] ** 2, c * c + d * d, a * a + b * b, c * a * u + d * b * v, t * (a * a - b * b) + 4 * e[1, 1] * a * b, d * a * u - c * b * v]


SHAPE = "area long, perimeter long, holes long, extent double, solidity double, aspect double, hu array<double>"


def shape_stats(image: np.ndarray) -> tuple:
    """Measures of the largest component: corners of pixels give the hull, pixels with background at a side the perimeter."""
    mask = largest(image > 0)
    area = int(mask.sum())
    if not area:
        return 0, 0, 0, 0.0, 0.0, 0.0, [0.0] * 7
    y, x = np.nonzero(mask)
    p = np.pad(mask, 1)
    inner = p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    h, w = int(np.ptp(y)) + 1, int(np.ptp(x)) + 1
    corners = np.concatenate([np.stack([x + i, y + j], 1) for i in (0, 1) for j in (0, 1)])
    return area, int((mask & ~inner).sum()), int((filled(mask) & ~mask).sum()), area / (h * w), area / hull_area(corners), w / h, invariants(mask)


def lbp_stats(image: np.ndarray) -> tuple:
    """Ten shares: of pixels with a uniform pattern by their bright neighbours (0 to 8), and of all others; and their entropy."""
    h, w = image.shape
    if h < 3 or w < 3:
        return [0.0] * 10, 0.0
    centre = image[1:-1, 1:-1]
    ring = [(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0)]
    bits = np.stack([image[dy : dy + h - 2, dx : dx + w - 2] >= centre for dy, dx in ring])
    turns = (bits != np.roll(bits, 1, axis=0)).sum(axis=0)
    code = np.where(turns <= 2, bits.sum(axis=0), 9)
    share = np.bincount(code.ravel(), minlength=10) / code.size
    seen = share[share > 0]
    return share.tolist(), float(-(seen * np.log2(seen)).sum())


def letterboxed(image: np.ndarray, size: int, fill: float = 255.0) -> tuple[np.ndarray, float, int, int]:
    """The longest side scaled to ``size``, centred on a square; scale, top and left are returned for the way back.

    Shrinking averages the pixels below each new one, growing interpolates.
    """
    h, w = image.shape[:2]
    scale = size / max(h, w)
    new_h, new_w = max(1, round(h * scale)), max(1, round(w * scale))
    small = _resample(_resample(image.astype(float), new_h, 0), new_w, 1)
    out = np.full((size, size, *image.shape[2:]), fill)
    top, left = (size - new_h) // 2, (size - new_w) // 2
    out[top : top + new_h, left : left + new_w] = small
    return out, scale, top, left


def _resample(a: np.ndarray, n: int, axis: int) -> np.ndarray:
    old = a.shape[axis]
    if n == old:
        return a
    weights = np.zeros((n, old))
    if n < old:
        edges = np.linspace(0, old, n + 1)
        for i in range(n):
            lo, hi = edges[i], edges[i + 1]
            for j in range(int(lo), min(old, int(np.ceil(hi)))):
                weights[i, j] = min(hi, j + 1) - max(lo, j)
    else:
        at = np.clip((np.arange(n) + 0.5) * old / n - 0.5, 0, old - 1)
        j = np.minimum(at.astype(int), old - 2) if old > 1 else np.zeros(n, int)
        part = at - j
        weights[np.arange(n), j] += 1 - part
        weights[np.arange(n), np.minimum(j + 1, old - 1)] += part
    weights /= weights.sum(axis=1, keepdims=True)
    return np.moveaxis(np.tensordot(weights, a, (1, axis)), 0, axis)


def augmented(df: DataFrame, key: str, array: str, width: int, variants: int = 6) -> DataFrame:
    """(key, variant, flipped, turned, gain, image): variant 0 is the image, the others are seeded by key and number."""
    numbered = df.select(key, F.col(array).cast("array<double>").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(variants))).alias("variant"))
    seeded = numbered.withColumn("_seed", F.xxhash64(F.col(key), F.col("variant")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, values, variant, seed in zip(b[key], b["image"], b["variant"], b["_seed"]):
                image = np.asarray(values, float).reshape(-1, width)
                flipped, turned, gain = False, 0, 1.0
                if variant:
                    rng = np.random.default_rng(int(seed) & (2**63 - 1))
                    flipped, turned, gain = bool(rng.random() < 0.5), int(rng.integers(0, 4)), float(rng.uniform(0.8, 1.2))
                    image = np.rot90(image[:, ::-1] if flipped else image, turned) * gain
                rows.append((k, variant, flipped, turned, gain, image.ravel().tolist()))
            yield pd.DataFrame(rows, columns=[key, "variant", "flipped", "turned", "gain", "image"])

    return seeded.mapInPandas(run, f"{key} long, variant int, flipped boolean, turned int, gain double, image array<double>")


def gradients(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size and direction (0 to 180 degrees) of the central differences; edges repeat."""
    p = np.pad(image.astype(float), 1, mode="edge")
    gx, gy = p[1:-1, 2:] - p[1:-1, :-2], p[2:, 1:-1] - p[:-2, 1:-1]
    return np.hypot(gx, gy), np.degrees(np.arctan2(gy, gx)) % 180


def gradient_stats(image: np.ndarray) -> tuple:
    """Nine shares of gradient size by direction, their mean, deviation and entropy, and the Laplacian's variance."""
    size, angle = gradients(image)
    total = size.sum()
    hist = np.bincount(np.minimum((angle / 20).astype(int), 8).ravel(), size.ravel(), 9)
    share = hist / total if total > 0 else np.zeros(9)
    p = np.pad(image.astype(float), 1, mode="edge")
    curve = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * image
    seen = share[share > 0]
    return share.tolist(), float(size.mean()), float(size.std()), float(-(seen * np.log2(seen)).sum()), float(curve.var())


def gabor_bank(image: np.ndarray, waves: tuple[float, ...] = (3.0, 5.0), turns: int = 4, reach: int = 3, spread: float = 1.5) -> tuple:
    """Mean and deviation of the response to each wave length and direction, in order."""
    y, x = np.mgrid[-reach : reach + 1, -reach : reach + 1]
    p = np.pad(image.astype(float), reach, mode="reflect" if min(image.shape) > reach else "edge")
    h, w = image.shape
    out: list[float] = []
    for wave in waves:
        for k in range(turns):
            t = np.pi * k / turns
            kernel = np.exp(-(x**2 + y**2) / (2 * spread**2)) * np.cos(2 * np.pi * (x * np.cos(t) + y * np.sin(t)) / wave)
            kernel -= kernel.mean()
            answer = sum(kernel[i, j] * p[i : i + h, j : j + w] for i in range(2 * reach + 1) for j in range(2 * reach + 1))
            out += [float(answer.mean()), float(answer.std())]
    return (out,)


def thinned(mask: np.ndarray) -> np.ndarray:
    """A one-pixel-wide skeleton: border pixels whose removal keeps the neighbourhood in one piece are taken off, from two
    sides in turn, until none is left."""
    now = mask.copy()
    ring = [(0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0), (0, 0)]  # north first, clockwise, in a padded window
    while True:
        changed = False
        for side in (0, 1):
            p = np.pad(now, 1)
            n = np.stack([p[dy : dy + now.shape[0], dx : dx + now.shape[1]] for dy, dx in ring])
            count = n.sum(axis=0)
            rises = (~n & np.roll(n, -1, axis=0)).sum(axis=0)
            north, east, south, west = n[0], n[2], n[4], n[6]
            open_side = ~(north & east & south) & ~(east & south & west) if side == 0 else ~(north & east & west) & ~(north & south & west)
            corner = east & n[3] & south & (count == 3)  # of a lone square of four pixels one stays
            gone = now & (count >= 2) & (count <= 6) & (rises == 1) & open_side & ~corner
            if gone.any():
                now, changed = now & ~gone, True
        if not changed:
            return now


def skeleton_stats(image: np.ndarray) -> tuple:
    """Length, ends, branch points and density of the skeleton of the largest component."""
    mask = largest(image > 0)
    line = thinned(mask)
    p = np.pad(line.astype(int), 1)
    h, w = line.shape
    around = sum(p[i : i + h, j : j + w] for i in range(3) for j in range(3)) - line
    n = int(line.sum())
    return n, int((line & (around == 1)).sum()), int((line & (around >= 3)).sum()), n / max(1, int(mask.sum()))


def equalised(image: np.ndarray, tiles: int = 2, levels: int = 64, limit: float = 2.5) -> np.ndarray:
    """Local contrast: each tile's clipped cumulative histogram maps its levels, and pixels blend the four nearest tiles."""
    h, w = image.shape
    low, high = float(image.min()), float(image.max())
    level = np.minimum(((image - low) / max(high - low, 1e-12) * levels).astype(int), levels - 1)
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    maps = np.zeros((tiles, tiles, levels))
    for i in range(tiles):
        for j in range(tiles):
            part = level[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            hist = np.bincount(part.ravel(), minlength=levels).astype(float)
            top = max(1.0, limit * max(1, part.size) / levels)
            spare = np.maximum(hist - top, 0).sum()
            hist = np.minimum(hist, top) + spare / levels
            maps[i, j] = hist.cumsum() / hist.sum()
    fy = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1)
    fx = np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    a, b = (fy - y0)[:, None], (fx - x0)[None, :]
    at = lambda i, j: maps[i[:, None], j[None, :], level]
    return (1 - a) * ((1 - b) * at(y0, x0) + b * at(y0, x1)) + a * ((1 - b) * at(y1, x0) + b * at(y1, x1))


def equalised_stats(image: np.ndarray) -> tuple:
    out = equalised(image)
    return float(out.mean()), float(out.std())
