"""Numpy kernels on one image: labels, skeletons, regions, medians, lines, wavelets, a TIFF reader. No Spark here."""

from __future__ import annotations

import functools
import math
import struct

import numpy as np

_EIGHT = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def label(mask: np.ndarray) -> np.ndarray:
    """8-connected labels from 1, in scan order of their first pixels; 0 outside."""
    h, w = mask.shape
    ids = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    while True:
        wide = np.pad(ids, 1, constant_values=h * w)
        low = np.minimum.reduce([wide[1 + a : 1 + a + h, 1 + b : 1 + b + w] for a, b in [*_EIGHT, (0, 0)]])
        low = np.where(mask, low, h * w)
        # Jump along: a pixel's smallest neighbour knows a smaller one already.
        flat = np.append(low.ravel(), h * w)
        low = flat[low]
        if (low == ids).all():
            break
        ids = low
    values = np.unique(ids[mask])
    return np.where(mask, np.searchsorted(values, ids) + 1, 0)


def skeleton(mask: np.ndarray) -> np.ndarray:
    """Thinning to lines of one pixel by two-pass deletion of border pixels (Zhang and Suen)."""
    img = np.pad(mask.astype(np.uint8), 1)
    while True:
        changed = False
        for turn in (0, 1):
            p = [img[:-2, 1:-1], img[:-2, 2:], img[1:-1, 2:], img[2:, 2:], img[2:, 1:-1], img[2:, :-2], img[1:-1, :-2], img[:-2, :-2]]
            count = sum(x.astype(int) for x in p)
            rises = sum(((p[i] == 0) & (p[(i + 1) % 8] == 1)).astype(int) for i in range(8))
            a, b = (p[0] * p[2] * p[4], p[2] * p[4] * p[6]) if not turn else (p[0] * p[2] * p[6], p[0] * p[4] * p[6])
            gone = (img[1:-1, 1:-1] == 1) & (count >= 2) & (count <= 6) & (rises == 1) & (a == 0) & (b == 0)
            if gone.any():
                img[1:-1, 1:-1][gone] = 0
                changed = True
        if not changed:
            return img[1:-1, 1:-1].astype(bool)


def skeleton_ends(skel: np.ndarray) -> np.ndarray:
    """Pixels of the skeleton with exactly one neighbour in it: rows of (y, x)."""
    wide = np.pad(skel.astype(int), 1)
    h, w = skel.shape
    around = sum(wide[1 + a : 1 + a + h, 1 + b : 1 + b + w] for a, b in _EIGHT)
    return np.argwhere(skel & (around == 1))


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of rows of (y, x), counter-clockwise."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts, dtype=float)

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]), dtype=float)


def regions(labels: np.ndarray, intensity: np.ndarray | None = None) -> list[dict]:
    """Area, bounds, centroid, orientation, perimeter, convex area, largest Feret diameter and mean intensity of each label."""
    out = []
    for k in range(1, int(labels.max(initial=0)) + 1):
        yx = np.argwhere(labels == k)
        if not len(yx):
            continue
        (y0, x0), (y1, x1) = yx.min(axis=0), yx.max(axis=0) + 1
        c = yx.mean(axis=0)
        d = yx - c
        a, b, e = (d[:, 0] ** 2).mean() + 1 / 12, (d[:, 0] * d[:, 1]).mean(), (d[:, 1] ** 2).mean() + 1 / 12
        angle = 0.5 * math.atan2(2 * b, a - e) if a != e or b else math.pi / 4
        m = np.pad(labels[y0:y1, x0:x1] == k, 1)
        inner = m[1:-1, 1:-1] & m[:-2, 1:-1] & m[2:, 1:-1] & m[1:-1, :-2] & m[1:-1, 2:]
        edge = np.pad(m[1:-1, 1:-1] & ~inner, 1).astype(int)
        kernel = 10 * (edge[:-2, :-2] + edge[:-2, 2:] + edge[2:, :-2] + edge[2:, 2:]) + 2 * (edge[:-2, 1:-1] + edge[2:, 1:-1] + edge[1:-1, :-2] + edge[1:-1, 2:]) + edge[1:-1, 1:-1]
        kernel = kernel * edge[1:-1, 1:-1]
        # Lengths of a border pixel by how it is joined: straight, mixed, diagonal; fixed values.
        lengths = {5: 1.0, 7: 1.0, 15: 1.0, 17: 1.0, 25: 1.0, 27: 1.0, 21: math.sqrt(2), 33: math.sqrt(2), 13: (1 + math.sqrt(2)) / 2, 23: (1 + math.sqrt(2)) / 2}
        perimeter = sum(v * int((kernel == n).sum()) for n, v in lengths.items())
        corners = np.concatenate([yx + o for o in ((0, 0), (0, 1), (1, 0), (1, 1))])
        h = hull(corners)
        ny, nx = np.roll(h[:, 0], -1), np.roll(h[:, 1], -1)
        row = {
            "label": k, "area": len(yx), "y0": int(y0), "x0": int(x0), "y1": int(y1), "x1": int(x1), "cy": float(c[0]), "cx": float(c[1]), "orientation": angle, "perimeter": perimeter,
            "convex_area": float(abs((h[:, 0] * nx - ny * h[:, 1]).sum()) / 2), "feret": float(np.sqrt(((h[:, None] - h[None]) ** 2).sum(axis=2)).max()),
            "mean_intensity": float(intensity[tuple(yx.T)].mean()) if intensity is not None else math.nan,
        }
        out.append(row)
    return out


def _windows(image: np.ndarray, footprint: np.ndarray, fill: float) -> np.ndarray:
    """Values under the footprint for each pixel: pixels x footprint."""
    fy, fx = footprint.shape
    wide = np.pad(image.astype(float), ((fy // 2, fy // 2), (fx // 2, fx // 2)), constant_values=fill)
    h, w = image.shape
    return np.stack([wide[a : a + h, b : b + w] for a, b in np.argwhere(footprint)], axis=-1)


def disk(radius: int) -> np.ndarray:
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    return y**2 + x**2 <= radius**2


def median_filter(image: np.ndarray, footprint: np.ndarray) -> np.ndarray:
    """Median under the footprint; outside the image is 0."""
    return np.median(_windows(image, footprint, 0.0), axis=-1)


def nan_median_filter(image: np.ndarray, size: int) -> np.ndarray:
    """Median of the present values in a square window; NaN where there are none."""
    v = np.sort(_windows(image, np.ones((size, size), bool), np.nan), axis=-1)
    n = (~np.isnan(v)).sum(axis=-1)
    low, high = np.maximum((n - 1) // 2, 0), np.maximum(n // 2, 0)
    take = lambda i: np.take_along_axis(v, np.minimum(i, v.shape[-1] - 1)[..., None], axis=-1)[..., 0]
    return np.where(n > 0, (take(low) + take(high)) / 2, np.nan)


def orientation_map(field: np.ndarray, radius: int = 0) -> np.ndarray:
    """field (2, h, w): sine and cosine parts -> angle in [0, pi), on request smoothed by medians of cos and sin of the doubled angle."""
    angle = np.mod(np.arctan2(field[0], field[1]), np.pi)
    if radius:
        c, s = (median_filter(f(2 * angle), disk(radius)) for f in (np.cos, np.sin))
        angle = np.mod(np.arctan2(s, c) / 2, np.pi)
    return angle


def line_pixels(y0: int, x0: int, y1: int, x1: int) -> np.ndarray:
    """Pixels of a line, both ends included (Bresenham)."""
    dy, dx = abs(y1 - y0), abs(x1 - x0)
    sy, sx = (1 if y1 > y0 else -1), (1 if x1 > x0 else -1)
    err, out = dx - dy, []
    while True:
        out.append((y0, x0))
        if (y0, x0) == (y1, x1):
            return np.array(out)
        twice = 2 * err
        if twice > -dy:
            err -= dy
            x0 += sx
        if twice < dx:
            err += dx
            y0 += sy


def lines_pixels(y0: np.ndarray, x0: np.ndarray, y1: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pixels of `line_pixels` of many lines, a step of all lines at once: line, y and x of each, line by line in its order."""
    y, x, y1, x1 = (np.array(v, dtype=np.int64) for v in (y0, x0, y1, x1))
    dy, dx = np.abs(y1 - y), np.abs(x1 - x)
    sy, sx = np.where(y1 > y, 1, -1), np.where(x1 > x, 1, -1)
    sizes = np.maximum(dy, dx) + 1
    first = np.cumsum(sizes) - sizes
    ys, xs = np.empty(int(sizes.sum()), np.int64), np.empty(int(sizes.sum()), np.int64)
    err, on, step = dx - dy, np.arange(len(sizes)), 0
    while len(on):
        ys[first[on] + step], xs[first[on] + step] = y[on], x[on]
        step += 1
        on = on[sizes[on] > step]
        twice = 2 * err[on]
        across, down = twice > -dy[on], twice < dx[on]
        err[on] += np.where(down, dx[on], 0) - np.where(across, dy[on], 0)
        x[on] += np.where(across, sx[on], 0)
        y[on] += np.where(down, sy[on], 0)
    return np.repeat(np.arange(len(sizes)), sizes), ys, xs


def dilated(mask: np.ndarray, radius: int) -> np.ndarray:
    return _windows(mask, disk(radius), 0.0).max(axis=-1) > 0 if radius else mask.copy()


def vector_mask(shape: tuple[int, int], y: np.ndarray, x: np.ndarray, angle: np.ndarray, length: np.ndarray, radius: int) -> np.ndarray:
    """Pixels of vectors (centres, angles along (sin, cos), lengths, all in pixels), widened by a radius."""
    mask = np.zeros(shape, dtype=bool)
    for a, b, t, n in zip(y, x, angle, length):
        dy, dx = math.sin(t) * n / 2, math.cos(t) * n / 2
        p = line_pixels(round(a - dy), round(b - dx), round(a + dy), round(b + dx))
        p = p[(p >= 0).all(axis=1) & (p < shape).all(axis=1)]
        mask[tuple(p.T)] = True
    return dilated(mask, radius)


def distance_map(shape: tuple[int, int], y: np.ndarray, x: np.ndarray, angle: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Along each vector 0 at its ends and 1 at its middle; means where vectors overlap, NaN elsewhere."""
    total, count = np.zeros(shape), np.zeros(shape)
    for a, b, t, n in zip(y, x, angle, length):
        dy, dx = math.sin(t) * n / 2, math.cos(t) * n / 2
        p = line_pixels(round(a - dy), round(b - dx), round(a + dy), round(b + dx))
        v = 1 - np.abs(np.linspace(-1, 1, len(p)))
        ok = (p >= 0).all(axis=1) & (p < shape).all(axis=1)
        np.add.at(total, tuple(p[ok].T), v[ok])
        np.add.at(count, tuple(p[ok].T), 1)
    return np.where(count > 0, total / np.maximum(count, 1), np.nan)


def filled_holes(image: np.ndarray, most: int) -> np.ndarray:
    """NaN regions of up to `most` pixels that don't touch the border, relaxed to the mean of their neighbours."""
    out = image.copy()
    labels = label(np.isnan(image))
    for r in regions(labels):
        if r["area"] <= most and r["y0"] > 0 and r["x0"] > 0 and r["y1"] < image.shape[0] and r["x1"] < image.shape[1]:
            hole = labels == r["label"]
            out[hole] = np.nanmean(out[r["y0"] - 1 : r["y1"] + 1, r["x0"] - 1 : r["x1"] + 1])
            for _ in range(500):
                new = (np.roll(out, 1, 0) + np.roll(out, -1, 0) + np.roll(out, 1, 1) + np.roll(out, -1, 1))[hole] / 4
                if np.abs(new - out[hole]).max() < 1e-9:
                    break
                out[hole] = new
    return out


def phase_shift(image: np.ndarray, most: int) -> int:
    """Shift of the odd rows that makes them fit the even rows best, within +-most."""
    n = image.shape[0] // 2 * 2
    even, odd = image[0:n:2].astype(float), image[1:n:2].astype(float)
    scores = [(np.roll(odd, s, axis=1) * even).sum() for s in range(-most, most + 1)]
    return int(np.argmax(scores)) - most


def phase_corrected(image: np.ndarray, most: int) -> np.ndarray:
    out = image.copy()
    out[1::2] = np.roll(image[1::2], phase_shift(image, most), axis=1)
    return out


def bar(along: np.ndarray, across: np.ndarray, width: float, sigma: float, shape: str) -> np.ndarray:
    """One bar of sum 1 around along = 0: Gaussian both ways; half_gaussian along, cut at half the width across; binary, sigma by width."""
    if shape == "gaussian":
        k = np.exp(-(along**2) / (2 * sigma**2) - across**2 / (2 * width**2))
    elif shape == "half_gaussian":
        k = np.exp(-(along**2) / (2 * sigma**2)) * (np.abs(across) <= width / 2)
    elif shape == "binary":
        k = ((np.abs(along) < sigma / 2) & (np.abs(across) <= width / 2)).astype(float)
    else:
        raise ValueError(f"unknown wavelet {shape!r}")
    return k / max(k.sum(), 1e-300)


def _bar_spectra(size: tuple[int, int], half: int, length: float, angle: float, width: float, sigma: float, shape: str, negative_centre: bool) -> tuple[np.ndarray, np.ndarray]:
    """Spectra of the two bars at +- half the length along the angle."""
    y, x = np.mgrid[-half : half + 1, -half : half + 1].astype(float)
    along, across = x * math.cos(angle) + y * math.sin(angle), -x * math.sin(angle) + y * math.cos(angle)
    both = []
    for sign in (-0.5, 0.5):
        k = bar(along - sign * length, across, width, sigma, shape)
        if negative_centre:
            k = k - bar(along, across, width, sigma, shape)
        both.append(np.fft.rfft2(k[::-1, ::-1], size))
    return both[0], both[1]


#: Bytes of the spectra of a scan that are kept for the next image of the same size, at most; of larger images they are made anew.
KEPT_BYTES = 16 << 20


@functools.lru_cache(maxsize=8)
def _kept_spectra(size: tuple[int, int], half: int, lengths: tuple[float, ...], angles: tuple[float, ...], *form) -> list[tuple[np.ndarray, np.ndarray]]:
    return [_bar_spectra(size, half, n, t, *form) for n in lengths for t in angles]


def double_wavelets(image: np.ndarray, lengths: np.ndarray, angles: np.ndarray, width: float, sigma: float, shape: str = "gaussian", negative_centre: bool = False) -> np.ndarray:
    """lengths x angles x h x w: products of the responses of two bars at +- half the length along each angle; on request each bar less one in the middle."""
    h, w = image.shape
    half = int(math.ceil(lengths.max() / 2 + 3 * max(width, sigma)))
    size = (h + 2 * half, w + 2 * half)
    spectrum = np.fft.rfft2(image, size)
    out = np.empty((len(lengths), len(angles), h, w))
    grid, form = (tuple(map(float, lengths)), tuple(map(float, angles))), (width, sigma, shape, negative_centre)
    kept = _kept_spectra(size, half, *grid, *form) if 32 * spectrum.size * len(grid[0]) * len(grid[1]) <= KEPT_BYTES else None
    for i, n in enumerate(grid[0]):
        for j, t in enumerate(grid[1]):
            bars = kept[i * len(grid[1]) + j] if kept else _bar_spectra(size, half, n, t, *form)
            both = [np.fft.irfft2(spectrum * k, size)[half : half + h, half : half + w] for k in bars]
            out[i, j] = np.maximum(both[0], 0) * np.maximum(both[1], 0)
    return out


def best_wavelet(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pixel the best score and its length's and angle's number, the first of equals."""
    n, m = scores.shape[:2]
    flat = scores.reshape(n * m, *scores.shape[2:])
    at = flat.argmax(axis=0)
    return flat.max(axis=0), at // m, at % m


def grey(image: np.ndarray) -> np.ndarray:
    """RGB by fixed weights; other images as they are."""
    return image[..., :3] @ np.array([0.2989, 0.5870, 0.1140]) if image.ndim == 3 and image.shape[-1] in (3, 4) else image


def read_tiff(raw: bytes) -> tuple[list[np.ndarray], dict[str, object]]:
    """Pages (h x w, or h x w x channels) of an uncompressed TIFF, and the first page's description and resolution."""
    end = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if end is None or struct.unpack_from(end + "H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    kinds = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d"}
    at, pages, info = struct.unpack_from(end + "I", raw, 4)[0], [], {}
    while at:
        tags = {}
        for i in range(struct.unpack_from(end + "H", raw, at)[0]):
            code, kind, count = struct.unpack_from(end + "HHI", raw, at + 2 + 12 * i)
            if kind not in kinds:
                continue
            size = struct.calcsize("=" + kinds[kind]) * count
            where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(end + "I", raw, at + 10 + 12 * i)[0]
            tags[code] = raw[where : where + count].rstrip(b"\0").decode(errors="replace") if kind == 2 else struct.unpack_from(end + kinds[kind] * count, raw, where)
        if tags.get(259, (1,))[0] != 1:
            raise ValueError("compressed TIFF files are not supported")
        w, h, channels = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
        kind = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]]
        data = b"".join(raw[a : a + n] for a, n in zip(tags[273], tags[279]))
        page = np.frombuffer(data, dtype=np.dtype(f"{end}{kind}{tags.get(258, (8,))[0] // 8}"), count=w * h * channels)
        pages.append(page.reshape(h, w, channels) if channels > 1 else page.reshape(h, w))
        if not info:
            info = {"description": tags.get(270, ""), "resolution": tags[282][0] / tags[282][1] if 282 in tags and tags[282][1] else None, "unit": {1: "none", 2: "inch", 3: "cm"}.get(tags.get(296, (1,))[0])}
        at = struct.unpack_from(end + "I", raw, at + 2 + 12 * struct.unpack_from(end + "H", raw, at)[0])[0]
    return pages, info


def write_tiff(pages: list[np.ndarray], description: str = "", resolution: float | None = None) -> bytes:
    """An uncompressed little-endian TIFF; resolution in pixels a cm."""
    out, last = bytearray(b"II" + struct.pack("<HI", 42, 0)), 4
    for page in pages:
        data = np.ascontiguousarray(page).tobytes()
        data_at = len(out)
        out += data + b"\0" * (len(data) % 2)
        text = description.encode() + b"\0"
        text_at = len(out)
        out += text + b"\0" * (len(text) % 2)
        ratio_at = len(out)
        out += struct.pack("<II", round((resolution or 1) * 1000), 1000)
        channels = page.shape[2] if page.ndim == 3 else 1
        tags = [(256, 4, 1, page.shape[1]), (257, 4, 1, page.shape[0]), (258, 3, 1, page.dtype.itemsize * 8), (259, 3, 1, 1), (262, 3, 1, 1), (270, 2, len(text), text_at), (273, 4, 1, data_at), (277, 3, 1, channels), (278, 4, 1, page.shape[0]), (279, 4, 1, len(data)), (282, 5, 1, ratio_at), (296, 3, 1, 3), (339, 3, 1, {"u": 1, "i": 2, "f": 3}[page.dtype.kind])]
        struct.pack_into("<I", out, last, len(out))
        out += struct.pack("<H", len(tags))
        for code, kind, count, value in tags:
            if kind == 2 and count <= 4:
                out += struct.pack("<HHI", code, kind, count) + text.ljust(4, b"\0")
            else:
                out += struct.pack("<HHI", code, kind, count) + (struct.pack("<HH", value, 0) if kind == 3 else struct.pack("<I", value))
        last = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)
