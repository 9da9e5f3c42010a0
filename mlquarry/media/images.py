"""Images as arrays of height * width, or height * width * 3, with values from 0 to 255."""

from __future__ import annotations

import numpy as np

# transforms


def resize(x: np.ndarray, size: tuple[int, int], method: str = "bilinear") -> np.ndarray:
    """Nearest (by floor) or bilinear with the corners on the corners."""
    h, w = x.shape[:2]
    if method == "nearest":
        return x[(np.arange(size[0]) * h // size[0])[:, None], (np.arange(size[1]) * w // size[1])[None]]
    ys, xs = np.linspace(0, h - 1, size[0]), np.linspace(0, w - 1, size[1])
    return sampled(x, *np.meshgrid(ys, xs, indexing="ij"))


def sampled(x: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Bilinear values at places; 0 outside."""
    h, w = x.shape[:2]
    inside = (ys >= 0) & (ys <= h - 1) & (xs >= 0) & (xs <= w - 1)
    y0, x0 = np.clip(np.floor(ys).astype(int), 0, h - 1), np.clip(np.floor(xs).astype(int), 0, w - 1)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    grow = (lambda a: a[..., None]) if x.ndim == 3 else (lambda a: a)
    fy, fx = grow(np.clip(ys - y0, 0, 1)), grow(np.clip(xs - x0, 0, 1))
    out = x[y0, x0] * (1 - fy) * (1 - fx) + x[y1, x0] * fy * (1 - fx) + x[y0, x1] * (1 - fy) * fx + x[y1, x1] * fy * fx
    return out * grow(inside)


def rotate(x: np.ndarray, angle: float) -> np.ndarray:
    """By degrees about the centre, the size kept, 0 where nothing was."""
    h, w = x.shape[:2]
    a, cy, cx = np.deg2rad(angle), (h - 1) / 2, (w - 1) / 2
    ys, xs = np.meshgrid(np.arange(h) - cy, np.arange(w) - cx, indexing="ij")
    return sampled(x, cy + ys * np.cos(a) - xs * np.sin(a), cx + ys * np.sin(a) + xs * np.cos(a))


def flip(x: np.ndarray, direction: str = "horizontal") -> np.ndarray:
    return x[:, ::-1] if direction == "horizontal" else x[::-1]


def crop(x: np.ndarray, top: int, left: int, height: int, width: int) -> np.ndarray:
    return x[top : top + height, left : left + width]


def center_crop(x: np.ndarray, height: int, width: int) -> np.ndarray:
    return crop(x, (x.shape[0] - height) // 2, (x.shape[1] - width) // 2, height, width)


def pad(x: np.ndarray, top: int = 0, bottom: int = 0, left: int = 0, right: int = 0, fill: float = 0.0) -> np.ndarray:
    return np.pad(x, [(top, bottom), (left, right)] + [(0, 0)] * (x.ndim - 2), constant_values=fill)


def zoom(x: np.ndarray, factor: float) -> np.ndarray:
    h, w = x.shape[:2]
    return resize(center_crop(x, max(1, int(h / factor)), max(1, int(w / factor))), (h, w))


def perspective(x: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The image with the four points src (x, y) moved to dst."""
    rows, right = [], []
    for (u, v), (s, t) in zip(dst, src, strict=True):
        rows += [[u, v, 1, 0, 0, 0, -s * u, -s * v], [0, 0, 0, u, v, 1, -t * u, -t * v]]
        right += [s, t]
    m = np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)
    ys, xs = np.meshgrid(np.arange(x.shape[0]), np.arange(x.shape[1]), indexing="ij")
    p = np.tensordot(m, np.stack([xs, ys, np.ones_like(xs)]).astype(float), axes=1)
    return sampled(x, p[1] / p[2], p[0] / p[2])


def standardize(x: np.ndarray, mean: float | None = None, std: float | None = None) -> np.ndarray:
    return (x - (x.mean() if mean is None else mean)) / ((x.std() if std is None else std) + 1e-10)


def rescale(x: np.ndarray, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    return (x - x.min()) / (x.max() - x.min() + 1e-10) * (high - low) + low


# augmentation, each with the seed it draws from


def gaussian_noise(x: np.ndarray, mean: float = 0.0, std: float = 25.0, seed: int = 0) -> np.ndarray:
    return np.clip(x + np.random.default_rng(seed).normal(mean, std, x.shape), 0, 255)


def salt_pepper(x: np.ndarray, salt: float = 0.01, pepper: float = 0.01, seed: int = 0) -> np.ndarray:
    u = np.random.default_rng(seed).random(x.shape[:2])
    out = x.astype(float).copy()
    out[u < salt], out[u > 1 - pepper] = 255, 0
    return out


def brightness(x: np.ndarray, factor: float) -> np.ndarray:
    return np.clip(x * factor, 0, 255)


def contrast(x: np.ndarray, factor: float) -> np.ndarray:
    return np.clip((x - x.mean()) * factor + x.mean(), 0, 255)


def saturation(x: np.ndarray, factor: float) -> np.ndarray:
    gray = grayscale(x)[..., None]
    return np.clip(gray + (x - gray) * factor, 0, 255)


def hue(x: np.ndarray, shift: float) -> np.ndarray:
    hsv = rgb_to_hsv(x)
    hsv[..., 0] = (hsv[..., 0] + shift) % 360
    return hsv_to_rgb(hsv)


def random_crop(x: np.ndarray, height: int, width: int, seed: int = 0) -> np.ndarray:
    own = np.random.default_rng(seed)
    return crop(x, int(own.integers(0, x.shape[0] - height + 1)), int(own.integers(0, x.shape[1] - width + 1)), height, width)


def elastic(x: np.ndarray, alpha: float = 34.0, sigma: float = 4.0, seed: int = 0) -> np.ndarray:
    own = np.random.default_rng(seed)
    dy, dx = (gaussian_blur(own.uniform(-1, 1, x.shape[:2]), 2 * int(3 * sigma) + 1, sigma) * alpha for _ in range(2))
    ys, xs = np.meshgrid(np.arange(x.shape[0]), np.arange(x.shape[1]), indexing="ij")
    return sampled(x, ys + dy, xs + dx)


def occlude(x: np.ndarray, height: int, width: int, patches: int = 1, color: float = 0.0, seed: int = 0) -> np.ndarray:
    own, out = np.random.default_rng(seed), x.astype(float).copy()
    for _ in range(patches):
        top, left = int(own.integers(0, x.shape[0] - height + 1)), int(own.integers(0, x.shape[1] - width + 1))
        out[top : top + height, left : left + width] = color
    return out


def mixup(a: np.ndarray, b: np.ndarray, alpha: float = 0.5) -> np.ndarray:
    return alpha * a + (1 - alpha) * b


def cutmix(a: np.ndarray, b: np.ndarray, share: float = 0.25, seed: int = 0) -> np.ndarray:
    h, w = max(1, int(a.shape[0] * share**0.5)), max(1, int(a.shape[1] * share**0.5))
    own, out = np.random.default_rng(seed), a.astype(float).copy()
    top, left = int(own.integers(0, a.shape[0] - h + 1)), int(own.integers(0, a.shape[1] - w + 1))
    out[top : top + h, left : left + w] = b[top : top + h, left : left + w]
    return out


# filters


def _windows(x: np.ndarray, h: int, w: int, mode: str = "symmetric") -> np.ndarray:
    padded = np.pad(x.astype(float), ((h // 2, h - 1 - h // 2), (w // 2, w - 1 - w // 2)), mode=mode)
    return np.lib.stride_tricks.sliding_window_view(padded, (h, w))


def convolve(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Convolution of the same size, the border mirrored."""
    return (_windows(x, *kernel.shape) * kernel[::-1, ::-1]).sum(axis=(2, 3))


def gaussian_kernel(size: int, sigma: float) -> np.ndarray:
    at = np.arange(size) - size // 2
    k = np.exp(-(at[:, None] ** 2 + at[None] ** 2) / (2 * sigma**2))
    return k / k.sum()


def gaussian_blur(x: np.ndarray, size: int = 5, sigma: float = 1.0) -> np.ndarray:
    return convolve(x, gaussian_kernel(size, sigma))


def median_filter(x: np.ndarray, size: int = 5) -> np.ndarray:
    return np.median(_windows(x, size, size), axis=(2, 3))


def box_filter(x: np.ndarray, size: int = 5) -> np.ndarray:
    return _windows(x, size, size).mean(axis=(2, 3))


def bilateral_filter(x: np.ndarray, d: int = 9, sigma_color: float = 75.0, sigma_space: float = 75.0) -> np.ndarray:
    view = _windows(x, d, d)
    weight = gaussian_kernel(d, sigma_space) * np.exp(-((view - x[..., None, None]) ** 2) / (2 * sigma_color**2))
    return (view * weight).sum(axis=(2, 3)) / weight.sum(axis=(2, 3))


# The usual gradient kernels across and down.
SOBEL = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)
SCHARR = np.array([[-3, 0, 3], [-10, 0, 10], [-3, 0, 3]], float)
PREWITT = np.array([[-1, 0, 1], [-1, 0, 1], [-1, 0, 1]], float)
LAPLACIAN = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float)


def gradients(x: np.ndarray, kernel: np.ndarray = SOBEL) -> tuple[np.ndarray, np.ndarray]:
    return convolve(x, kernel[::-1, ::-1]), convolve(x, kernel.T[::-1, ::-1])


def edges(x: np.ndarray, kernel: np.ndarray = SOBEL) -> np.ndarray:
    """The size of the gradient, at most 255."""
    return np.clip(np.hypot(*gradients(x, kernel)), 0, 255)


def laplacian(x: np.ndarray) -> np.ndarray:
    return np.clip(np.abs(convolve(x, LAPLACIAN)), 0, 255)


def canny(x: np.ndarray, low: float = 0.1, high: float = 0.3) -> np.ndarray:
    """Blur, gradient, and two thresholds as shares of the largest: 255 above the high one, 128 between."""
    size = np.hypot(*gradients(gaussian_blur(x)))
    top = size.max() or 1.0
    return np.where(size >= high * top, 255.0, np.where(size >= low * top, 128.0, 0.0))


def _cross(x: np.ndarray, f, fill: float) -> np.ndarray:
    p = np.pad(x.astype(float), 1, constant_values=fill)
    return f(np.stack([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]), axis=0)


def erode(x: np.ndarray) -> np.ndarray:
    return _cross(x > 0, np.min, 0.0)


def dilate(x: np.ndarray) -> np.ndarray:
    return _cross(x > 0, np.max, 0.0)


def opening(x: np.ndarray) -> np.ndarray:
    return dilate(erode(x))


def closing(x: np.ndarray) -> np.ndarray:
    return erode(dilate(x))


def grayscale(x: np.ndarray) -> np.ndarray:
    return x @ np.array([0.299, 0.587, 0.114]) if x.ndim == 3 else x


def rgb_to_hsv(x: np.ndarray) -> np.ndarray:
    """Hue from 0 to 360, saturation and value from 0 to 1."""
    r, g, b = np.moveaxis(x / 255.0, -1, 0)
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    d = np.where(top > low, top - low, 1.0)
    h = np.where(top == r, (g - b) / d % 6, np.where(top == g, (b - r) / d + 2, (r - g) / d + 4)) * 60
    return np.stack([np.where(top > low, h, 0.0), np.where(top > 0, (top - low) / np.where(top > 0, top, 1.0), 0.0), top], axis=-1)


def hsv_to_rgb(x: np.ndarray) -> np.ndarray:
    h, s, v = np.moveaxis(x, -1, 0)
    k = lambda n: (n + h / 60) % 6
    return np.stack([(v - v * s * np.clip(np.minimum(k(n), 4 - k(n)), 0, 1)) * 255 for n in (5, 3, 1)], axis=-1)


# features


def histogram(x: np.ndarray, bins: int = 256) -> np.ndarray:
    n = np.histogram(x, bins, (0, 256))[0]
    return n / max(1, n.sum())


def color_histogram(frames: np.ndarray, bins: int = 256) -> np.ndarray:
    """Shares of the values of red, green and blue over all frames (time, height, width, 3), one after the other."""
    return np.concatenate([(n := np.histogram(frames[..., c], bins, (0, 256))[0]) / (n.sum() + 1e-10) for c in range(3)])


def edge_density(x: np.ndarray) -> float:
    """The share of pixels whose gradient is above a tenth of the largest."""
    size = np.hypot(*gradients(x))
    return float((size > 0.1 * size.max()).mean())


def equalize(x: np.ndarray) -> np.ndarray:
    cdf = histogram(x).cumsum()
    return np.floor(cdf[np.clip(x, 0, 255).astype(int)] * 255)


def match_histogram(x: np.ndarray, ref: np.ndarray) -> np.ndarray:
    a, b = histogram(x).cumsum(), histogram(ref).cumsum()
    table = np.abs(a[:, None] - b[None]).argmin(axis=1)
    return table[np.clip(x, 0, 255).astype(int)].astype(float)


def local_binary_pattern(x: np.ndarray) -> np.ndarray:
    """For each inner pixel a bit for each of the 8 neighbours that is as large or larger."""
    c, out = x[1:-1, 1:-1], np.zeros((x.shape[0] - 2, x.shape[1] - 2))
    for k, (dy, dx) in enumerate([(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]):
        out += (x[1 + dy : x.shape[0] - 1 + dy, 1 + dx : x.shape[1] - 1 + dx] >= c) * 2**k
    return out


def glcm(x: np.ndarray, distance: int = 1, levels: int = 8) -> np.ndarray:
    """Contrast, dissimilarity, homogeneity, energy and correlation of neighbouring grey levels, to the right and below."""
    q = np.clip(x * levels // 256, 0, levels - 1).astype(int)
    m = np.zeros((levels, levels))
    for a, b in ((q[:, :-distance], q[:, distance:]), (q[:-distance], q[distance:])):
        np.add.at(m, (a.reshape(-1), b.reshape(-1)), 1)
    m /= max(1, m.sum())
    i, j = np.indices(m.shape)
    mi, mj = (m * i).sum(), (m * j).sum()
    si, sj = np.sqrt((m * (i - mi) ** 2).sum()), np.sqrt((m * (j - mj) ** 2).sum())
    return np.array([(m * (i - j) ** 2).sum(), (m * np.abs(i - j)).sum(), (m / (1 + (i - j) ** 2)).sum(), np.sqrt((m**2).sum()), (m * (i - mi) * (j - mj)).sum() / (si * sj + 1e-10)])


def hog(x: np.ndarray, cell: int = 8, bins: int = 9) -> np.ndarray:
    """Unsigned directions of the gradients in each cell, weighted by their size."""
    gy, gx = np.gradient(x.astype(float))
    size, at = np.hypot(gx, gy), np.minimum((np.degrees(np.arctan2(gy, gx)) % 180 / (180 / bins)).astype(int), bins - 1)
    rows, columns = x.shape[0] // cell, x.shape[1] // cell
    out = np.zeros((rows, columns, bins))
    y, c = np.indices(x.shape)
    use = (y < rows * cell) & (c < columns * cell)
    np.add.at(out, (y[use] // cell, c[use] // cell, at[use]), size[use])
    return out.reshape(-1)


def moments(x: np.ndarray) -> np.ndarray:
    """Mass, centre (y, x), central second moments (yy, xx, xy) and the eccentricity that they give."""
    y, c = np.indices(x.shape)
    m = x.sum() or 1.0
    cy, cx = (y * x).sum() / m, (c * x).sum() / m
    yy, xx, xy = ((y - cy) ** 2 * x).sum() / m, ((c - cx) ** 2 * x).sum() / m, ((y - cy) * (c - cx) * x).sum() / m
    spread = np.sqrt((yy - xx) ** 2 + 4 * xy**2)
    large, small = (yy + xx + spread) / 2, (yy + xx - spread) / 2
    return np.array([x.sum(), cy, cx, yy, xx, xy, np.sqrt(max(0.0, 1 - small / large)) if large > 0 else 0.0])


# motion


def lucas_kanade(a: np.ndarray, b: np.ndarray, window: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Flow (u across, v down) by least squares in each window."""
    gy, gx = np.gradient(a.astype(float))
    t = b.astype(float) - a
    total = lambda z: _windows(z, window, window, "constant").sum(axis=(2, 3))
    xx, yy, xy, xt, yt = total(gx * gx), total(gy * gy), total(gx * gy), total(gx * t), total(gy * t)
    det = xx * yy - xy**2
    safe = np.where(np.abs(det) > 1e-9, det, np.inf)
    return -(yy * xt - xy * yt) / safe, -(xx * yt - xy * xt) / safe


def horn_schunck(a: np.ndarray, b: np.ndarray, alpha: float = 1.0, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    gy, gx = np.gradient(a.astype(float))
    t = b.astype(float) - a
    u, v = np.zeros_like(t), np.zeros_like(t)
    for _ in range(rounds):
        mu, mv = box_filter(u, 3), box_filter(v, 3)
        shift = (gx * mu + gy * mv + t) / (alpha**2 + gx**2 + gy**2)
        u, v = mu - gx * shift, mv - gy * shift
    return u, v


def flow_statistics(u: np.ndarray, v: np.ndarray, bins: int = 8) -> np.ndarray:
    """Mean, deviation and largest size of a flow, then its directions in bins, weighted by size."""
    size, angle = np.hypot(u, v), np.arctan2(v, u) % (2 * np.pi)
    n = np.bincount(np.minimum((angle / (2 * np.pi) * bins).astype(int), bins - 1).reshape(-1), size.reshape(-1), bins)
    return np.concatenate(([size.mean(), size.std(), size.max()], n / max(n.sum(), 1e-10)))


def moving(a: np.ndarray, b: np.ndarray, threshold: float = 30.0) -> np.ndarray:
    return (np.abs(b.astype(float) - a) > threshold).astype(float)
