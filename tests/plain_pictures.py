"""Plain picture operations in numpy, pixel by pixel, that filters are held against."""

import math

import numpy as np


def half_even(x):
    return np.rint(np.round(x, 6)).astype(int)


def moved(a, offsets, best):
    """The best of the pixels at ``offsets`` (dy, dx) that lie in the picture."""
    h, w = a.shape
    both, outside = (np.maximum, -1) if best is max else (np.minimum, 1 << 20)
    out = np.full_like(a, outside)
    for j, i in offsets:
        if abs(j) < h and abs(i) < w:
            to = slice(max(0, -j), min(h, h - j)), slice(max(0, -i), min(w, w - i))
            out[to] = both(out[to], a[max(0, j) : h + min(0, j), max(0, i) : w + min(0, i)])
    return out


def box(w, h=None):
    h = h or w
    return [(j, i) for j in range(-(h // 2), h - h // 2) for i in range(-(w // 2), w - w // 2)]


def ellipse(k):
    r = k // 2
    return [(j, i) for j in range(-r, r + 1) for d in [int(np.rint(r * math.sqrt((r * r - j * j) / (r * r))))] for i in range(-d, d + 1)]


def closing(a, offsets):
    return moved(moved(a, offsets, max), offsets, min)


def opening(a, offsets):
    return moved(moved(a, offsets, min), offsets, max)


def blur(a, n):
    weights = [math.comb(n - 1, i) for i in range(n)]
    p = np.pad(a, n // 2, mode="reflect")
    h, w = a.shape
    s = sum(p[j : j + h, i : i + w] * weights[j] * weights[i] for j in range(n) for i in range(n))
    return (s + sum(weights) ** 2 // 2) // sum(weights) ** 2


def median(a):
    p = np.pad(a, 1, mode="edge")
    h, w = a.shape
    return np.median(np.stack([p[j : j + h, i : i + w] for j in range(3) for i in range(3)]), axis=0).astype(int)


def above_means(a, block, offset):
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    r = block // 2
    g = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    g /= g.sum()
    p = np.pad(a.astype(float), r, mode="edge")
    rows = np.apply_along_axis(lambda v: np.convolve(v, g, "valid"), 1, p)
    mean = half_even(np.apply_along_axis(lambda v: np.convolve(v, g, "valid"), 0, rows))
    return np.where(a - mean > -offset, 255, 0)


def above_otsu(a):
    best, at = -1.0, 0
    values = np.unique(a)
    for t in values:
        low, high = a[a <= t], a[a > t]
        score = round(float((low.sum() * a.size - a.sum() * low.size) ** 2) / (low.size * high.size), 3) if high.size else 0.0
        if score > best:
            best, at = score, t
    return np.where(a > at, 255, 0)


def parts(a):
    """Lists of pixels that hang together, corners too, in the order of their first pixel."""
    left, out = set(zip(*np.nonzero(a > 0))), []
    for p in sorted(left):
        if p not in left:
            continue
        todo, own = [p], []
        left.discard(p)
        while todo:
            y, x = todo.pop()
            own.append((y, x))
            for q in [(y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1)]:
                if q in left:
                    left.discard(q)
                    todo.append(q)
        out.append(own)
    return out


def drawn(a, some):
    out = np.zeros_like(a)
    for own in some:
        for p in own:
            out[p] = 255
    return out


def without_small(a, least):
    found = parts(a)
    some = [p for p in found if len(p) >= least]
    return drawn(a, some or ([max(found, key=len)] if found else []))


def character(a):
    found = parts(a)
    if len(found) <= 1:
        return drawn(a, found)
    frame = lambda own: (min(x for _, x in own), min(y for y, _ in own), max(x for _, x in own) + 1, max(y for y, _ in own) + 1)
    main = max(found, key=len)
    x0, y0, x1, y1 = frame(main)
    w, h = x1 - x0, y1 - y0
    pad = max(3, round(max(w, h) * 0.55))
    keep = [main]
    for own in found:
        if own is main or len(own) < max(3, round(len(main) * 0.035)):
            continue
        a0, b0, a1, b1 = frame(own)
        near = a0 <= x1 + pad + 2 and a1 >= x0 - pad - 2 and b0 <= y1 + pad + 2 and b1 >= y0 - pad - 2
        cx, cy = np.mean([x for _, x in own]), np.mean([y for y, _ in own])
        central = abs(cx - (x0 + w / 2)) <= max(7, w * 1.15) and abs(cy - (y0 + h / 2)) <= max(7, h * 1.15)
        if near or central or len(own) >= max(6, round(len(main) * 0.2)):
            keep.append(own)
    return drawn(a, keep)


def edges(a):
    return np.concatenate([a[0], a[-1], a[:, 0], a[:, -1]])


def page_score(b):
    n = np.count_nonzero(b)
    if not n:
        return -math.inf
    h, w = b.shape
    found = [(len(p), max(x for _, x in p) - min(x for _, x in p) + 1, max(y for y, _ in p) - min(y for y, _ in p) + 1) for p in parts(b)]
    noise = sum(s < max(6, int(b.size * 0.00004)) for s, *_ in found)
    ruled = sum(u >= w * 0.2 and v <= max(18, int(h * 0.03)) for _, u, v in found)
    chars = sum(v >= max(12, int(h * 0.02)) and u <= max(24, int(w * 0.18)) for _, u, v in found)
    return -abs(n / b.size - 0.15) - np.count_nonzero(edges(b)) / len(edges(b)) * 0.8 - min(noise, 80) * 0.01 - ruled * 0.12 + min(chars, 20) * 0.02


def character_score(b):
    n = np.count_nonzero(b)
    if not n:
        return -math.inf
    ys, xs = np.nonzero(b)
    return -abs(n / b.size - 0.12) - np.count_nonzero(edges(b)) / len(edges(b)) * 0.8 + min(n / ((np.ptp(xs) + 1) * (np.ptp(ys) + 1)), 0.6) * 0.18


def by_area(a, w, h):
    def weights(n, to):
        step = n / to
        return np.array([[max(0.0, min((j + 1) * step, i + 1) - max(j * step, i)) / step for i in range(n)] for j in range(to)])
    return half_even(weights(a.shape[0], h) @ a @ weights(a.shape[1], w).T)


def by_neighbours(a, w, h, by_area=False):
    def places(n, to):
        for j in range(to):
            f = (j + 0.5) * n / to - 0.5
            i = math.floor(f)
            part = f - i
            if by_area:
                i = j * n // to
                part = max(0.0, (j + 1) - (i + 1) * to / n) % 1.0
            if i < 0 or i >= n - 1:
                i, part = (0 if i < 0 else n - 1), 0.0
            yield i, min(n - 1, i + 1), round((1 - part) * 2048), round(part * 2048)
    rows = np.stack([a[:, p] * u + a[:, q] * v for p, q, u, v in places(a.shape[1], w)], 1)
    return np.stack([(((u * (rows[p] >> 4)) >> 16) + ((v * (rows[q] >> 4)) >> 16) + 2) >> 2 for p, q, u, v in places(a.shape[0], h)])


def even_background(a):
    if a.std() < 18:
        return a
    h, w = a.shape
    k = max(61, int(min(h, w) / 6) | 1)
    if max(h, w) > 600:
        scale = 600 / max(h, w)
        small = by_area(a, int(w * scale), int(h * scale))
        ground = by_neighbours(closing(small, ellipse(max(11, int(k * scale) | 1))), w, h)
    else:
        ground = closing(a, ellipse(k))
    out = np.minimum(255, a * 128 // np.maximum(1, ground))
    return a if out.mean() < 5 else out


def contrast(a):
    m = a.mean()
    clip = 4.0 if m < 30 else 3.0 if m < 60 else 2.0
    h, w = a.shape
    big = a if h % 8 == 0 and w % 8 == 0 else np.pad(a, ((0, 8 - h % 8), (0, 8 - w % 8)), mode="reflect")
    th, tw = big.shape[0] // 8, big.shape[1] // 8
    most = max(1, int(clip * th * tw / 256))
    curve = np.zeros((8, 8, 256), int)
    for j in range(8):
        for i in range(8):
            n = np.bincount(big[j * th : (j + 1) * th, i * tw : (i + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(0, n - most).sum())
            n = np.minimum(n, most) + over // 256
            left = over % 256
            if left:
                for b in range(0, 256, max(256 // left, 1)):
                    if left == 0:
                        break
                    n[b] += 1
                    left -= 1
            curve[j, i] = np.minimum(255, half_even(np.cumsum(n) * 255.0 / (th * tw)))
    out = np.zeros_like(a)
    for y in range(h):
        fy = y / th - 0.5
        j1, j2, b = max(0, math.floor(fy)), min(7, math.floor(fy) + 1), fy - math.floor(fy)
        for x in range(w):
            fx = x / tw - 0.5
            i1, i2, c = max(0, math.floor(fx)), min(7, math.floor(fx) + 1), fx - math.floor(fx)
            v = a[y, x]
            out[y, x] = half_even((curve[j1, i1, v] * (1 - c) + curve[j1, i2, v] * c) * (1 - b) + (curve[j2, i1, v] * (1 - c) + curve[j2, i2, v] * c) * b)
    return out


def enhanced(a):
    soft = blur(contrast(even_background(a)), 5)
    return np.minimum(255, 2 * soft - opening(soft, box(15)))


def binarized(a):
    h, w = a.shape
    block = min(51, max(21, round(min(h, w) * 0.04) | 1))
    found = [above_means(a, block, -2), above_means(a, block, -5), above_otsu(a)]
    clean = [without_small(closing(median(f), box(3)), max(6, int(h * w * 0.00002))) for f in found]
    return max(clean, key=lambda b: round(page_score(b), 9))


def dark_strokes(a):
    h, w = a.shape
    k = min(61, max(15, round(min(h, w) * 0.05) | 1))
    hat = blur(closing(a, ellipse(k)) - a, 5)
    return without_small(closing(median(above_otsu(hat)), box(3)), max(20, int(h * w * 0.00003)))


def canvas_strokes(a):
    return without_small(closing(255 - above_otsu(blur(a, 5)), box(3)), max(6, int(a.size * 0.00002)))


def character_ink(a):
    soft = blur(a, 3)
    clean = [character(opening(median(f), box(2))) for f in (above_otsu(soft), above_means(soft, 21, -2))]
    return max(clean, key=character_score)


CORNER = [(0, 0), (0, -1), (-1, 0)]


def strengthened(a):
    out = closing(a, CORNER)
    if out.any():
        ys, xs = np.nonzero(out)
        h, w = np.ptp(ys) + 1, np.ptp(xs) + 1
        if np.count_nonzero(out) / (h * w) < 0.2 and min(h, w) >= 6:
            out = moved(out, CORNER, max)
    return out


def centred(a):
    canvas = np.zeros((28, 28), int)
    if not a.any():
        return canvas
    ys, xs = np.nonzero(a)
    crop = a[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
    h, w = crop.shape
    fill = np.count_nonzero(crop) / (h * w)
    inner = 25 if fill < 0.12 else 24 if fill < 0.18 else 22
    nh, nw = (inner, max(1, round(w * inner / h))) if h >= w else (max(1, round(h * inner / w)), inner)
    small = (by_neighbours if max(nw, nh) > max(w, h) else by_area)(crop, nw, nh)
    canvas[(28 - nh) // 2 : (28 - nh) // 2 + nh, (28 - nw) // 2 : (28 - nw) // 2 + nw] = small
    total = canvas.sum()
    dx, dy = round(14 - (canvas.sum(0) * np.arange(28)).sum() / total), round(14 - (canvas.sum(1) * np.arange(28)).sum() / total)
    out = np.zeros_like(canvas)
    for y in range(28):
        for x in range(28):
            if 0 <= y - dy < 28 and 0 <= x - dx < 28:
                out[y, x] = canvas[y - dy, x - dx]
    return out


def normalized(a):
    return centred(character(strengthened(character(np.where(a > 0, 255, 0)))))


def preprocessed(a):
    return centred(character_ink(a))


def warped(a, m):
    """From the four pixels around each place that the matrix m of the way back names, in 32nds."""
    h, w = a.shape
    p = np.pad(a, 1)
    out = np.zeros_like(a)
    for y in range(h):
        for x in range(w):
            i = (int(np.rint(m[0] * x * 1024)) + int(np.rint((m[1] * y + m[2]) * 1024)) + 16) >> 5
            j = (int(np.rint(m[3] * x * 1024)) + int(np.rint((m[4] * y + m[5]) * 1024)) + 16) >> 5
            u, v, r, b = i >> 5, j >> 5, i & 31, j & 31
            if -1 <= u < w and -1 <= v < h:
                q = p[v + 1 : v + 3, u + 1 : u + 3]
                out[y, x] = (q[0, 0] * (32 - r) * (32 - b) + q[0, 1] * r * (32 - b) + q[1, 0] * (32 - r) * b + q[1, 1] * r * b + 512) >> 10
    return out


def softened(a):
    p = np.pad(a, 1, mode="reflect")
    k = np.array([27, 202, 27])
    h, w = a.shape
    return (sum(p[j : j + h, i : i + w] * k[j] * k[i] for j in range(3) for i in range(3)) + 32768) >> 16


def fitted(a):
    canvas = np.zeros((28, 28), int)
    if not a.any():
        return canvas
    ys, xs = np.nonzero(a)
    crop = a[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
    h, w = crop.shape
    scale = min(20 / h, 20 / w)
    nw, nh = max(1, round(w * scale)), max(1, round(h * scale))
    y, x = (28 - nh) // 2, (28 - nw) // 2
    canvas[y : y + nh, x : x + nw] = by_neighbours(crop, nw, nh, by_area=True) if scale > 1 else by_area(crop, nw, nh)
    return canvas


def lesser_shade(a):
    ink = 255 - above_otsu(blur(a, 3))
    return 255 - ink if np.count_nonzero(ink) > ink.size // 2 else ink
