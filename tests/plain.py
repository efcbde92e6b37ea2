"""Plain-Python forms of the kernels, as slow and simple as can be."""

import numpy as np


def flood(on, steps):
    steps = [*steps, *[tuple(-a for a in s) for s in steps]]
    out, n = np.zeros(on.shape, int), 0
    for p in map(tuple, np.argwhere(on)):
        if out[p]:
            continue
        n += 1
        stack = [p]
        out[p] = n
        while stack:
            q = stack.pop()
            for s in steps:
                r = tuple(a + b for a, b in zip(q, s))
                if all(0 <= a < b for a, b in zip(r, on.shape)) and on[r] and not out[r]:
                    out[r] = n
                    stack.append(r)
    return out


def chamfer(on):
    empty = np.argwhere(~on)
    out = np.zeros(on.shape, int)
    for p in np.argwhere(on):
        o = np.sort(np.abs(empty - p), axis=1)[:, ::-1]
        out[tuple(p)] = (5 * o[:, 2] + 4 * (o[:, 1] - o[:, 2]) + 3 * (o[:, 0] - o[:, 1])).min() if len(empty) else 1 << 28
    return out


def contacts(on):
    """Every voxel in the order of the sweeps; the first of the shortest offsets counts."""
    nz, ny, nx = on.shape
    v = {p: (None if on[p] else (0, 0, 0)) for p in np.ndindex(on.shape)}
    for dz in (1, -1):
        for z in range(nz)[::dz]:
            scans = [(1, 1), (1, -1), (-1, -1), (-1, 1)]
            for dy, dx in scans if dz == 1 else [(-a, -b) for a, b in scans]:
                for y in range(ny)[::dy]:
                    for x in range(nx)[::dx]:
                        if not on[z, y, x]:
                            continue
                        best = v[z, y, x]
                        for o in ((-dz, 0, 0), (0, -dy, 0), (0, 0, -dx), (-dz, -dy, 0), (-dz, 0, -dx), (0, -dy, -dx), (-dz, -dy, -dx)):
                            w = v.get((z + o[0], y + o[1], x + o[2]))
                            if w is not None:
                                c = tuple(a + b for a, b in zip(w, o))
                                if best is None or sum(t * t for t in c) < sum(t * t for t in best):
                                    best = c
                        v[z, y, x] = best
    return np.array([v[p] for p in np.ndindex(on.shape)]).reshape(*on.shape, 3).transpose(3, 0, 1, 2)


def gauss_line(values, taps):
    """One line in single precision: the centre, then pairs outwards, then cut."""
    n, out = len(values), []
    at = lambda i: np.float32(values[i]) if 0 <= i < n else np.float32(0)
    for i in range(n):
        total = np.float32(taps[0] * at(i))
        for k in range(1, len(taps)):
            total = np.float32(total + np.float32(taps[k] * np.float32(at(i - k) + at(i + k))))
        out.append(np.trunc(total))
    return out


def cylinder():
    z, y, x = np.indices((40, 90, 90))
    r2 = (2 * y - 89) ** 2 + (2 * x - 89) ** 2
    v = np.where(r2 > 6400, 300, np.where(r2 >= 4096, 12000, np.where((r2 < 3136) & (x % 8 < 3) & (y % 8 < 3), 9000, 1000)))
    return v.astype(np.int32), r2
