"""Dense kernels on one volume, for the operators that need a whole neighbourhood at once.

A Raster is an array in (z, y, x) order with the global position of its first voxel.
Kernels are whole-array NumPy; a voxel is set if it is not zero.  DataFrame operators run
them for each volume or each slice inside Arrow functions.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np

SET = 127
_FAR = np.int32(1 << 28)


class ThinVolumeWarning(UserWarning):
    """A volume is thinner than half of the margin it is mirrored into."""


@dataclass(frozen=True)
class Raster:
    data: np.ndarray
    origin: tuple[int, int, int] = (0, 0, 0)

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.data.shape

    @property
    def on(self) -> np.ndarray:
        return self.data != 0

    @property
    def end(self) -> tuple[int, ...]:
        return tuple(o + n for o, n in zip(self.origin, self.shape, strict=True))

    def over(self, origin, shape, fill=0) -> np.ndarray:
        """The values on another box; outside of this one ``fill``."""
        out = np.full(shape, fill, self.data.dtype)
        low = [max(a, b) for a, b in zip(self.origin, origin, strict=True)]
        high = [min(a, b + n) for a, b, n in zip(self.end, origin, shape, strict=True)]
        if all(h > l for l, h in zip(low, high, strict=True)):
            here = tuple(slice(l - o, h - o) for l, h, o in zip(low, high, self.origin, strict=True))
            there = tuple(slice(l - o, h - o) for l, h, o in zip(low, high, origin, strict=True))
            out[there] = self.data[here]
        return out

    def like(self, other: Raster) -> np.ndarray:
        return self.over(other.origin, other.shape)

    def with_on(self, on: np.ndarray, value: int = SET) -> Raster:
        return Raster(np.where(on, np.int16(value), np.int16(0)), self.origin)

    def count(self) -> int:
        return int(np.count_nonzero(self.data))


def union_box(a: Raster, b: Raster):
    low = tuple(map(min, a.origin, b.origin))
    return low, tuple(max(p, q) - l for p, q, l in zip(a.end, b.end, low, strict=True))


def tight_box(on: np.ndarray):
    """Slices of the smallest box around what is set, or None."""
    out = []
    for axis in range(3):
        hit = np.flatnonzero(on.any(axis=tuple(a for a in range(3) if a != axis)))
        if not len(hit):
            return None
        out.append(slice(int(hit[0]), int(hit[-1]) + 1))
    return tuple(out)


def cut_box(r: Raster, border=(0, 0, 0), z_only: bool = False) -> Raster:
    """The tight box plus a border, inside the old one; an empty volume stays as it is."""
    box = tight_box(r.on)
    if box is None:
        return r
    take = tuple(slice(0, n) if z_only and axis else slice(max(0, s.start - b), min(n, s.stop + b)) for axis, (s, b, n) in enumerate(zip(box, border, r.shape, strict=True)))
    return Raster(r.data[take], tuple(o + s.start for o, s in zip(r.origin, take, strict=True)))


def saturated(a: Raster, b: Raster, sign: int) -> Raster:
    """``a + sign * b`` on the common box, held within -127 .. 127."""
    low, shape = union_box(a, b)
    total = a.over(low, shape).astype(np.int32) + sign * b.over(low, shape).astype(np.int32)
    return Raster(np.clip(total, -SET, SET).astype(np.int16), low)


def masked(r: Raster, mask: Raster) -> Raster:
    return Raster(np.where(mask.like(r) != 0, r.data, 0).astype(r.data.dtype), r.origin)


def valued(r: Raster, on: int, off: int) -> Raster:
    return Raster(np.where(r.on, np.int16(on), np.int16(off)), r.origin)


def peeled(on: np.ndarray, times: int) -> np.ndarray:
    """Slice-wise erosion by the four neighbours; what lies outside is not set."""
    for _ in range(max(0, times)):
        wide = np.pad(on, ((0, 0), (1, 1), (1, 1)))
        on = on & wide[:, :-2, 1:-1] & wide[:, 2:, 1:-1] & wide[:, 1:-1, :-2] & wide[:, 1:-1, 2:]
    return on


# ---- chamfer distance and morphology


def _lower(row: np.ndarray, other: np.ndarray, cost: int) -> None:
    np.minimum(row, other + np.int32(cost), out=row)


def chamfer(on: np.ndarray) -> np.ndarray:
    """3-4-5 chamfer distance of every set voxel to the nearest one that is not.

    Nothing outside of the array is a target.  A shortest path can take its steps across
    slices first, then across rows, then along the row, so three sweeps are exact.
    """
    d = np.where(on, _FAR, np.int32(0))
    nz, ny, nx = d.shape
    for z_order in (range(1, nz), range(nz - 2, -1, -1)):
        step = 1 if z_order.step > 0 else -1
        for z in z_order:
            here, back = d[z], d[z - step]
            _lower(here, back, 3)
            _lower(here[:, 1:], back[:, :-1], 4)
            _lower(here[:, :-1], back[:, 1:], 4)
            _lower(here[1:], back[:-1], 4)
            _lower(here[:-1], back[1:], 4)
            _lower(here[1:, 1:], back[:-1, :-1], 5)
            _lower(here[1:, :-1], back[:-1, 1:], 5)
            _lower(here[:-1, 1:], back[1:, :-1], 5)
            _lower(here[:-1, :-1], back[1:, 1:], 5)
    for y_order in (range(1, ny), range(ny - 2, -1, -1)):
        step = 1 if y_order.step > 0 else -1
        for y in y_order:
            here, back = d[:, y], d[:, y - step]
            _lower(here, back, 3)
            _lower(here[:, 1:], back[:, :-1], 4)
            _lower(here[:, :-1], back[:, 1:], 4)
    slope = np.int32(3) * np.arange(nx, dtype=np.int32)
    d = np.minimum.accumulate(d - slope, axis=2) + slope
    d = np.minimum.accumulate((d + slope)[:, :, ::-1], axis=2)[:, :, ::-1] - slope
    return np.where(d >= _FAR // 2, _FAR, d)


def reach(n: int) -> int:
    """Chamfer distance from which on a voxel survives an erosion by ``n``."""
    if int(n) < 0:
        raise ValueError(f"a distance must be at least 0, not {n}")
    return 3 * int(n) + 2


def shrunk(on: np.ndarray, n: int) -> np.ndarray:
    return on & (chamfer(on) >= reach(n))


def grown(on: np.ndarray, n: int) -> np.ndarray:
    return on | (chamfer(~on) < reach(n))


def bordered(on: np.ndarray, n: int, mirror=(0, 0, 0)) -> np.ndarray:
    """``n`` more voxels on all sides: empty, or mirrored on flagged axes (z, y, x)."""
    for axis, flag in enumerate(mirror):
        if flag and n > 2 * on.shape[axis]:
            warnings.warn(f"axis {'zyx'[axis]} of {on.shape[axis]} voxels is mirrored more than once by a margin of {n}", ThinVolumeWarning, stacklevel=3)
        width = [(n, n) if a == axis else (0, 0) for a in range(3)]
        on = np.pad(on, width, mode="symmetric" if flag else "constant")
    return on


def erode(r: Raster, n: int) -> Raster:
    return r.with_on(shrunk(r.on, n))


def dilate(r: Raster, n: int, mirror=(0, 0, 0)) -> Raster:
    reach(n)
    wide = grown(bordered(r.on, n + 2, mirror), n)[1:-1, 1:-1, 1:-1]
    return Raster(np.where(wide, np.int16(SET), np.int16(0)), tuple(o - n - 1 for o in r.origin))


def close(r: Raster, n: int, mirror=(0, 0, 0)) -> Raster:
    reach(n)
    m = n + 2
    return r.with_on(shrunk(grown(bordered(r.on, m, mirror), n), n)[m:-m, m:-m, m:-m])


def open_(r: Raster, n: int) -> Raster:
    """Erosion and dilation of the volume mirrored on all sides, as one step."""
    reach(n)
    m = n + 2
    return r.with_on(grown(shrunk(bordered(r.on, m, (1, 1, 1)), n), n)[m:-m, m:-m, m:-m])


# ---- smoothing


def gauss_taps(sigma: float, support: int) -> np.ndarray:
    """Taps from the centre outwards, in single precision, over their exact sum."""
    k = np.arange(support + 1, dtype=np.float64)
    g = np.exp(-k * k / (2.0 * sigma * sigma)).astype(np.float32)
    total = float(g[0]) + 2.0 * float(g[1:].astype(np.float64).sum())
    return g / np.float32(total)


def gauss(values: np.ndarray, sigma: float, support: int) -> np.ndarray:
    """Separable smoothing along x, y, z; zeros outside; cut to whole numbers each time."""
    taps = gauss_taps(sigma, support)
    out = values.astype(np.float32)
    for axis in (2, 1, 0):
        n = out.shape[axis]
        wide = np.pad(out, [(support, support) if a == axis else (0, 0) for a in range(3)])
        part = lambda k: wide[tuple(slice(support + k, support + k + n) if a == axis else slice(None) for a in range(3))]  # noqa: B023, E731
        total = part(0) * taps[0]
        for k in range(1, support + 1):
            total = total + (part(-k) + part(k)) * taps[k]
        out = np.trunc(total)
    return out


def whole_number(value: float, name: str) -> int:
    """A native threshold; one that is no whole number is refused, not cut."""
    number = float(value)
    if not np.isfinite(number) or number != int(number):
        raise ValueError(f"{name}: {value!r} is no whole native number; convert densities first")
    return int(number)


def gauss_band(r: Raster, sigma: float, support: int, low: int, high: int, value: int = SET) -> Raster:
    """Smoothed values within ``low .. high``, on the box that the support leaves."""
    s, low, high = int(support), whole_number(low, "low"), whole_number(high, "high")
    if s < 1 or min(r.shape) <= 2 * s:
        raise ValueError(f"support {support} does not fit into a volume of {r.shape}")
    inner = gauss(r.data, sigma, s)[s:-s, s:-s, s:-s]
    return Raster(np.where((inner >= low) & (inner <= high), np.int16(value), np.int16(0)), tuple(o + s for o in r.origin))


# ---- components


def join_up(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the least node that the links ``a - b`` lead to."""
    up = np.arange(n)
    while len(a):
        p, q = up[a], up[b]
        differ = p != q
        if not differ.any():
            break
        a, b, p, q = a[differ], b[differ], p[differ], q[differ]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while True:
            further = up[up]
            if np.array_equal(further, up):
                break
            up = further
    return up


def label(on: np.ndarray, steps, along_x: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Components in raster order (1, 2, ...; 0 is unset), and their sizes from index 0 on.

    ``steps`` are the (z, y, x) steps, without the one along x, that connect voxels.
    Runs along x are the nodes, so the links are one for each overlap of two runs.
    """
    start = on.copy()
    if along_x:
        start[:, :, 1:] &= ~on[:, :, :-1]
    run = np.where(on, np.cumsum(start.ravel()).reshape(on.shape), 0)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for step in steps:
        first = tuple(slice(max(0, -s), n - max(0, s)) for s, n in zip(step, on.shape, strict=True))
        second = tuple(slice(max(0, s), n - max(0, -s)) for s, n in zip(step, on.shape, strict=True))
        p, q = run[first], run[second]
        both = (p > 0) & (q > 0)
        if along_x and both.shape[2] > 1:
            new = both.copy()
            new[:, :, 1:] &= ~both[:, :, :-1]
            both = new
        ends.append((p[both], q[both]))
    n = int(start.sum())
    up = join_up(n + 1, *(np.concatenate(x) for x in zip(*ends, strict=True))) if ends else np.arange(n + 1)
    roots, place = np.unique(up, return_inverse=True)  # node 0 is its own root
    labels = place[run]
    sizes = np.bincount(labels.ravel(), minlength=len(roots))
    sizes[0] = 0
    return labels, sizes


SIX = ((0, 1, 0), (1, 0, 0))
FOUR = ((0, 1, 0),)
EIGHT = ((0, 1, -1), (0, 1, 0), (0, 1, 1))


def rank_order(sizes) -> np.ndarray:
    """Places of the sizes from large to small; equal sizes as a halving shell sort leaves them."""
    keys = np.asarray(sizes, np.int64)
    order = np.argsort(-keys, kind="stable")
    if len(keys) < 2 or (np.diff(keys[order]) != 0).all():
        return order
    items = [(int(k), i) for i, k in enumerate(keys)]
    gap = len(items) // 2
    while gap:
        for right in range(gap, len(items)):
            moving, at = items[right], right
            while at >= gap and items[at - gap][0] < moving[0]:
                items[at] = items[at - gap]
                at -= gap
            items[at] = moving
        gap //= 2
    return np.array([i for _, i in items])


def chosen_ranks(sizes: np.ndarray, first: int = 1, last: int = 1, border: np.ndarray | None = None) -> np.ndarray:
    """Which labels have the given ranks by size (``sizes`` from the background on); all on the ``border`` can count as one."""
    if first < 1 or last < first:
        raise ValueError(f"ranks start at 1 and do not fall: {first} .. {last}")
    new = np.arange(len(sizes))
    if border is not None:
        border = border & (new > 0)
        new = np.where(border, 1, 1 + np.cumsum(~border))
        new[~border] -= 1  # the background is the first that does not touch
        new[0] = 0
        sizes = np.bincount(new, weights=sizes, minlength=2).astype(np.int64)
    chosen = np.zeros(len(sizes), bool)
    chosen[rank_order(sizes[1:])[first - 1 : last] + 1] = True
    return chosen[new]


def on_faces(labels: np.ndarray, count: int, axes=(0, 1, 2)) -> np.ndarray:
    """Which of ``count`` labels touch the first or last plane along an axis."""
    border = np.zeros(count, bool)
    for axis in axes:
        border[np.take(labels, [0, -1], axis=axis).ravel()] = True
    return border


def keep_ranks(r: Raster, first: int = 1, last: int = 1, join_border: bool = False, value: int = SET) -> Raster:
    """The components of the given ranks by size; all that touch a face can count as one."""
    labels, sizes = label(r.on, SIX)
    return r.with_on(chosen_ranks(sizes, first, last, on_faces(labels, len(sizes)) if join_border else None)[labels], value)


def keep_sizes(r: Raster, least: int = 1, most: int = 0, value: int = SET) -> Raster:
    """Components of ``least`` voxels to ``most`` (0: no limit)."""
    labels, sizes = label(r.on, SIX)
    chosen = (sizes >= least) & ((sizes <= most) if most > 0 else True)
    chosen[0] = False
    return r.with_on(chosen[labels], value)


def keep_shares(r: Raster, low: float = 50.0, high: float = 100.0, value: int = SET) -> Raster:
    """In each slice, components with a share of the slice's voxels in ``low .. high`` percent."""
    labels, sizes = label(r.on, FOUR)
    per_slice = r.on.sum(axis=(1, 2))
    share = 100.0 * sizes[labels] / np.maximum(per_slice, 1)[:, None, None]
    return r.with_on(r.on & (share >= low) & (share <= high), value)


def hysteresis(r: Raster, low: int, high: int, mode: int = 0, axes=(1, 0, 0), value: int = SET) -> Raster:
    """Weak voxels that connect, along flagged axes (z, y, x) only, to a seed.

    Mode 0: seeds are at most ``low``, weak at most ``high``; mode 1: at least, turned round.
    """
    if mode not in (0, 1) or high < low:
        raise ValueError(f"mode is 0 or 1 and low is not above high: {mode}, {low}, {high}")
    seed, weak = (r.data <= low, r.data <= high) if mode == 0 else (r.data >= high, r.data >= low)
    labels, sizes = label(weak, [s for s, flag in zip(((1, 0, 0), (0, 1, 0)), axes, strict=False) if flag], bool(axes[2]))
    chosen = np.zeros(len(sizes), bool)
    chosen[labels[seed]] = True
    chosen[0] = False
    return r.with_on(chosen[labels], value)
