"""NumPy kernels for the steps that are sequential inside one recording."""

from __future__ import annotations

from collections.abc import Callable
from heapq import heappop, heappush

import numpy as np


def window_of(name: str, size: int) -> np.ndarray:
    return np.ones(size) if name == "rectangular" else np.hanning(size) if size > 1 else np.ones(1)


def amplitude_spectrum(x: np.ndarray, window: str = "hann", n_fft: int | None = None, remove_mean: bool = True) -> np.ndarray:
    """One-sided amplitudes along the last axis; the gain counts the samples before zero padding."""
    size = x.shape[-1]
    n_fft = n_fft or size
    w = window_of(window, size)
    centred = x - x.mean(-1, keepdims=True) if remove_mean else x
    mag = np.abs(np.fft.rfft(centred * w, n_fft)) / (size * w.mean())
    mag[..., 1 : None if n_fft % 2 else -1] *= 2
    return mag


def analytic_envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal."""
    n = x.shape[-1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * gain))


def find_peaks(y: np.ndarray, height: float | None = None, prominence: float | None = None, distance: int | None = None, width: float | None = None) -> list[tuple[int, float, float]]:
    """(place, prominence, width at half prominence) of local maxima.

    A plateau counts at its middle; ``distance`` removes lower peaks first, before prominences.
    """
    found = []
    i = 1
    while i < len(y) - 1:
        if y[i] > y[i - 1]:
            j = i
            while j + 1 < len(y) and y[j + 1] == y[i]:
                j += 1
            if j + 1 < len(y) and y[j + 1] < y[i]:
                found.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    if height is not None:
        found = [p for p in found if y[p] >= height]
    if distance and distance > 1:
        keep = dict.fromkeys(found, True)
        for p in sorted(found, key=lambda p: (-y[p], -p)):
            if keep[p]:
                for q in found:
                    if q != p and abs(q - p) < distance:
                        keep[q] = False
        found = [p for p in found if keep[p]]
    out = []
    for p in found:
        sides = []
        for step in (-1, 1):
            i, low = p, y[p]
            while 0 <= i < len(y) and y[i] <= y[p]:
                low = min(low, y[i])
                i += step
            sides.append(low)
        prom = y[p] - max(sides)
        level = y[p] - prom / 2
        ends = []
        for step in (-1, 1):
            i = p
            while 0 < i < len(y) - 1 and y[i] > level:
                i += step
            at = float(i)
            if y[i] < level:
                at -= step * (level - y[i]) / (y[i - step] - y[i])
            ends.append(at)
        if (prominence is None or prom >= prominence) and (width is None or ends[1] - ends[0] >= width):
            out.append((p, float(prom), ends[1] - ends[0]))
    return out


def assign(costs: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of least total cost; of equal rows and columns the first is taken.

    Successive shortest augmenting paths with potentials.
    """
    flipped = costs.shape[0] > costs.shape[1]
    a = costs.T if flipped else costs
    n, m = a.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used
            free[0] = False
            now = a[i0 - 1] - u[i0] - v[1:]
            better = free[1:] & (now < least[1:])
            least[1:][better] = now[better]
            way[1:][better] = j0
            open_ = np.where(free, least, np.inf)
            j1 = int(open_.argmin())
            delta = open_[j1]
            np.add.at(u, match[used], delta)
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((c, r) if flipped else (r, c) for r, c in pairs)


def sparse_assign(rows: np.ndarray, columns: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """As many row and column pairs as possible, at the least total cost, out of the given ones (codes from 0).

    Gives each row's column (-1: left out), the prices of rows and columns, and what leaving a row out
    costs: more than any exchange of matches saves.  Shortest augmenting paths, each a search
    from one row that ends at the nearest free column, or at a row that is cheaper left out.
    Where rows have many of the columns, a path looks at a row's pairs at a time; the steps and sums are the same.
    """
    n, m = int(rows.max()) + 1, int(columns.max()) + 1
    left_out = float(min(n, m) * costs.max() + 1.0)
    order = np.lexsort((columns, rows))
    if len(rows) >= max(16, m // 8) * n:
        return (*_dense_paths(np.searchsorted(rows[order], np.arange(n + 1)), columns[order], costs[order], m, left_out), left_out)
    starts = np.searchsorted(rows[order], np.arange(n + 1)).tolist()
    to, weight = columns[order].astype(np.int32), costs[order]
    u, v, of_row, of_column = [0.0] * n, [0.0] * m, [-1] * n, [-1] * m
    for source in range(n):
        far: dict[int, float] = {}
        came: dict[int, int] = {}
        closed: dict[int, float] = {}
        reached = {source: 0.0}
        heap: list[tuple[float, int]] = []
        row, base, length, end_row, end_column = source, 0.0, np.inf, -1, -1
        while True:
            if base + left_out - u[row] < length:
                length, end_row = base + left_out - u[row], row
            its = slice(starts[row], starts[row + 1])
            for j, w in zip(to[its].tolist(), weight[its].tolist(), strict=True):  # a row at a time, as lists are far larger than arrays
                d = base + w - u[row] - v[j]
                if j not in closed and d < far.get(j, np.inf):
                    far[j], came[j] = d, row
                    heappush(heap, (d, j))
            while heap and (heap[0][1] in closed or heap[0][0] > far[heap[0][1]]):
                heappop(heap)
            if not heap or heap[0][0] >= length:
                break
            base, j = heappop(heap)
            closed[j] = base
            if of_column[j] < 0:
                length, end_row, end_column = base, -1, j
                break
            row = of_column[j]
            reached[row] = base
        for r, d in reached.items():
            u[r] += length - d
        for j, d in closed.items():
            v[j] -= length - d
        # the path turned over, from its end back to the source
        if end_row >= 0:
            j, of_row[end_row] = of_row[end_row], -1
            if end_row == source:
                continue
        else:
            j = end_column
        while True:
            r = came[j]
            before = of_row[r]
            of_row[r], of_column[j] = j, r
            if r == source:
                break
            j = before
    return np.array(of_row), np.array(u), np.array(v), left_out


def _dense_paths(starts: np.ndarray, to: np.ndarray, weight: np.ndarray, m: int, left_out: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``sparse_assign`` by array operations over a row's pairs; each row has a column once at most."""
    n = len(starts) - 1
    u, v, of_row, of_column = np.zeros(n), np.zeros(m), np.full(n, -1), np.full(m, -1)
    for source in range(n):
        far, came, open_ = np.full(m, np.inf), np.full(m, -1), np.full(m, np.inf)  # open_: far of columns not closed
        waits = np.ones(m, bool)
        closed: list[int] = []
        reached, at = [source], [0.0]
        row, base, length, end_row, end_column = source, 0.0, np.inf, -1, -1
        while True:
            if base + left_out - u[row] < length:
                length, end_row = base + left_out - u[row], row
            j = to[starts[row] : starts[row + 1]]
            d = base + weight[starts[row] : starts[row + 1]] - u[row] - v[j]
            nearer = waits[j] & (d < far[j])
            j, d = j[nearer], d[nearer]
            far[j], came[j], open_[j] = d, row, d
            best = int(open_.argmin())
            if open_[best] >= length or open_[best] == np.inf:
                break
            base = float(open_[best])
            waits[best], open_[best] = False, np.inf
            closed.append(best)
            if of_column[best] < 0:
                length, end_row, end_column = base, -1, best
                break
            row = int(of_column[best])
            reached.append(row)
            at.append(base)
        u[reached] += length - np.array(at)
        v[closed] -= length - far[closed]
        if end_row >= 0:
            best, of_row[end_row] = of_row[end_row], -1
            if end_row == source:
                continue
        else:
            best = end_column
        while True:
            r = came[best]
            before = of_row[r]
            of_row[r], of_column[best] = best, r
            if r == source:
                break
            best = before
    return of_row, u, v


def lazy_assign(n: int, m: int, pairs: Callable[[int], tuple[np.ndarray, np.ndarray]], left_out: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``sparse_assign`` over pairs that are never listed: ``pairs`` gives a row's columns, ascending, and their costs (0 or more) whenever asked.

    Rows that are the first at their cheapest column have it from the start; all others are sources of paths.
    left_out must be above what any exchange of matches saves.  Gives each row's column (-1: left out) and the prices of rows and columns.
    """
    u, v, of_row, of_column = np.full(n, left_out), np.zeros(m), np.full(n, -1), np.full(m, -1)
    sources = []
    for row in range(n):
        j, w = pairs(row)
        if len(j):
            k = int(w.argmin())
            u[row] = w[k]
            if of_column[j[k]] < 0:
                of_row[row], of_column[j[k]] = j[k], row
            else:
                sources.append(row)
    far, came, open_, waits = np.full(m, np.inf), np.full(m, -1), np.full(m, np.inf), np.ones(m, bool)  # open_: far of columns not closed
    for source in sources:
        closed: list[int] = []
        reached, at = [source], [0.0]
        row, base, length, end_row, end_column, low, high = source, 0.0, np.inf, -1, -1, m, 0  # columns from low to high are looked at
        while True:
            if base + left_out - u[row] < length:
                length, end_row = base + left_out - u[row], row
            j, w = pairs(row)
            d = base + w - u[row] - v[j]
            nearer = waits[j] & (d < far[j])
            j, d = j[nearer], d[nearer]
            if len(j):
                far[j], came[j], open_[j] = d, row, d
                low, high = min(low, int(j[0])), max(high, int(j[-1]) + 1)
            best = low + int(open_[low:high].argmin())
            if open_[best] >= length or open_[best] == np.inf:
                break
            base = float(open_[best])
            waits[best], open_[best] = False, np.inf
            closed.append(best)
            if of_column[best] < 0:
                length, end_row, end_column = base, -1, best
                break
            row = int(of_column[best])
            reached.append(row)
            at.append(base)
        u[reached] += length - np.array(at)
        v[closed] -= length - far[closed]
        far[low:high], open_[low:high], waits[low:high] = np.inf, np.inf, True
        if end_row >= 0:
            best, of_row[end_row] = int(of_row[end_row]), -1
            if end_row == source:
                continue
        else:
            best = end_column
        while True:
            r = int(came[best])
            before = int(of_row[r])
            of_row[r], of_column[best] = best, r
            if r == source:
                break
            best = before
    return of_row, u, v


def nearest_pairs(f: np.ndarray, g: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``f`` and ``g`` that are taken together, each once: the nearest pair first, of equally near ones that with the least place in ``f``, then in ``g``.

    What lies at one place of the scale is taken from the least on, so only neighbours on the scale can be the nearest pair;
    places that rounding makes equally far are looked at too.
    """
    places, at = np.unique(np.concatenate([f, g]), return_inverse=True)
    here: tuple[list[list[int]], ...] = tuple([[] for _ in places] for _ in range(2))
    for side, codes in enumerate((at[: len(f)], at[len(f) :])):
        for i in range(len(codes) - 1, -1, -1):
            here[side][codes[i]].append(i)  # the least is last
    hz = places.tolist()
    # for each side, the nearest place up and down that still has any of it
    links = [[list(range(1, len(hz) + 1)), list(range(-1, len(hz) - 1))] for _ in range(2)]

    def seek(side: int, way: int, k: int) -> int:
        link, path = links[side][way], []
        while 0 <= k < len(hz) and not here[side][k]:
            path.append(k)
            k = link[k]
        for p in path:
            link[p] = k
        return k

    def offer(k: int) -> tuple[float, int, int, int, int] | None:
        """The nearest pair of the component that is first at a place."""
        if not here[0][k]:
            return None
        best = None
        for way, step in ((0, 1), (1, -1)):
            p = seek(1, way, k)
            while 0 <= p < len(hz):
                apart = abs(hz[k] - hz[p])
                if apart > limit or best is not None and apart > best[0]:
                    break
                found = (apart, here[0][k][-1], here[1][p][-1], k, p)
                best = found if best is None or found < best else best
                p = seek(1, way, p + step)
        return best

    heap = [x for k in range(len(hz)) if (x := offer(k)) is not None]
    heap.sort()
    taken = []
    while heap:
        _, i, j, k, p = heappop(heap)
        if here[0][k] and here[0][k][-1] == i and here[1][p] and here[1][p][-1] == j:
            taken.append((i, j))
            here[0][k].pop()
            here[1][p].pop()
        if (x := offer(k)) is not None:
            heappush(heap, x)
    i, j = np.array(taken, np.int64).reshape(-1, 2).T
    return i, j
