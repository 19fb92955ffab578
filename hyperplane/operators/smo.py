"""Sequential minimal optimisation in one worker, for problems whose kernel matrix or its rows fit there.

The dual: minimise a'Qa / 2 - sum a with 0 <= a <= C and y'a = 0.  Each
iteration moves one pair along (y_i, -y_j) by the analytic step clipped to the
box.  Pairs are chosen by second-order gain, as the maximal violating pair, or
at random with a seed; all end at the same optimum within the gap.  ``platt``
keeps errors of all rows and lets each violating row in turn step with the rows
whose errors are farthest from its own; ``partners`` says how many of them a
row steps with before the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ..functions.kernels import Kernel, squared
from ..functions.sparse import SparseRows

EPS = 1e-3
FLOOR = 1e-12
BLOCK_ROWS = 512
#: Rows up to which the whole kernel matrix is held (8 bytes a cell); beyond, the rows used last, in so many bytes.
WHOLE = 6000
CACHED_BYTES = 512 << 20
#: Steps of a problem of a path before its free rows are solved for at once, times four before each next try, the most such rows
#: in double precision, and the most in single precision with what it leaves solved for again.
LEAP_AFTER, MOST_LEAP, MOST_SINGLE, AGAIN = 20_000, 5500, 7700, 12
#: Rows that may still move, up to which a path steps among these alone, and steps to a turn of it.
MOST_APART, APART_STEPS = 4000, 50_000
#: Lines of a factor that are taken at a time.
PANEL = 256


@dataclass
class Solution:
    alpha: np.ndarray
    gradient: np.ndarray
    rho: float
    objective: float
    gap: float
    iterations: int


class Rows:
    """Rows of the kernel matrix, whole or the last used."""

    def __init__(self, x: np.ndarray | SparseRows, kernel: Kernel, whole: np.ndarray | None = None):
        self.x, self.kernel = x, kernel
        self.squares = squared(x) if isinstance(kernel, Kernel) and not kernel.histogram else None
        self.most = max(2, CACHED_BYTES // (8 * len(x)))
        self.whole, self.kept, self.own = whole, {}, None
        if whole is None and len(x) <= WHOLE:
            # Block by block, as the steps to a kernel value hold blocks beside it.
            self.whole = np.empty((len(x), len(x)))
            for a in range(0, len(x), BLOCK_ROWS):
                self.whole[a : a + BLOCK_ROWS] = self.block(a, a + BLOCK_ROWS)

    def block(self, a: int, b: int) -> np.ndarray:
        if self.squares is None:
            return self.kernel.block(self.x[a:b], self.x)
        return self.kernel.block(self.x[a:b], self.x, (self.squares[a:b], self.squares))

    def __getitem__(self, i: int) -> np.ndarray:
        if self.whole is not None:
            return self.whole[i]
        row = self.kept.pop(i, None)
        if row is None:
            if len(self.kept) >= self.most:
                self.kept.pop(next(iter(self.kept)))
            row = self.block(i, i + 1)[0]
        self.kept[i] = row
        return row

    def diagonal(self) -> np.ndarray:
        if self.own is None:
            whole = self.whole is not None
            self.own = np.diag(self.whole).copy() if whole else np.array([self.kernel.block(self.x[i : i + 1], self.x[i : i + 1])[0, 0] for i in range(len(self.x))])
        return self.own

    def among(self, at: np.ndarray, kind: type = np.float64) -> np.ndarray:
        """The kernel matrix of some rows."""
        out = np.empty((len(at), len(at)), kind)
        for k, i in enumerate(at.tolist()):
            out[k] = self[i][at]
        return out

    def weighed(self, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sums over the rows ``at`` of weight times their kernel rows."""
        out = np.zeros(len(self.x))
        for a in range(0, len(at), BLOCK_ROWS):
            some = at[a : a + BLOCK_ROWS]
            out += weight[a : a + BLOCK_ROWS] @ (self.whole[some] if self.whole is not None else np.stack([self[i] for i in some.tolist()]))
        return out

    def part(self, at: np.ndarray) -> Rows:
        """These of some rows, whole."""
        return Rows(self.x[at], self.kernel, self.among(at))


def _best(value: np.ndarray, tie: str) -> int:
    """Place of the greatest value, or -1 where all are -inf."""
    at = int(value.argmax()) if tie == "first" else len(value) - 1 - int(value[::-1].argmax())
    return at if value[at] > -np.inf else -1


def solve(
    x: np.ndarray | SparseRows, y: np.ndarray, kernel: Kernel, c: float, pairs: str = "second", tie: str = "first", eps: float = EPS, max_iter: int = 1_000_000, seed: int = 0,
    weights: np.ndarray | None = None, start: tuple[np.ndarray, np.ndarray] | None = None, rows: Rows | None = None,
) -> Solution:
    """Trains on rows x with labels +1 and -1; ``weights`` scale C by row; ``start`` are alphas and gradients to go on from, ``rows`` kernel rows that are known.  One class only gives alpha 0."""
    if pairs == "platt":
        return solve_platt(x, y, kernel, c, eps, max_iter, seed, weights, start=start)
    n = len(y)
    y = np.asarray(y, np.float64)
    box = np.full(n, float(c)) * (1 if weights is None else weights)
    alpha, g = (np.zeros(n), -np.ones(n)) if start is None else (start[0].copy(), start[1].copy())
    rows = rows or (Rows(x, kernel) if n else None)
    diag = rows.diagonal() if n else np.zeros(0)
    rng = np.random.default_rng(seed)
    gap, turn = np.inf, 0
    # v = -y g is kept instead of g; 0 or -inf beside it says whether a row may grow or fall, of which a step changes two places.
    v, plus = -y * g, y > 0
    grow = np.where(np.where(plus, alpha < box, alpha > 0), 0.0, -np.inf)
    fall = np.where(np.where(plus, alpha > 0, alpha < box), 0.0, -np.inf)
    one = diag[0] if n and (diag == diag[0]).all() else None
    a, b = np.empty(n), np.empty(n)
    while turn < max_iter and n:
        i = _best(np.add(v, grow, out=a), tie)
        j = _best(np.subtract(fall, v, out=b), tie)
        if i < 0 or j < 0:
            gap = 0.0
            break
        gap = v[i] - v[j]
        if gap < eps:
            break
        if pairs == "second":
            # Gains d**2 / q; those of rows with d <= 0 are 0, below that of the widest pair.
            np.multiply(rows[i], 2, out=a)
            np.subtract(one + one if one is not None else diag[i] + diag, a, out=a)
            np.maximum(a, FLOOR, out=a)
            np.subtract(v[i], v, out=b)
            np.maximum(b, 0, out=b)
            np.multiply(b, b, out=b)
            np.divide(b, a, out=b)
            j = _best(np.add(b, fall, out=b), tie)
        elif pairs == "random":
            at, to = rng.choice(np.flatnonzero(grow == 0)), rng.choice(np.flatnonzero(fall == 0))
            if v[at] > v[to]:
                i, j = int(at), int(to)
        ki, kj = rows[i], rows[j]
        q = max(diag[i] + diag[j] - 2 * ki[j], FLOOR)
        room_i = box[i] - alpha[i] if y[i] > 0 else alpha[i]
        room_j = alpha[j] if y[j] > 0 else box[j] - alpha[j]
        t = min((v[i] - v[j]) / q, room_i, room_j)
        for at, room, sign in ((i, room_i, y[i]), (j, room_j, -y[j])):
            # A step that takes all the room ends exactly on the bound.
            alpha[at] = (box[at] if sign > 0 else 0.0) if t >= room else alpha[at] + sign * t
            room, some = alpha[at] < box[at], alpha[at] > 0
            grow[at], fall[at] = (0.0 if ok else -np.inf for ok in ((room, some) if y[at] > 0 else (some, room)))
        np.subtract(ki, kj, out=a)
        np.multiply(a, t, out=a)
        np.subtract(v, a, out=v)
        turn += 1
    g = -y * v
    return _solution(y, box, alpha, g, float(gap), turn)


def path(x: np.ndarray | SparseRows, y: np.ndarray, kernel: Kernel, cs: list[float], eps: float = EPS, rows: Rows | None = None, max_iter: int = 10_000_000) -> Iterator[Solution]:
    """Solutions for each of some ascending C, each from the one before.

    Once no row is at its C, a greater C changes nothing.  Problems of many steps
    go on among the rows that may still move, and now and then all free rows are
    solved for at once (``leap``).
    """
    rows = rows or (Rows(x, kernel) if len(y) else None)
    s, before = None, None
    for c in cs:
        if s is not None and s.gap < eps and s.alpha.max(initial=0) < before:
            yield s
            continue
        start = None if s is None else (np.minimum(s.alpha * (c / before), c), (s.gradient + 1) * (c / before) - 1)
        s, before = _onward(x, np.asarray(y, np.float64), kernel, c, eps, rows, max_iter, start), c
        yield s


def _onward(x: np.ndarray | SparseRows, y: np.ndarray, kernel: Kernel, c: float, eps: float, rows: Rows | None, max_iter: int, start: tuple[np.ndarray, np.ndarray] | None) -> Solution:
    s = solve(x, y, kernel, c, eps=eps, start=start, rows=rows, max_iter=min(LEAP_AFTER, max_iter))
    turns, next_leap, box = s.iterations, LEAP_AFTER, np.full(len(y), float(c))
    while len(y) and s.gap >= eps and turns < max_iter:
        if turns >= next_leap:
            next_leap *= 4
            if (found := leap(y, c, s.alpha, rows)) is not None:
                s = solve(x, y, kernel, c, eps=eps, start=(found, y * rows.weighed(at := np.flatnonzero(found), (found * y)[at]) - 1), rows=rows, max_iter=LEAP_AFTER)
                turns += s.iterations
                continue
        v = -y * s.gradient
        grow, fall = np.where(y > 0, s.alpha < c, s.alpha > 0), np.where(y > 0, s.alpha > 0, s.alpha < c)
        may = np.flatnonzero((grow & (fall | (v > v[fall].min()))) | (fall & (v < v[grow].max())))
        steps = min(APART_STEPS, max_iter - turns)
        if len(may) > MOST_APART:
            s = solve(x, y, kernel, c, eps=eps, start=(s.alpha, s.gradient), rows=rows, max_iter=steps)
        else:
            # To a gap below that of all rows, as some that rest will move again.
            got = solve(x[may], y[may], kernel, c, eps=eps / 2, start=(s.alpha[may], s.gradient[may]), rows=rows.part(may), max_iter=steps)
            alpha, moved = s.alpha.copy(), np.flatnonzero(got.alpha != s.alpha[may])
            step = (got.alpha[moved] - alpha[may[moved]]) * y[may[moved]]
            alpha[may] = got.alpha
            g = s.gradient + y * rows.weighed(may[moved], step)
            s = _solution(y, box, alpha, g, _gap(y, box, alpha, g), got.iterations)
            if not s.iterations:
                s = solve(x, y, kernel, c, eps=eps, start=(alpha, g), rows=rows, max_iter=steps)
        turns += max(s.iterations, 1)
    s.iterations = turns
    return s


def leap(y: np.ndarray, c: float, alpha: np.ndarray, rows: Rows) -> np.ndarray | None:
    """The optimal alphas, by solving for all rows between the bounds and moving rows to and from these, as long as ever fewer move;
    None where that does not end."""
    low, high = np.where(y > 0, 0.0, -c), np.where(y > 0, c, 0.0)
    s, free, before = y * alpha, (alpha > 0) & (alpha < c), len(y) + 1
    while True:
        at = np.flatnonzero(free)
        if not 0 < len(at) <= MOST_SINGLE:
            return None
        fixed = np.flatnonzero(~free & (s != 0))
        held = rows.weighed(fixed, s[fixed])
        try:
            of_one, of_rest = _solved(rows, at, np.stack([np.ones(len(at)), (y - held)[at]], 1)).T
        except np.linalg.LinAlgError:
            return None
        bias = (of_rest.sum() + s[fixed].sum()) / of_one.sum()
        s[at] = of_rest - bias * of_one
        left = y - held - rows.weighed(at, s[at]) - bias
        above, below = free & (s > high), free & (s < low)
        s[above], s[below] = high[above], low[below]
        now = (free & ~above & ~below) | (~free & np.where(s <= low, left > EPS / 4, left < -EPS / 4))
        moved = int((now != free).sum())
        if not moved:
            return np.clip(y * s, 0, c)
        if moved >= before:
            return None
        free, before = now, moved


def _solved(rows: Rows, at: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of K x = b for the kernel matrix of the rows ``at``."""
    if len(at) <= MOST_LEAP:
        return substituted(factor(rows.among(at)), b)
    whole, out, left = factor(rows.among(at, np.float32)), np.zeros_like(b), b
    for _ in range(AGAIN):
        out += substituted(whole, left.astype(np.float32))
        left = b - np.stack([rows.weighed(at, o)[at] for o in out.T], 1)
        if np.abs(left).max() < EPS / 1000:
            return out
    raise np.linalg.LinAlgError("single precision is too coarse for these rows")


def _panels(n: int) -> list[slice]:
    return [slice(k, min(k + PANEL, n)) for k in range(0, n, PANEL)]


def factor(a: np.ndarray) -> np.ndarray:
    """The lower Cholesky factor of a, in the place of a, a panel at a time; what is above the diagonal has no meaning."""
    panels = _panels(len(a))
    for k, q in enumerate(panels):
        a[q, q] = np.linalg.cholesky(a[q, q])
        below = slice(q.stop, len(a))
        a[below, q] = a[below, q] @ np.linalg.inv(a[q, q]).T
        for r in panels[k + 1 :]:
            a[r.start :, r] -= a[r.start :, q] @ a[r, q].T
    return a


def substituted(lower: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of a x = b from the ``factor`` of a."""
    out = b.copy()
    for q in _panels(len(out)):
        out[q] = np.linalg.solve(lower[q, q], out[q])
        out[q.stop :] -= lower[q.stop :, q] @ out[q]
    for q in reversed(_panels(len(out))):
        out[q] = np.linalg.solve(lower[q, q].T, out[q] - lower[q.stop :, q].T @ out[q.stop :])
    return out


def _solution(y: np.ndarray, box: np.ndarray, alpha: np.ndarray, g: np.ndarray, gap: float, turn: int) -> Solution:
    """The bias is the mean of y g over free rows, or else the middle of what rows at the bounds allow."""
    free = (alpha > 0) & (alpha < box)
    yg = y * g
    if free.any():
        rho = float(yg[free].mean())
    else:
        high = yg[np.where(y > 0, alpha <= 0, alpha >= box)]
        under = yg[np.where(y > 0, alpha >= box, alpha <= 0)]
        ends = [*([high.min()] if len(high) else []), *([under.max()] if len(under) else [])]
        rho = float(np.mean(ends)) if ends else 0.0
    return Solution(alpha, g, rho, float((alpha * (g - 1)).sum() / 2), gap, turn)


def _gap(y: np.ndarray, box: np.ndarray, alpha: np.ndarray, g: np.ndarray) -> float:
    v = -y * g
    up, low = np.where(y > 0, alpha < box, alpha > 0), np.where(y > 0, alpha > 0, alpha < box)
    return float(v[up].max() - v[low].min()) if up.any() and low.any() else 0.0


def solve_platt(
    x: np.ndarray | SparseRows, y: np.ndarray, kernel: Kernel, c: float, tol: float = 0.01, max_iter: int = 1_000_000, seed: int = 0, weights: np.ndarray | None = None, partners: int = 1,
    start: tuple[np.ndarray, np.ndarray] | None = None,
) -> Solution:
    """Platt's way: sweeps over all rows, then over free rows until these rest, then over all again.

    A row whose error breaks its conditions by more than ``tol`` steps with the
    rows of the most different errors, up to ``partners`` of them; if none of
    these moves, with free rows and then all rows from a random place on.
    """
    n = len(y)
    y = np.asarray(y, np.float64)
    box = np.full(n, float(c)) * (1 if weights is None else weights)
    alpha, g = (np.zeros(n), -np.ones(n)) if start is None else (start[0].copy(), start[1].copy())
    if not n:
        return _solution(y, box, alpha, g, 0.0, 0)
    rows, rng, turn = Rows(x, kernel), np.random.default_rng(seed), 0
    diag = rows.diagonal()
    bias = 0.0 if start is None else _solution(y, box, alpha, g, 0.0, 0).rho

    def step(i: int, j: int) -> bool:
        """Moves alphas i and j along (y_i, -y_j) to the least of the objective, if that is far enough."""
        nonlocal bias, turn
        if i == j:
            return False
        ki, kj = rows[i], rows[j]
        q = max(diag[i] + diag[j] - 2 * ki[j], FLOOR)
        t = (y[j] * g[j] - y[i] * g[i]) / q
        low = max(-alpha[i] if y[i] > 0 else alpha[i] - box[i], alpha[j] - box[j] if y[j] > 0 else -alpha[j])
        high = min(box[i] - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else box[j] - alpha[j])
        t = min(max(t, low), high)
        if abs(t) < 1e-10 * (box[i] + 1):
            return False
        for at, sign in ((i, y[i]), (j, -y[j])):
            moved = alpha[at] + sign * t
            alpha[at] = 0.0 if moved < 1e-12 * box[at] else box[at] if moved > box[at] * (1 - 1e-12) else moved
        g[:] += y * (ki - kj) * t
        # The new bias makes the error of a free one of the two zero.
        free = [at for at in (i, j) if 0 < alpha[at] < box[at]]
        bias = float(np.mean([y[at] * g[at] for at in free or (i, j)]))
        turn += 1
        return True

    def moving(i: int, pool: np.ndarray) -> int | None:
        """The first of the pool with which a step of row i is far enough, from row i of the kernel matrix alone."""
        q = np.maximum(diag[i] + diag[pool] - 2 * rows[i][pool], FLOOR)
        plus, a = y[pool] > 0, alpha[pool]
        room = box[pool] - a
        low = np.maximum(-alpha[i] if y[i] > 0 else alpha[i] - box[i], np.where(plus, -room, -a))
        high = np.minimum(box[i] - alpha[i] if y[i] > 0 else alpha[i], np.where(plus, a, room))
        t = np.minimum(np.maximum((y[pool] * g[pool] - y[i] * g[i]) / q, low), high)
        far = (np.abs(t) >= 1e-10 * (box[i] + 1)) & (pool != i)
        return int(pool[far.argmax()]) if far.any() else None

    def examine(i: int) -> bool:
        slack = g[i] - y[i] * bias
        if not (slack < -tol and alpha[i] < box[i] or slack > tol and alpha[i] > 0):
            return False
        error = y * g
        free = np.flatnonzero((alpha > 0) & (alpha < box))
        pool = free if len(free) > 1 else np.arange(n)
        apart = np.abs(error[pool] - error[i])
        far = pool[[apart.argmax()] if partners == 1 else np.argsort(-apart, kind="stable")[:partners]]
        if sum([step(i, int(j)) for j in far]):
            return True
        for pool in (free, np.arange(n)):
            if len(pool) and (j := moving(i, np.roll(pool, -int(rng.integers(len(pool)))))) is not None:
                return step(i, j)
        return False

    every, moved = True, True
    while (moved or every) and turn < max_iter:
        todo = range(n) if every else np.flatnonzero((alpha > 0) & (alpha < box))
        moved = sum(examine(int(i)) for i in todo) > 0
        # Free rows rest: all rows once more; those rest as well: done.
        if every and not moved:
            break
        every = not moved
    return _solution(y, box, alpha, g, _gap(y, box, alpha, g), turn)


def decide(x: np.ndarray | SparseRows, support: np.ndarray | SparseRows, coefficients: np.ndarray, kernel: Kernel, rho: float) -> np.ndarray:
    """Decision values of rows x: sum of coefficients (alpha y) times kernel values, less rho."""
    return (kernel.block(x, support) @ coefficients if len(support) else np.zeros(len(x))) - rho
