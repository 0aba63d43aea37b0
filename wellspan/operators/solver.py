"""Small dense solves that a task does for one producer at a time: bounded least squares and the search of a time constant."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Gradient, on unknowns scaled to unit columns, below which a bound is taken as right.
SLACK = 1e-10
#: Resources that a block of their matrix holds at least; numbers that its blocks hold at most.
PIECE, CHAINED = 256, 20_000_000


def bounded_least_squares(g: np.ndarray, r: np.ndarray, hi: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(x, slack): the least x'Gx - 2r'x over 0 <= x <= hi by an active set, and how far x is from optimal.

    Unknowns wait at a bound or are free. The free ones are solved exactly, and a step that leaves the box stops at the first bound
    it meets; then the unknown whose gradient points inwards most is freed. The objective falls with every step, so no set
    of free unknowns comes back and the loop ends by itself. Unknowns without data (zero diagonal) stay at zero. ``start``, the
    solution of a like problem, saves steps.
    """
    k = len(r)
    d = np.sqrt(np.maximum(np.diagonal(g), 0.0))
    live = d > 0
    if not live.any():
        return np.zeros(k), 0.0
    scale = np.where(live, d, 1.0)
    gs, rs, top = g / np.outer(scale, scale), r / scale, hi * scale
    size = max(1.0, float(np.abs(rs).max()))
    x = np.zeros(k) if start is None else np.where(live, np.clip(start * scale, 0.0, top), 0.0)
    free = (x > 0) & (x < top)
    shut, chosen, least = ~live, -1, np.inf  # those freed without any gain at this point
    while True:
        while free.any():
            at = np.flatnonzero(free)
            part = gs[at]
            want = rs[at] - part @ np.where(free, 0.0, x)
            try:
                z = np.linalg.solve(part[:, at], want)
            except np.linalg.LinAlgError:
                z = np.full(len(at), np.nan)
            if not np.isfinite(z).all():
                z = np.linalg.lstsq(part[:, at], want, rcond=None)[0]
            step = z - x[at]
            out = (z < 0) | (z > top[at])
            if not out.any():
                x[at] = z
                break
            reach = np.full(len(at), np.inf)
            reach[out] = np.where(z[out] < 0, x[at[out]], top[at[out]] - x[at[out]]) / np.abs(step[out])
            share = float(np.clip(reach.min(), 0.0, 1.0))
            x[at] = np.clip(x[at] + share * step, 0.0, top[at])
            hit = out & (reach <= reach.min())
            x[at[hit]] = np.where(z[hit] < 0, 0.0, top[at[hit]])
            free[at[hit]] = False
        w = rs - gs @ x
        value = -float(x @ (w + rs))
        if chosen >= 0:
            fell = value < least - 1e-14 * max(1.0, abs(value))
            shut = ~live if fell else shut | (np.arange(k) == chosen)
        least = min(least, value)
        pull = np.where(x <= 0, w, np.where(x >= top, -w, 0.0))
        pull[free | shut] = 0.0
        chosen = int(np.argmax(pull))
        if pull[chosen] <= SLACK * size:
            break
        free[chosen] = True
    off = np.where(x <= 0, np.maximum(w, 0.0), np.where(x >= top, np.maximum(-w, 0.0), np.abs(w)))
    return x / scale, float(off[live].max()) / size


@dataclass
class History:
    """A producer from its start: steps, days since the start, step lengths, whether open, liquid, weights, training rows,
    initial rate, rates of its injectors by row, and the pressure slope or None."""

    t: np.ndarray
    dt: np.ndarray
    on: np.ndarray
    liq: np.ndarray
    w: np.ndarray
    train: np.ndarray
    q0: float
    rates: np.ndarray
    dpdt: np.ndarray | None = None


def filtered(sources: np.ndarray, dt: np.ndarray, moves: np.ndarray, taus: np.ndarray) -> np.ndarray:
    """[taus, sources, steps]: every source behind every time constant; steps that do not move keep the state."""
    decay = np.exp(-dt[None, :] / taus[:, None])
    kept, added = decay.T[:, :, None], ((1.0 - decay)[:, None, :] * sources[None]).transpose(2, 0, 1).copy()
    x = np.zeros((len(taus), len(sources)))
    out = np.zeros((sources.shape[1], len(taus), len(sources)))
    for n in range(1, sources.shape[1]):
        if moves[n]:
            x = x * kept[n] + added[n]
        out[n] = x
    return np.ascontiguousarray(out.transpose(1, 2, 0))


def normal_equations(h: History, taus: np.ndarray, freeze: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram matrices, right sides and squares of the weighted training rows for every time constant; the pressure term is last."""
    sources = h.rates if h.dpdt is None else np.vstack([h.rates, h.dpdt])
    c = filtered(sources, h.dt, h.on if freeze else np.ones(len(h.dt), bool), taus)
    if h.dpdt is not None:
        c[:, -1] *= -taus[:, None]
    y = h.liq[None, :] - h.q0 * np.exp(-h.t[None, :] / taus[:, None])
    w = np.where(h.train, h.w, 0.0)
    cw, yw = c * w, y * w
    return cw @ cw.transpose(0, 2, 1), np.einsum("tkn,tn->tk", cw, yw), np.einsum("tn,tn->t", yw, yw)


def same_bounds(g: np.ndarray, r: np.ndarray, hi: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(solutions, slacks, n) of like problems, of which the first n are optimal with the unknowns at the bounds where ``x`` has them.

    One call solves them all; a problem from the n-th on needs other bounds."""
    none = np.zeros(r.shape), np.zeros(len(r)), 0
    d = np.sqrt(np.maximum(np.diagonal(g, axis1=1, axis2=2), 0.0))
    live = d[0] > 0
    if not live.any() or ((d > 0) != live).any():
        return none
    scale = np.where(live, d, 1.0)
    gs, rs, top = g / (scale[:, :, None] * scale[:, None, :]), r / scale, hi * scale
    high = live & (x >= hi)
    at = np.flatnonzero(live & (x > 0) & ~high)
    out = np.where(high, top, 0.0)
    if len(at):
        try:
            out[:, at] = np.linalg.solve(gs[:, at[:, None], at], (rs[:, at] - (gs[:, at] @ out[:, :, None])[:, :, 0])[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:
            return none
    size = np.maximum(1.0, np.abs(rs).max(axis=1))
    with np.errstate(invalid="ignore"):
        inside = np.isfinite(out).all(axis=1) & ((out >= 0) & (out <= top)).all(axis=1)
        w = rs - (gs @ out[:, :, None])[:, :, 0]
    off = np.where(out <= 0, np.maximum(w, 0.0), np.where(out >= top, np.maximum(-w, 0.0), np.abs(w)))
    bound = live.copy()
    bound[at] = False
    right = inside & ~(off[:, bound] > SLACK * size[:, None]).any(axis=1)
    return out / scale, off[:, live].max(axis=1) / size, len(right) if right.all() else int(np.argmin(right))


def solved(h: History, taus: np.ndarray, top: np.ndarray, freeze: bool, start: np.ndarray | None = None) -> list[tuple[float, float, np.ndarray, float]]:
    """(error, time constant, unknowns, slack) of each time constant; neighbours mostly have the same unknowns at the bounds.
    ``start`` is the solution of a time constant near by."""
    g, r, yy = normal_equations(h, taus, freeze)
    xs, slacks, k, x = np.zeros(r.shape), np.zeros(len(r)), 0, start
    while k < len(taus):
        if x is not None:
            more, off, n = same_bounds(g[k:], r[k:], top, x)
            if n:
                xs[k : k + n], slacks[k : k + n], x = more[:n], off[:n], more[n - 1]
                k += n
        if k < len(taus):
            x, slacks[k] = bounded_least_squares(g[k], r[k], top, x)
            xs[k] = x
            k += 1
    return [(max(float(e - 2 * b @ x + x @ a @ x), 0.0), float(tau), x, float(slack)) for tau, a, b, e, x, slack in zip(taus, g, r, yy, xs, slacks)]


def best_fit(h: History, lo: float, hi: float, points: int, freeze: bool = True, fine: float = 1e-4) -> tuple[float, float, np.ndarray, float]:
    """(error, time constant, unknowns, slack): a grid over the range, then finer grids in every cell where the error has a dip,
    until the step is ``fine`` in the logarithm."""
    top = np.ones(len(h.rates)) if h.dpdt is None else np.append(np.ones(len(h.rates)), np.inf)
    grid = np.exp(np.linspace(np.log(lo), np.log(hi), points))
    first = solved(h, grid, top, freeze)
    errors = [s[0] for s in first]
    best = min(first, key=lambda s: s[:2])
    for k, e in enumerate(errors):
        if e > min(errors[max(k - 1, 0)], errors[min(k + 1, points - 1)]):
            continue
        left, right, near = np.log(grid[max(k - 1, 0)]), np.log(grid[min(k + 1, points - 1)]), first[k][2]
        while right - left > fine:
            inner = np.linspace(left, right, points)
            found = solved(h, np.exp(inner), top, freeze, near)
            at = min(range(points), key=lambda i: found[i][:2])
            near = found[at][2]
            best = min(best, found[at], key=lambda s: s[:2])
            left, right = inner[max(at - 1, 0)], inner[min(at + 1, points - 1)]
    return best


def in_levels(at: np.ndarray, m: int) -> list[np.ndarray]:
    """The m resources cut into pieces of ``PIECE`` or more, so that a problem's resources lie in one piece or in two that follow.

    Pieces are levels of a walk from a resource to those that share a problem with it. It starts at the far end of a first walk,
    so that levels stay narrow where problems share only with problems near by."""
    if m <= PIECE:
        return [np.arange(m)]
    rows, slots = np.nonzero(at >= 0)
    order = np.argsort(at[rows, slots], kind="stable")
    owners, bounds = rows[order], np.searchsorted(at[rows, slots][order], np.arange(m + 1))

    def walk(start: int, seen: np.ndarray) -> list[np.ndarray]:
        now, levels, used = np.array([start]), [], np.zeros(len(at), bool)
        seen[start] = True
        while len(now):
            levels.append(now)
            met = np.concatenate([owners[bounds[i] : bounds[i + 1]] for i in now.tolist()])
            met = np.unique(met[~used[met]])
            used[met] = True
            now = np.unique(at[met])
            now = now[now >= 0]
            now = now[~seen[now]]
            seen[now] = True
        return levels

    seen, pieces, held = np.zeros(m, bool), [], []
    for start in range(m):
        if seen[start]:
            continue
        far = walk(start, seen.copy())[-1][0]
        for level in walk(int(far), seen):
            held.append(level)
            if sum(map(len, held)) >= PIECE:
                pieces.append(np.concatenate(held))
                held = []
    return [*pieces, np.concatenate(held)] if held else pieces


class Chain:
    """A positive definite matrix over resources whose problems join each piece of ``in_levels`` only to itself and the next one."""

    def __init__(self, at: np.ndarray, pieces: list[np.ndarray]):
        self.pieces, sizes = pieces, np.array([len(p) for p in pieces])
        m = int(sizes.sum())
        piece, place = np.full(m + 1, -9), np.zeros(m + 1, int)
        for b, p in enumerate(pieces):
            piece[p], place[p] = b, np.arange(len(p))
        self.shapes = [(n, n) for n in sizes.tolist()] + list(zip(sizes[1:].tolist(), sizes[:-1].tolist()))  # on the diagonal, then below it
        self.edges = np.concatenate(([0], np.cumsum([a * b for a, b in self.shapes])))
        to = np.where(at >= 0, at, m)
        (a, pa), (b, pb) = ((piece[to][:, :, None], place[to][:, :, None]), (piece[to][:, None, :], place[to][:, None, :]))
        block = np.where(a == b, a, np.where(a == b + 1, len(pieces) + b, -1))
        block[(a < 0) | (b < 0)] = -1
        self.cells = np.where(block >= 0, self.edges[block] + pa * sizes[np.maximum(b, 0)] + pb, self.edges[-1]).ravel()

    def factor(self, values: np.ndarray, root: np.ndarray) -> None:
        """Take 1 + root J root, where J adds up the problems' ``values``."""
        flat = np.bincount(self.cells, values.ravel(), self.edges[-1] + 1)
        blocks = [flat[a:b].reshape(s) for a, b, s in zip(self.edges, self.edges[1:], self.shapes)]
        roots, n = [root[p] for p in self.pieces], len(self.pieces)
        self.below = [blocks[n + b] * roots[b + 1][:, None] * roots[b] for b in range(n - 1)]
        self.inverse = []
        for b in range(n):
            own = np.eye(len(roots[b])) + roots[b][:, None] * blocks[b] * roots[b]
            if b:
                own -= self.below[b - 1] @ self.inverse[-1] @ self.below[b - 1].T
            self.inverse.append(np.linalg.inv(own))

    def solve(self, v: np.ndarray) -> np.ndarray:
        parts, out = [], np.zeros(len(v))
        for b, p in enumerate(self.pieces):
            parts.append(v[p] - (self.below[b - 1] @ (self.inverse[b - 1] @ parts[-1]) if b else 0.0))
        for b in reversed(range(len(parts))):
            x = self.inverse[b] @ (parts[b] - (self.below[b].T @ x if b + 1 < len(parts) else 0.0))
            out[self.pieces[b]] = x
        return out


def shared_least_squares(g: np.ndarray, r: np.ndarray, at: np.ndarray, bound: float, rounds: int = 100) -> tuple[np.ndarray, float]:
    """(x, gap): the least sum of x'Gx - 2r'x over many small problems with 0 <= x <= 1, where all unknowns of one resource add
    up to ``bound`` at most, and how far that sum can be from the least one.

    g: [problems, k, k], r: [problems, k], at: [problems, k], the resource of each unknown, -1 for padding. An interior point method: each
    of at most ``rounds`` steps solves the problems by themselves and joins them by a matrix over the resources, a chain of blocks. Unknowns
    without data (zero diagonal) stay at zero. Raises MemoryError where the blocks hold more than ``CHAINED`` numbers.
    """
    k, m = at.shape[1], int(at.max(initial=-1)) + 1
    d = np.diagonal(g, axis1=1, axis2=2)
    live, size = (at >= 0) & (d > 0), float(d.max(initial=0.0))
    if not live.any():
        return np.zeros(r.shape), 0.0
    both, eye, to = live[:, :, None] & live[:, None, :], np.eye(k), np.where(live, at, m)
    q, lin = np.where(both, 2 * g / size, 0.0) + eye * ~live[:, :, None], 2 * r / size
    total = lambda v: np.bincount(to.ravel(), np.where(live, v, 0.0).ravel(), m + 1)[:m]
    spread = lambda p: np.where(live, np.append(p, 0.0)[to], 0.0)
    pieces = in_levels(np.where(live, at, -1), m)
    if sum(len(p) * (len(p) + len(q)) for p, q in zip(pieces, [*pieces[1:], pieces[-1]])) > CHAINED:
        raise MemoryError("problems share too widely to be joined in one task")
    chain = Chain(np.where(live, at, -1), pieces)
    x = np.where(live, np.minimum(0.5, spread(0.5 * bound / np.maximum(total(live), 1))), 0.5)
    # distances to the bounds are kept by themselves, as differences lose their digits where little is left
    room, left = 1 - x, bound - total(x)
    low, high, price = np.where(live, 1.0, 0.0), np.where(live, 1.0, 0.0), np.ones(m)
    slope = lambda x: np.where(live, (q @ x[:, :, None])[:, :, 0] - lin + spread(price) - low + high, 0.0)
    n = 2 * int(live.sum()) + m
    for _ in range(rounds):
        off = slope(x)
        mu = float((low * x).sum() + (high * room).sum() + price @ left) / n
        if mu < 1e-12:
            break
        inverse = np.linalg.inv(q + eye * np.where(live, low / x + high / room, 0.0)[:, :, None])
        root = np.sqrt(price / left)
        chain.factor(np.where(both, inverse, 0.0), root)

        def step(aim, second):
            """Towards products of ``aim`` of all multipliers and distances, less their second order terms."""
            a, b, c = (aim - e for e in second)
            want = np.where(live, -off - low + a / x + high - b / room, 0.0) - spread(c / left - price)
            y = (inverse @ want[:, :, None])[:, :, 0]
            v = root * chain.solve(root * total(y))
            dx, ds = np.where(live, y - (inverse @ spread(v)[:, :, None])[:, :, 0], 0.0), v / root**2
            return dx, ds, np.where(live, (a - low * dx) / x - low, 0.0), np.where(live, (b + high * dx) / room - high, 0.0), (c + price * ds) / left - price

        def reach(dx, ds, dl, dh, dp):
            falls = ((x, dx), (room, -dx), (left, -ds), (low, dl), (high, dh), (price, dp))
            return min([1.0, *(float((-v[e < 0] / e[e < 0]).min(initial=np.inf)) for v, e in falls)])

        dx, ds, dl, dh, dp = first = step(0.0, (0.0, 0.0, 0.0))
        far = reach(*first)
        then = float(((low + far * dl) * (x + far * dx) * live).sum() + ((high + far * dh) * (room - far * dx)).sum() + (price + far * dp) @ (left - far * ds)) / n
        dx, ds, dl, dh, dp = move = step(mu * min(1.0, max(then / mu, 0.0)) ** 3, (dl * dx, -dh * dx, -dp * ds))
        far = 0.995 * reach(*move)
        x, room, left, low, high, price = x + far * dx, room - far * dx, left - far * ds, low + far * dl, high + far * dh, price + far * dp
    x = np.where(live & ((x > low) | (x > 1e-6)), np.clip(x, 0.0, 1.0), 0.0)
    x = x * np.where(live, np.append(np.minimum(1.0, bound / np.maximum(total(x), 1e-300)), 1.0)[to], 1.0)
    # what the multipliers certify: the Lagrange function is convex, and its slope is nearly zero
    gap = (low * x).sum() + (high * (1 - x)).sum() + price @ np.maximum(bound - total(x), 0.0) + np.abs(slope(x)).sum()
    return x, float(gap) * size
