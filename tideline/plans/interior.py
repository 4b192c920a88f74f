"""Convex quadratics with non-smooth terms by interior steps, as exact for values of any size.

``min 1/2 v'Pv - goal'v + sum over rows of max over s in [low, high] of s w - curve s^2 / 2``, where
``w = K v - shift``: absolute values, one-sided bounds and all residual losses but squares are of this
form. Predictor and corrector steps follow the central path; each is one solve of ``P + K'WK``.
"""

from __future__ import annotations

import numpy as np

#: Steps at most; what may be left of each condition, over the size of its terms, to end and to count as solved.
#: All that is left of the gap can lie in one row, whose force is off by the root of it: it must be far below rounding.
STEPS, NEAR, SOLVED = 100, 1e-17, 1e-7


def one_sided(terms: list) -> list:
    """``terms`` (place, rows, kind, param) with each box as one row for each of its finite ends."""
    out = []
    for s, k, kind, param in terms:
        if kind == "box":
            ends = ((param[0], np.inf), (-np.inf, param[1]))
            out += [(s, k, kind, end) for end in ends if np.isfinite(end).any()]
        else:
            out.append((s, k, kind, param))
    return out


def has_rows(terms: list) -> bool:
    """Whether all terms are sums over rows; the norm of falls is not."""
    return all(kind != "falls" for _, _, kind, _ in terms)


def _bounds(kind: str, param: object, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """low, high, shift and curve of a term's rows."""
    low, high, shift, curve = -np.inf, np.inf, 0.0, 0.0
    if kind == "l1":
        low, high = -param, param
    elif kind == "sign":
        low, high = (low, 0.0) if param > 0 else (0.0, high)
    elif kind == "box":
        low, high, shift = (low, 0.0, param[0]) if np.isfinite(param[0]) else (0.0, high, param[1])
    else:
        shift, loss, m, scale = param  # rows are the fit, so that w is the residual with its sign changed
        if loss == "l1":
            low, high = -scale, scale
        elif loss == "huber":
            low, high, curve = -2 * scale * m, 2 * scale * m, 1 / (2 * scale)
        else:
            low, high = -2 * scale * m, 2 * scale * (1 - m)
    return tuple(np.broadcast_to(np.asarray(x, float), count).copy() for x in (low, high, shift, curve))


def interior(system: object, goal: np.ndarray, terms: list, constant: float, typical: float) -> tuple[np.ndarray, bool]:
    """The coefficients, and whether all conditions hold to ``SOLVED``.

    ``constant``: the objective at 0 of what has no rows; ``typical``: the size of the values, by which all is divided.
    """
    unit, size = system.unit, typical or 1.0
    goal, constant = goal * unit / size, constant / size**2
    low, high, shift, curve = (np.concatenate(x) for x in zip(*[_bounds(kind, param, k.shape[0]) for _, k, kind, param in terms], strict=True))
    low, high, shift = low / size, high / size, shift / size
    real = high > low  # terms of no weight bind nothing
    up, down = np.isfinite(high) & real, np.isfinite(low) & real
    both = up & down
    count = int(up.sum() + down.sum())
    ridge = 1e-14 * (system.trace_pen + system.trace_gram) / system.size
    if not count:
        v = np.zeros(system.size)
        start = system.factor(np.zeros(len(low)), ridge)
        for _ in range(10):
            v = v + start(goal - system.penalty(v))
        return v * unit * size, True
    weight = np.where(real, system.trace_pen / system.trace_gram + 1e-3, 0.0)
    v = system.factor(weight, ridge)(goal + system.back(weight * shift))
    w = system.forward(v) - shift
    half, middle = np.where(both, (high - low) / 2, 1.0), np.where(both, (high + low) / 2, 0.0)
    mu = max(float((np.abs(w) * half)[both].mean()) if both.any() else 0.0, 0.1 * abs(float(goal @ v)) / count, 1e-12)
    with np.errstate(invalid="ignore"):
        s = np.where(both, middle + half**2 * w / (mu + np.sqrt(mu**2 + (w * half) ** 2)), 0.0)
        aside = mu / np.maximum(np.abs(w), np.sqrt(mu))
        s = np.where(up & ~down, high - aside, np.where(down & ~up, low + aside, s))
        over, under = np.where(up, high - s, 1.0), np.where(down, s - low, 1.0)
    p, m = np.where(up, mu / over, 0.0), np.where(down, mu / under, 0.0)
    best, kept = np.inf, v

    for _ in range(STEPS):
        w = system.forward(v) - shift
        at_v, at_s = system.penalty(v), system.back(s)
        r1, r2 = at_v - goal + at_s, np.where(real, w - curve * s - p + m, 0.0)
        gap = float((p * over)[up].sum() + (m * under)[down].sum())
        mu = gap / count
        free = np.clip(np.divide(w, curve, out=np.zeros_like(w), where=curve > 0), low, high, out=np.zeros_like(w), where=curve > 0)
        with np.errstate(invalid="ignore"):
            rows = np.where(curve > 0, free * w - curve * free**2 / 2, np.where(both, np.maximum(high * w, low * w), 0.0))
        objective = abs(float(0.5 * v @ at_v - goal @ v + constant + rows.sum()))
        # a force far below the values is known no closer than their rounding
        force = max(np.abs(goal).max(), np.abs(at_s).max(), np.abs(at_v).max(), 2e-5 * np.abs(v).max(), 1e-300)
        spread = max(np.abs(w).max(), 1e-300)
        left = max(gap / max(objective, 1e-16), np.abs(r1).max() / force, np.abs(r2).max() / spread)
        ended = gap <= NEAR * objective and not left < best / 2  # only rounding is left
        if left < 2 * best:  # of steps alike but for rounding the last has the least gap
            best, kept = min(left, best), v
        if left <= NEAR or ended or not np.isfinite(left):
            break
        stiff = np.where(real, curve + p / over + m / under, 1.0)
        weight = np.where(real, 1 / stiff, 0.0)
        try:
            solve = system.factor(weight, ridge)
        except np.linalg.LinAlgError:
            break

        def move(comp_p: np.ndarray, comp_m: np.ndarray) -> tuple[np.ndarray, ...]:
            rho = r2 - comp_p / over + comp_m / under
            dv, ds, e1, e2, error = np.zeros(system.size), np.zeros(len(s)), -r1, -rho, np.inf
            # what rounding left of both equations, as long as it shrinks; ``ds`` from ``dv`` alone would be off by the weight times its rounding
            for _ in range(4):
                more = solve(e1 + system.back(weight * e2))
                new_v, new_s = dv + more, ds + weight * (system.forward(more) - e2)
                e1 = -r1 - system.penalty(new_v) - system.back(new_s)
                e2 = np.where(real, stiff * new_s - system.forward(new_v) - rho, 0.0)
                before, error = error, max(np.abs(e1).max() / force, np.abs(e2).max() / spread)
                if not error < before:
                    break
                dv, ds = new_v, new_s
                if error < 1e-15:
                    break
            return dv, ds, np.where(up, (comp_p + p * ds) / over, 0.0), np.where(down, (comp_m - m * ds) / under, 0.0)

        def reach(ds: np.ndarray, dp: np.ndarray, dm: np.ndarray) -> float:
            ratios = [(x[on], d[on]) for x, d, on in ((over, -ds, up), (under, ds, down), (p, dp, up), (m, dm, down))]
            return min([1.0, *[float((-x[d < 0] / d[d < 0]).min()) for x, d in ratios if (d < 0).any()]])

        _, ds, dp, dm = move(np.where(up, -p * over, 0.0), np.where(down, -m * under, 0.0))
        a = reach(ds, dp, dm)
        after = float(((p + a * dp) * (over - a * ds))[up].sum() + ((m + a * dm) * (under + a * ds))[down].sum()) / count
        centre = mu * min(max(after / mu, 0.0), 1.0) ** 3
        dv, ds, dp, dm = move(np.where(up, centre - p * over + dp * ds, 0.0), np.where(down, centre - m * under - dm * ds, 0.0))
        a = reach(ds, dp, dm)
        a = a if a == 1.0 else 0.99 * a if a < 0.9 else 0.999 * a
        if not np.isfinite(dv).all():
            break
        v, s, p, m = v + a * dv, np.where(real, s + a * ds, 0.0), p + a * dp, m + a * dm
        over, under = np.where(up, over - a * ds, 1.0), np.where(down, under + a * ds, 1.0)
        if min(over.min(), under.min()) <= 0 or (p[up] <= 0).any() or (m[down] <= 0).any():
            over, under, p, m = np.maximum(over, 1e-300), np.maximum(under, 1e-300), np.where(up, np.maximum(p, 1e-300), 0.0), np.where(down, np.maximum(m, 1e-300), 0.0)
    return kept * unit * size, best <= SOLVED
