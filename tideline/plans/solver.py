"""Solves one series in NumPy: ``min (1/T) sum over observed phi(y - s) + sum of component losses``.

The residual is 0 on unobserved rows. Without non-smooth terms this is one linear system; isotonic
least squares is solved by pooling; sums over rows by interior steps (``interior``). What these leave unsolved
and norms of falls go to ADMM on ``1/2 v'Pv - q'v + f(Kv)``. Models with free
values take their steps on sparse rows and a block-tridiagonal system.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tideline.functions.basis import default_knots, seasonal_matrix, spline_matrix
from tideline.plans.banded import Rows, System, beside
from tideline.plans.interior import has_rows, interior, one_sided
from tideline.plans.specs import Component, Model

#: Factors of one system that are kept at most, each for one step size.
KEPT_FACTORS = 3


class _Part:
    """A component on a grid: values ``basis @ v`` (identity: None), quadratic penalty, non-smooth terms.

    In a ``long`` model, one with free values, matrices of free values are sparse rows, and ``root`` is that of their penalty.
    """

    def __init__(self, c: Component, t: np.ndarray, z: dict[str, np.ndarray], long: bool = False):
        n, p, self.root = len(t), c.params, None
        self.c, self.basis, self.quad, self.terms, self.knots = c, None, None, [], None
        diff = (lambda k: Rows.difference(n, k)) if long else (lambda k: np.diff(np.eye(n), k, axis=0))
        if c.kind == "linear":
            self.basis, self.quad = np.stack([np.ones(n), np.arange(n, dtype=float)], 1), np.diag([0.0, 2 * p["weight"]])
        elif c.kind == "exog_linear":
            self.basis, self.quad = np.nan_to_num(z[p["column"]])[:, None], np.array([[2 * p["weight"]]])
        elif c.kind == "exog_spline":
            x = z[p["column"]]
            fin = x[np.isfinite(x)]
            self.knots = p["knots"] or default_knots(fin.min() if len(fin) else np.nan, fin.max() if len(fin) else np.nan, p["n_knots"])
            self.basis = spline_matrix(np.nan_to_num(x), self.knots)
            self.quad = 2 * p["weight"] * np.eye(self.basis.shape[1])
        elif c.kind == "periodic":
            self.basis, pen = seasonal_matrix(np.arange(n, dtype=float), p["periods"], p["harmonics"], p["standing"], p["cross"])
            self.quad = np.diag(2 * (p["weight"] * pen) ** 2)
        elif c.kind == "dictionary":
            self.basis = np.stack([np.nan_to_num(z[name]) for name in p["columns"]], 1)
            eye = np.eye(self.basis.shape[1])
            self.terms.append((Rows.dense(eye) if long else eye, "l1", p["weight"]))
        elif c.kind == "analysis":
            width = len(p["stencil"])
            rows = Rows(np.arange(n - width + 1)[:, None] + np.arange(width), np.tile(p["stencil"], (n - width + 1, 1)), n)
            self.terms.append((rows if long else sum(v * np.eye(n - width + 1, n, k) for k, v in enumerate(p["stencil"])), "l1", p["weight"] / (n - width + 1)))
        elif c.kind == "smooth":
            d = diff(p["order"])
            self._square(d, p["weight"], long)
        elif c.kind == "monotone":
            if p["weight"]:
                self._square(diff(2), p["weight"], long)
            self.terms.append((diff(1), "sign", 1.0 if p["increasing"] else -1.0))
        elif c.kind in ("pwl", "pwc"):
            k = 2 if c.kind == "pwl" else 1
            self.terms.append((diff(k), "l1", p["weight"] / max(n - k, 1)))
        elif c.kind == "sparse":
            self.terms.append((diff(0), "l1", p["weight"] / n))
        elif c.kind == "soiling":
            self.terms += [(diff(1), "falls", p["down"]), (diff(0), "l1", p["size"])]
        else:
            raise ValueError(f"unknown component {c.kind!r}")
        if c.lower is not None or c.upper is not None:
            box = (-np.inf if c.lower is None else c.lower, np.inf if c.upper is None else c.upper)
            rows = diff(0) if self.basis is None else Rows.dense(self.basis) if long else self.basis
            self.terms.append((rows, "box", box))
        self.size = n if self.basis is None else self.basis.shape[1]

    def _square(self, d: np.ndarray | Rows, weight: float, long: bool) -> None:
        if long:
            self.root = d.scaled(float(np.sqrt(2 * weight)))
        else:
            self.quad = 2 * weight * d.T @ d

    def penalty(self, x: np.ndarray) -> float:
        if self.root is not None:
            return 0.5 * float(((self.root @ x) ** 2).sum())
        return 0.5 * float(x @ self.quad @ x) if self.quad is not None else 0.0


def _prox(kind: str, x: np.ndarray, param: object, step: float) -> np.ndarray:
    if kind == "l1":
        return np.sign(x) * np.maximum(np.abs(x) - param * step, 0)
    if kind == "box":
        return np.clip(x, *param)
    if kind == "sign":
        return np.maximum(x * param, 0) * param
    if kind == "falls":  # norm2 of the negative part
        low = np.minimum(x, 0)
        norm = np.linalg.norm(low)
        return np.maximum(x, 0) + low * max(0.0, 1 - param * step / norm) if norm else x
    y, loss, m, scale = param  # residual losses of y - x
    r = y - x
    if loss == "l1":
        r = np.sign(r) * np.maximum(np.abs(r) - scale * step, 0)
    elif loss == "huber":
        inner = r / (1 + 2 * scale * step)
        r = np.where(np.abs(inner) <= m, inner, r - 2 * scale * step * m * np.sign(r))
    else:
        r = np.where(r > 2 * scale * step * m, r - 2 * scale * step * m, np.where(r < -2 * scale * step * (1 - m), r + 2 * scale * step * (1 - m), 0))
    return y - r


def _value(kind: str, x: np.ndarray, param: object) -> float:
    if kind == "l1":
        return param * float(np.abs(x).sum())
    if kind == "falls":
        return param * float(np.linalg.norm(np.minimum(x, 0)))
    return 0.0


def residual_loss(r: np.ndarray, loss: str, param: float, length: int) -> float:
    """The residual's loss, its sums over observed rows divided by the grid's length."""
    if loss == "l2":
        return float((r**2).sum()) / length
    if loss == "l1":
        return float(np.abs(r).sum()) / length
    if loss == "huber":
        return float(np.where(np.abs(r) <= param, r**2, 2 * param * np.abs(r) - param**2).sum()) / length
    return 2 * float(np.maximum(param * r, (param - 1) * r).sum()) / length


def isotonic(y: np.ndarray, seen: np.ndarray, increasing: bool) -> np.ndarray:
    """Least-squares monotone values of observed rows by pooling; gaps carry the last value."""
    sign = 1.0 if increasing else -1.0
    blocks: list[list[float]] = []
    for v in sign * y[seen]:
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, n2 = blocks.pop()
            v1, n1 = blocks[-1]
            blocks[-1] = [(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2]
    fit = np.concatenate([np.full(n, v) for v, n in blocks])
    at = np.maximum(np.cumsum(seen) - 1, 0)
    return sign * fit[at]


def solve(y: np.ndarray, model: Model, z: dict[str, np.ndarray] | None = None, tol: float = 1e-7, most: int = 8000, path: dict | None = None) -> dict:
    """Values by role, the residual, scalars and vectors of coefficients, the objective and a status.

    ``path``: kept by the caller from one model to the next of a series' path of weights, so that each that ADMM solves
    starts where the last ended, and factors of a system that only non-smooth weights left are used again.
    """
    y, z, n = np.asarray(y, float), z or {}, len(y)
    seen = np.isfinite(y)
    if not seen.any():
        raise ValueError("no observed value")
    for column, v in z.items():
        if len(v) != n:
            raise ValueError(f"covariate {column} has another length than the signal")
    only = model.components[0]
    if len(model.components) == 1 and only.kind == "monotone" and not only.params["weight"] and model.loss == "l2" and only.lower is None and only.upper is None:
        value = isotonic(y, seen, only.params["increasing"])
        residual = np.where(seen, y - value, 0.0)
        return {"status": "optimal", "values": {only.role: value}, "residual": residual, "scalars": {}, "vectors": {}, "objective": residual_loss(residual, "l2", 1.0, n)}
    free = any(c.kind not in ("linear", "exog_linear", "exog_spline", "periodic", "dictionary") for c in model.components)
    parts = [_Part(c, np.arange(n), z, free) for c in model.components]
    ends = np.cumsum([p.size for p in parts])
    cut = [slice(e - p.size, e) for p, e in zip(parts, ends, strict=True)]
    size = int(ends[-1])
    if free:
        v, status = _solve_banded(parts, cut, y, seen, model, tol, most, path)
    else:
        v, status = _solve_dense(parts, cut, y, seen, model, tol, most, path)
    values, scalars, vectors, objective = {}, {}, {}, 0.0
    for p, s in zip(parts, cut, strict=True):
        x = v[s]
        values[p.c.role] = x.copy() if p.basis is None else p.basis @ x
        objective += p.penalty(x)
        objective += sum(_value(kind, k @ x, param) for k, kind, param in p.terms)
        if p.c.kind == "linear":
            scalars |= {f"{p.c.role}_a": float(x[0]), f"{p.c.role}_b": float(x[1])}
        elif p.c.kind == "exog_linear":
            scalars[f"{p.c.role}_beta"] = float(x[0])
        elif p.basis is not None:
            vectors[f"{p.c.role}_{'coef' if p.c.kind == 'exog_spline' else 'theta'}"] = x.tolist()
    residual = np.where(seen, y - sum(values.values()), 0.0)
    objective += residual_loss(residual[seen], model.loss, model.param, n)
    return {"status": status, "values": values, "residual": residual, "scalars": scalars, "vectors": vectors, "objective": objective}


def _solve_dense(parts: list[_Part], cut: list[slice], y: np.ndarray, seen: np.ndarray, model: Model, tol: float, most: int, path: dict | None) -> tuple[np.ndarray, str]:
    n, size = len(y), cut[-1].stop
    a = np.zeros((int(seen.sum()), size))
    pen = np.zeros((size, size))
    for p, s in zip(parts, cut, strict=True):
        a[:, s] = np.eye(n)[seen] if p.basis is None else p.basis[seen]
        if p.quad is not None:
            pen[s, s] += p.quad
    goal = np.zeros(size)
    terms = [(s, k, kind, param) for p, s in zip(parts, cut, strict=True) for k, kind, param in p.terms]
    if model.loss == "l2":
        pen += 2 / n * a.T @ a
        goal = 2 / n * a.T @ y[seen]
    else:
        terms.append((slice(0, size), a, "residual", (y[seen], model.loss, model.param, 1 / n)))
    if not terms:
        return np.linalg.lstsq(pen, goal, rcond=1e-13)[0], "optimal"
    if has_rows(terms):
        each = one_sided(terms)
        v, near = interior(_Dense(pen, each, size), goal, each, *_sizes(y[seen], model, n))
        if near:
            return v, "optimal"
    path = {} if path is None else path
    same = "pen" in path and np.array_equal(path["pen"], pen) and [k.shape for _, k, _, _ in terms] == path["shapes"]
    if not same:
        path |= {"pen": pen, "shapes": [k.shape for _, k, _, _ in terms], "system": _Dense(pen, terms, size), "factors": {}}
        path.pop("z", None)
    return _admm(path["system"], goal, terms, tol, most, path)


def _solve_banded(parts: list[_Part], cut: list[slice], y: np.ndarray, seen: np.ndarray, model: Model, tol: float, most: int, path: dict | None) -> tuple[np.ndarray, str]:
    n, size = len(y), cut[-1].stop
    free = [p.basis is None for p in parts]
    m = sum(free)
    place, banded, coefficients = np.empty(size, np.int64), 0, m * n
    for s, is_free in zip(cut, free, strict=True):
        if is_free:
            place[s], banded = np.arange(n) * m + banded, banded + 1
        else:
            place[s], coefficients = coefficients + np.arange(s.stop - s.start), coefficients + s.stop - s.start
    put = lambda rows, s: rows.moved(place[s], size)
    here = np.flatnonzero(seen)
    fits = [Rows(here[:, None], np.ones((len(here), 1)), n) if p.basis is None else Rows.dense(p.basis[seen]) for p in parts]
    a = beside([put(f, s) for f, s in zip(fits, cut, strict=True)])
    quadratic = [put(p.root, s) for p, s in zip(parts, cut, strict=True) if p.root is not None]
    quadratic += [put(Rows.dense(np.sqrt(p.quad)), s) for p, s in zip(parts, cut, strict=True) if p.quad is not None]
    terms = [(s, put(k, s), kind, param) for p, s in zip(parts, cut, strict=True) for k, kind, param in p.terms]
    goal = np.zeros(size)
    if model.loss == "l2":
        quadratic.append(a.scaled(float(np.sqrt(2 / n))))
        goal = 2 / n * a.back(y[seen])
    else:
        terms.append((slice(0, size), a, "residual", (y[seen], model.loss, model.param, 1 / n)))
    split = [k for _, k, _, _ in terms]
    if not terms:
        return _ridged(System(quadratic, split, size, m * n), goal)[place], "optimal"
    if has_rows(terms):
        each = one_sided(terms)
        v, near = interior(System(quadratic, [k for _, k, _, _ in each], size, m * n), goal, each, *_sizes(y[seen], model, n))
        if near:
            return v[place], "optimal"
    path = {} if path is None else path
    rows = [x for r in (*quadratic, *split) for x in (r.columns, r.values)]
    if "rows" not in path or len(rows) != len(path["rows"]) or not all(np.array_equal(x, w) for x, w in zip(rows, path["rows"], strict=True)):
        path |= {"rows": rows, "system": System(quadratic, split, size, m * n), "factors": {}}
        path.pop("z", None)
    v, status = _admm(path["system"], goal, terms, tol, most, path)
    return v[place], status


def _sizes(y: np.ndarray, model: Model, length: int) -> tuple[float, float]:
    """The squares' objective of no fit at all, and the size of the values."""
    return float((y**2).sum()) / length if model.loss == "l2" else 0.0, float(np.abs(y).max())


def _ridged(system: System, goal: np.ndarray) -> np.ndarray:
    solve_ridged, goal = system.factor(0.0, 1e-12), goal * system.unit
    v = solve_ridged(goal)
    for _ in range(10):
        v = v + solve_ridged(goal - system.penalty(v))
    return v * system.unit


class _Dense:
    """The quadratic part and the splittings of a few coefficients; see ``System``."""

    def __init__(self, pen: np.ndarray, terms: list, size: int):
        rows = np.cumsum([k.shape[0] for _, k, _, _ in terms])
        k_all = np.zeros((int(rows[-1]), size))
        for (s, k, _, _), end in zip(terms, rows, strict=True):
            k_all[int(end) - k.shape[0] : int(end), s] = k
        # unit columns, so that one step size suits levels, slopes and coefficients
        self.unit = 1 / np.sqrt(np.maximum((k_all**2).sum(0) + np.diag(pen), 1e-12))
        self.k, self.pen, self.size = k_all * self.unit, pen * self.unit[:, None] * self.unit, size
        self.gram = self.k.T @ self.k
        self.trace_pen, self.trace_gram = np.trace(self.pen), np.trace(self.gram)

    def forward(self, v: np.ndarray) -> np.ndarray:
        return self.k @ v

    def back(self, z: np.ndarray) -> np.ndarray:
        return self.k.T @ z

    def penalty(self, v: np.ndarray) -> np.ndarray:
        return self.pen @ v

    def factor(self, rho: float | np.ndarray, ridge: float) -> Callable[[np.ndarray], np.ndarray]:
        gram = rho * self.gram if np.isscalar(rho) else self.k.T @ (rho[:, None] * self.k)
        inverse = np.linalg.inv(self.pen + gram + ridge * np.eye(self.size))
        return lambda r: inverse @ r


def _admm(system: _Dense | System, goal: np.ndarray, terms: list, tol: float, most: int, path: dict | None = None) -> tuple[np.ndarray, str]:
    path = {} if path is None else path
    factors = path.get("factors", {})
    size, unit, goal = system.size, system.unit, goal * system.unit
    rows = np.cumsum([k.shape[0] for _, k, _, _ in terms])
    spans = [slice(int(end) - k.shape[0], int(end)) for (_, k, _, _), end in zip(terms, rows, strict=True)]
    scale = system.trace_pen / size + 1e-12
    rho = max(scale / (system.trace_gram / size), 1e-8)
    ridge = 1e-10 * scale
    z, u = np.zeros(int(rows[-1])), np.zeros(int(rows[-1]))
    if "z" in path:
        rho, z, u = path["rho"], path["z"].copy(), path["dual"] / path["rho"]

    def factored(rho: float) -> Callable[[np.ndarray], np.ndarray]:
        if rho not in factors:
            if len(factors) == KEPT_FACTORS:
                factors.pop(next(iter(factors)))
            factors[rho] = system.factor(rho, ridge)
        return factors[rho]

    inverse = factored(rho)
    v = np.zeros(size)
    for i in range(most):
        v = inverse(goal + rho * system.back(z - u))
        kv = system.forward(v)
        mixed = 1.6 * kv - 0.6 * z
        old, z = z, np.empty_like(z)
        for (_, _, kind, param), s in zip(terms, spans, strict=True):
            z[s] = _prox(kind, (mixed + u)[s], param, 1 / rho)
        u = u + mixed - z
        primal, dual = np.linalg.norm(kv - z), rho * np.linalg.norm(system.back(z - old))
        near = max(np.linalg.norm(kv), np.linalg.norm(z), 1e-8)
        far = max(rho * np.linalg.norm(system.back(u)), rho * np.linalg.norm(u) * np.sqrt(system.trace_gram / size), 1e-10)
        if primal <= tol * near and dual <= tol * far:
            path |= {"rho": rho, "z": z, "dual": u * rho}
            return v * unit, "optimal"
        if i % 25 == 24 and i < most * 0.7:
            ratio = (primal / near) / max(dual / far, 1e-300)
            if ratio > 5 or ratio < 0.2:
                step = float(np.clip(np.sqrt(ratio), 0.1, 10))
                rho, u = rho * step, u / step
                inverse = factored(rho)
    return v * unit, "optimal_inaccurate"
