"""Models as data: components, residual losses and their checks.

Every atom is convex and every weight must be non-negative, so a valid model is convex by construction.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Component:
    """One part of a signal. ``kind`` says how it is built; ``params`` are its numbers."""

    role: str
    kind: str
    params: dict = field(default_factory=dict)
    lower: float | None = None
    upper: float | None = None


def _positive(weight: float) -> float:
    if weight < 0:
        raise ValueError("a negative weight makes the model non-convex")
    return float(weight)


def linear_trend(role: str = "trend", slope_weight: float = 0.0) -> Component:
    """a + b t, with ``slope_weight * b^2``."""
    return Component(role, "linear", {"weight": _positive(slope_weight)})


def smooth_trend(weight: float, order: int = 2, role: str = "trend") -> Component:
    """Free values with ``weight * sum (difference of order)^2``."""
    return Component(role, "smooth", {"weight": _positive(weight), "order": order})


def pwl_trend(weight: float, role: str = "trend") -> Component:
    """Piecewise linear: ``weight / (T - 2) * sum |second differences|``."""
    return Component(role, "pwl", {"weight": _positive(weight)})


def pwc_trend(weight: float, role: str = "trend") -> Component:
    """Piecewise constant: ``weight / (T - 1) * sum |differences|``."""
    return Component(role, "pwc", {"weight": _positive(weight)})


def monotone_trend(weight: float = 0.0, increasing: bool = False, role: str = "trend") -> Component:
    """Decreasing (or increasing) values, with ``weight * sum (second differences)^2``."""
    return Component(role, "monotone", {"weight": _positive(weight), "increasing": increasing})


def sparse(weight: float, role: str = "sparse") -> Component:
    """Few events: ``weight / T * sum |x|``."""
    return Component(role, "sparse", {"weight": _positive(weight)})


def soiling(down_weight: float, size_weight: float, role: str = "soiling") -> Component:
    """Values at most 0: ``down * norm2(falls) + size * sum |x|``."""
    return Component(role, "soiling", {"down": _positive(down_weight), "size": _positive(size_weight)}, upper=0.0)


def exog_linear(column: str, weight: float = 0.0, role: str = "exog") -> Component:
    """beta times a covariate column, with ``weight * beta^2``."""
    return Component(role, "exog_linear", {"column": column, "weight": _positive(weight)})


def exog_spline(column: str, n_knots: int = 10, knots: Sequence[float] | None = None, weight: float = 1e-2, role: str = "exog") -> Component:
    """A natural cubic spline of a covariate column, ridge ``weight``."""
    return Component(role, "exog_spline", {"column": column, "n_knots": n_knots, "knots": None if knots is None else tuple(knots), "weight": _positive(weight)})


def dictionary(columns: Sequence[str], weight: float, role: str = "atoms") -> Component:
    """A sparse mix of covariate columns, the atoms: ``weight * sum |theta|`` (synthesis sparsity)."""
    return Component(role, "dictionary", {"columns": tuple(columns), "weight": _positive(weight)})


def analysis(stencil: Sequence[float], weight: float, role: str = "trend") -> Component:
    """Free values x with few nonzeros in L x, the stencil at every place: ``weight / len(Lx) * sum |L x|``."""
    return Component(role, "analysis", {"stencil": tuple(float(s) for s in stencil), "weight": _positive(weight)})


def multiperiodic(
    periods: Sequence[float] | float, num_harmonics: Sequence[int] | int = 6, weight: float = 1e-1, role: str = "periodic",
    standing_wave: Sequence[bool] | bool = False, max_cross_k: int | None = None,
) -> Component:
    """Seasonal shapes of one or more periods (in samples), harmonics penalized by their frequency."""
    return Component(role, "periodic", {"periods": periods, "harmonics": num_harmonics, "weight": _positive(weight), "standing": standing_wave, "cross": max_cross_k})


def custom_periodic(columns: Sequence[str], period: float, weight: float = 1e-1, role: str = "periodic") -> Component:
    """A seasonal shape of ``period`` samples over basis columns of one's own, penalized by their place like harmonics."""
    size = 2 * math.pi / math.sqrt(period)
    return Component(role, "columns", {"columns": tuple(columns), "penalties": tuple(size * i for i in range(1, len(columns) + 1)), "weight": _positive(weight)})


def bounded(inner: Component, lower: float | None = None, upper: float | None = None) -> Component:
    return replace(inner, lower=inner.lower if lower is None else lower, upper=inner.upper if upper is None else upper)


def nonneg(inner: Component) -> Component:
    return bounded(inner, lower=0.0)


@dataclass(frozen=True)
class Model:
    """Components and the residual's loss: l2, l1, huber (``param`` M) or quantile (``param`` q)."""

    components: tuple[Component, ...]
    loss: str = "l2"
    param: float = 1.0

    def __post_init__(self) -> None:
        object.__setattr__(self, "components", tuple(self.components))
        roles = [c.role for c in self.components]
        if not roles:
            raise ValueError("a model needs a component")
        if len(set(roles)) != len(roles) or {"residual", "reconstruction", "y"} & set(roles):
            raise ValueError("roles must be unique, and not residual, reconstruction or y")
        if self.loss not in ("l2", "l1", "huber", "quantile"):
            raise ValueError(f"unknown loss {self.loss!r}")
        if self.loss == "quantile" and not 0 < self.param < 1:
            raise ValueError("a quantile lies between 0 and 1")

    @property
    def roles(self) -> list[str]:
        return [c.role for c in self.components]

    @property
    def columns(self) -> list[str]:
        """Covariates that the model reads."""
        each = [c.params.get("columns", (c.params["column"],) if "column" in c.params else ()) for c in self.components]
        return list(dict.fromkeys(column for columns in each for column in columns))
