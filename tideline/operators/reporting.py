"""Tables and text from fitted curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components_frame(curves: DataFrame, roles: Sequence[str], mask: bool = False) -> DataFrame:
    """Roles, residual, reconstruction and y; with ``mask`` all but y is null on unobserved rows."""
    if not mask:
        return curves
    cover = (*roles, "residual", "reconstruction")
    return curves.withColumns({c: F.when(F.col("y").isNotNull(), F.col(c)) for c in cover})


def tidy(curves: DataFrame, roles: Sequence[str]) -> DataFrame:
    """(series_id, t, panel, value): the panels of a decomposition plot in long form."""
    return curves.unpivot(["series_id", "t"], ["y", "reconstruction", *roles, "residual"], "panel", "value")


def report_numbers(curves: DataFrame, roles: Sequence[str]) -> DataFrame:
    """One row per series: length, coverage, energy shares, residual size over all and over observed rows.

    The shares are of the roles' energies (their sums of squares) without the residual; null where all are 0.
    """
    energy = {r: F.sum(F.col(r) ** 2) for r in roles}
    total = sum((energy[r] for r in roles[1:]), energy[roles[0]])
    seen = F.col("y").isNotNull()
    return curves.groupBy("series_id").agg(
        F.count("*").alias("n"), F.count("y").alias("observed"), *[F.when(total > 0, 100 * energy[r] / total).alias(f"share_{r}") for r in roles],
        F.sqrt(F.avg(F.col("residual") ** 2)).alias("rms"), F.avg(F.abs("residual")).alias("mae"),
        F.sqrt(F.avg(F.when(seen, F.col("residual") ** 2))).alias("rms_observed"), F.avg(F.when(seen, F.abs("residual"))).alias("mae_observed"),
    )


def format_report(curves: DataFrame, summary: DataFrame, roles: Sequence[str], series_id: object, title: str = "Decomposition") -> str:
    """One series' report as markdown; two rows come to the driver. A series without a solution is an error."""
    n = report_numbers(curves.where(F.col("series_id") == series_id), roles).first()
    s = summary.where(F.col("series_id") == series_id).first()
    if n is None or n.rms is None:
        raise ValueError(f"series {series_id!r} has no solution")
    lines = [f"# {title}", "", f"- **status:** {s.status if s else 'unknown'}", f"- **length (T):** {n.n}", "", "## Components (share of reconstruction energy)", ""]
    lines += [f"- **{r}:** {n[f'share_{r}']:5.1f}%" for r in roles if n[f"share_{r}"] is not None] or ["- (no structural components)"]
    lines += ["", "## Residual", "", f"- **residual RMS:** {n.rms:.4g}", f"- **residual MAE:** {n.mae:.4g}"]
    lines += [f"- **observed entries:** {n.observed} / {n.n} ({100 * n.observed / n.n:.1f}% coverage)"]
    lines += [f"- **fit RMS (observed):** {n.rms_observed:.4g}", f"- **fit MAE (observed):** {n.mae_observed:.4g}"]
    if s and s.scalars:
        lines += ["", "## Scalar quantities", "", *[f"- **{k}:** {v:.6g}" for k, v in sorted(s.scalars.items())]]
    return "\n".join(lines)


def degradation_report(rate: float, settings: dict[str, object]) -> str:
    """A yearly rate in percent as markdown, under the model's settings."""
    stated = " | ".join(f"**{k}:** `{v}`" for k, v in settings.items())
    return f"## Degradation\n\n{stated}\n\n| Quantity | Value |\n|---|---|\n| Overall rate | {rate:+.3f} %/yr |\n\n> Chord from the first to the last trend value, per year; negative means a decline.\n"


def stability_panels(moves: DataFrame, path: DataFrame | None = None) -> DataFrame:
    """(series_id, n, panel, value): ``stability`` rows and, if given, ``history`` rows in long form."""
    out = moves.unpivot(["series_id", "n"], ["rmsd", "sdelta"], "panel", "value")
    return out if path is None else out.unionByName(path.unpivot(["series_id", "n"], ["value", "delta"], "panel", "value"))
