"""The normal distribution as SQL text that any engine runs, and for the driver."""

from __future__ import annotations

from statistics import NormalDist

# West's (2005) double-precision rational approximation of the normal integral.
_ABOVE = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_BELOW = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
# Acklam's rational approximation of its inverse; the middle part, then the tails.
_MID_ABOVE = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239)
_MID_BELOW = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0)
_TAIL_ABOVE = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_TAIL_BELOW = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0)


def _poly(terms: tuple[float, ...], x: str) -> str:
    out = f"{terms[0]:.16e}"
    for t in terms[1:]:
        out = f"({out} * {x} + {t:.16e})"
    return out


def cdf(z: str) -> str:
    """P(Z <= z) of a double expression, to some 1e-15; null of null."""
    x = f"least(abs({z}), 7e0)"
    upper = f"exp(-{x} * {x} / 2) * {_poly(_ABOVE, x)} / {_poly(_BELOW, x)}"
    return f"(case when {z} is null then null when {z} > 7e0 then 1e0 when {z} < -7e0 then 0e0 when {z} > 0 then 1e0 - {upper} else {upper} end)"


def ppf(p: str) -> str:
    """The inverse of cdf() of a double expression in (0, 1), to some 1e-9; null elsewhere."""

    def tail(q: str) -> str:
        return f"({_poly(_TAIL_ABOVE, q)} / {_poly(_TAIL_BELOW, q)})"

    r = f"(({p} - 5e-1) * ({p} - 5e-1))"
    low, high = (tail(f"sqrt(-2e0 * ln({x}))") for x in (p, f"(1e0 - {p})"))
    return f"(case when {p} <= 0 or {p} >= 1 then null when {p} < 2425e-5 then {low} when {p} > 97575e-5 then -{high} else ({p} - 5e-1) * {_poly(_MID_ABOVE, r)} / {_poly(_MID_BELOW, r)} end)"


def normal_cdf(z: float) -> float:
    return NormalDist().cdf(z)


def normal_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)
