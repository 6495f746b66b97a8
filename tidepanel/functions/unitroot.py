"""Augmented Dickey-Fuller tests of one series: all lags from a single factorisation."""

from __future__ import annotations

import math

import numpy as np

# fixed values: MacKinnon's response surfaces for one variable, by deterministic terms: the largest and the least statistic
# they hold for, where the two polynomials meet, and their coefficients for small and for large statistics
SURFACES = {
    "n": (math.inf, -19.04, -1.04, (0.6344, 1.2378, 0.032496), (0.4797, 0.93557, -0.06999, 0.033066)),
    "c": (2.74, -18.83, -1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    "ct": (0.7, -16.18, -2.89, (3.2512, 1.6047, 0.049588), (2.5261, 0.61654, -0.37956, -0.060285)),
}


def p_value(tau: float, regression: str = "c") -> float:
    highest, lowest, middle, small, large = SURFACES[regression]
    if tau > highest:
        return 1.0
    if tau < lowest:
        return 0.0
    z = sum(c * tau**k for k, c in enumerate(small if tau <= middle else large))
    return 0.5 * math.erfc(-z / math.sqrt(2))


class Nested:
    """Regressions of a series' changes on its level, deterministic terms and 0 to ``most`` lagged changes, on the same rows.

    One cross-product matrix is factorised once. Its leading blocks are the factors of the smaller regressions, so each
    lag adds one entry to the projected target, and with it one residual sum.
    """

    def __init__(self, y: np.ndarray, most: int, regression: str) -> None:
        change = np.diff(y)
        target = change[most:]
        n = len(target)
        fixed = {"n": [], "c": [np.ones(n)], "ct": [np.ones(n), np.arange(1.0, n + 1)]}[regression]
        design = np.stack([y[most:-1], *fixed, *[change[most - j : len(change) - j] for j in range(1, most + 1)]], 1)
        self.rows, self.first, self.most = n, 1 + len(fixed), most
        self.factor = np.linalg.cholesky(design.T @ design)
        self.projected = np.array(_forward(self.factor, design.T @ target))
        self.residuals = np.maximum(float(target @ target) - np.cumsum(self.projected**2), 1e-300)  # with 1, 2 ... columns

    def lags_by(self, autolag: str) -> int:
        """The number of lags of least AIC or BIC, or, for ``t``, the most whose last lag is significant at 0.05 (two-sided at 0.1)."""
        if autolag == "t":
            for lags in range(self.most, 0, -1):
                k = self.first + lags
                # the last coefficient is its projection over the factor's last diagonal entry, its deviation likewise
                if abs(self.projected[k - 1]) / math.sqrt(self.residuals[k - 1] / (self.rows - k)) >= 1.6448536269514722:
                    return lags
            return 0
        per = {"AIC": 2.0, "BIC": math.log(self.rows)}[autolag]
        sizes = [self.first + lags for lags in range(self.most + 1)]
        return int(np.argmin([self.rows * math.log(self.residuals[k - 1] / self.rows) + per * k for k in sizes]))

    def tau(self) -> float:
        """The level's coefficient over its deviation, with all lags."""
        k = self.first + self.most
        solved = np.linalg.solve(self.factor.T, self.projected)
        unit = np.linalg.solve(self.factor, np.eye(k)[0])  # its squared length is the level's entry of the inverse
        return float(solved[0] / math.sqrt(self.residuals[k - 1] / (self.rows - k) * (unit @ unit)))


def _forward(factor: np.ndarray, right: np.ndarray) -> list[float]:
    out: list[float] = []
    for k, row in enumerate(factor):
        out.append((right[k] - row[:k] @ out if k else right[k]) / row[k])
    return out


def adf_statistic(y: np.ndarray, *, regression: str = "c", autolag: str | None = "AIC", lags: int | None = None) -> tuple[float, int]:
    """The test's statistic and its number of lags: ``lags``, or up to Schwert's rule by ``autolag`` (AIC, BIC or t)."""
    if regression not in SURFACES:
        raise ValueError(f"regression must be one of {sorted(SURFACES)}, not {regression!r}")
    terms = {"n": 0, "c": 1, "ct": 2}[regression]
    n = len(y)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 1 - terms) if lags is None else lags
    if most < 0 or n - 1 - most <= 1 + terms + most:
        raise ValueError("too few values")
    if lags is None and autolag is not None:
        if autolag not in ("AIC", "BIC", "t"):
            raise ValueError(f"autolag must be AIC, BIC or t, not {autolag!r}")
        most = Nested(y, most, regression).lags_by(autolag)
    return Nested(y, most, regression).tau(), most


def adf_p_value(y: np.ndarray, *, regression: str = "c", autolag: str | None = "AIC") -> float:
    return p_value(adf_statistic(y, regression=regression, autolag=autolag)[0], regression)
