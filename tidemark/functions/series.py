"""Time-series and cross-section functions over (symbol, date) rows, as columns of a plan.

Missing is NULL. Functions with a frame of d rows give NULL in a symbol's first d - 1 rows; sums, means, deviations,
extremes and covariances also where a value in the frame is missing; correlation gives 0 there, and rank within the
frame 0 where the current value is missing.
"""

from __future__ import annotations

from tidemark.plans.staged import Columns

BY_SYMBOL = "PARTITION BY symbol ORDER BY date"


class Series:
    def __init__(self, columns: Columns):
        self.c = columns

    def row(self, expression: str) -> str:
        return self.c.add("row", expression)

    def over(self, call: str, d: int) -> str:
        return f"{call} OVER ({BY_SYMBOL} ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"

    def _full(self, x: str, d: int, call: str) -> str:
        return self.c.add("ts", f"CASE WHEN {self.over(f'count({x})', d)} = {d} THEN {self.over(call, d)} END")

    def _number(self) -> str:
        return self.c.add("ts", f"row_number() OVER ({BY_SYMBOL})")

    def delay(self, x: str, d: int) -> str:
        return self.c.add("ts", f"lag({x}, {d}) OVER ({BY_SYMBOL})")

    def lead(self, x: str, d: int) -> str:
        return self.c.add("ts", f"lead({x}, {d}) OVER ({BY_SYMBOL})")

    def delta(self, x: str, d: int) -> str:
        return self.row(f"{x} - {self.delay(x, d)}")

    def total(self, x: str, d: int) -> str:
        return self._full(x, d, f"sum({x})")

    def mean(self, x: str, d: int) -> str:
        return self._full(x, d, f"avg({x})")

    def std(self, x: str, d: int) -> str:
        return self._full(x, d, f"stddev_samp({x})")

    def low(self, x: str, d: int) -> str:
        return self._full(x, d, f"min({x})")

    def high(self, x: str, d: int) -> str:
        return self._full(x, d, f"max({x})")

    def cov(self, x: str, y: str, d: int) -> str:
        both = self.row(f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END")
        return self._full(both, d, f"covar_samp({x}, {y})")

    def corr(self, x: str, y: str, d: int) -> str:
        both = self.row(f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END")
        sx, sy = self._full(both, d, f"stddev_samp({x})"), self._full(both, d, f"stddev_samp({y})")
        cov, n = self._full(both, d, f"covar_samp({x}, {y})"), self._number()
        return self.row(f"CASE WHEN {n} >= {d} THEN CASE WHEN {d - 1} * {sx} * {sy} > 1e-12 THEN {cov} / nullif({sx} * {sy}, 0) ELSE 0.0e0 END END")

    def _lags(self, x: str, d: int) -> list[str]:
        """Values of the frame, oldest first."""
        return [self.delay(x, k) for k in range(d - 1, 0, -1)] + [x]

    def arg_high(self, x: str, d: int) -> str:
        return self._arg(x, d, self.c.add("ts", self.over(f"max({x})", d)))

    def arg_low(self, x: str, d: int) -> str:
        return self._arg(x, d, self.c.add("ts", self.over(f"min({x})", d)))

    def _arg(self, x: str, d: int, best: str) -> str:
        """Position from 0 of the first missing value, else of the first extreme one."""
        values, n = self._lags(x, d), self._number()
        missing = " ".join(f"WHEN {v} IS NULL THEN {k}" for k, v in enumerate(values))
        found = " ".join(f"WHEN {v} = {best} THEN {k}" for k, v in enumerate(values))
        return self.row(f"CASE WHEN {n} < {d} THEN NULL {missing} {found} END")

    def ts_rank(self, x: str, d: int) -> str:
        below = " + ".join(f"CASE WHEN {v} <= {x} THEN 1 ELSE 0 END" for v in self._lags(x, d))
        return self.row(f"CASE WHEN {self._number()} >= {d} THEN CAST({below} AS DOUBLE) / {d} END")

    def decay(self, x: str, d: int) -> str:
        terms = " + ".join(f"{v} * {k + 1}" for k, v in enumerate(self._lags(x, d)))
        return self.row(f"({terms}) / {d * (d + 1) / 2}e0")

    def rank(self, x: str, digits: int = 10) -> str:
        """Ordinal rank within the date over the number of values; ties by symbol; NULL with under two values.

        Values are rounded first, so that noise in the last bits doesn't order what is equal.
        """
        r = self.row(f"round({x}, {digits})")
        n = self.c.add("xs", f"count({r}) OVER (PARTITION BY date)")
        k = self.c.add("xs", f"row_number() OVER (PARTITION BY date ORDER BY {r} ASC NULLS LAST, symbol)")
        return self.row(f"CASE WHEN {r} IS NOT NULL AND {n} >= 2 THEN CAST({k} AS DOUBLE) / {n} END")

    def rank01(self, x: str, digits: int = 10) -> str:
        """Ordinal rank from 0 to 1."""
        r = self.row(f"round({x}, {digits})")
        n = self.c.add("xs", f"count({r}) OVER (PARTITION BY date)")
        k = self.c.add("xs", f"row_number() OVER (PARTITION BY date ORDER BY {r} ASC NULLS LAST, symbol)")
        return self.row(f"CASE WHEN {r} IS NOT NULL AND {n} >= 2 THEN CAST({k} - 1 AS DOUBLE) / ({n} - 1) END")

    def scale(self, x: str) -> str:
        s = self.c.add("xs", f"sum(abs({x})) OVER (PARTITION BY date)")
        return self.row(f"{x} / nullif({s}, 0)")

    def sign(self, x: str) -> str:
        return self.row(f"CASE WHEN {x} > 0 THEN 1.0e0 WHEN {x} < 0 THEN -1.0e0 WHEN {x} = 0 THEN 0.0e0 END")

    def log(self, x: str) -> str:
        return self.row(f"CASE WHEN {x} > 0 THEN ln(nullif({x}, 0)) END")

    def signed_power(self, x: str, a: float) -> str:
        return self.row(f"{self.sign(x)} * power(abs({x}), {a}e0)")

    def ratio(self, a: str, b: str) -> str:
        return self.row(f"({a}) / nullif({b}, 0)")
