"""Column plans: named SQL expressions ordered so that window passes share their exchanges.

Every column has a kind: `row` (no window), `ts` (window by symbol, in order of date) or `xs` (window by date). Passes by
symbol and by date alternate; a column goes into the first pass of its kind that has all it needs, so the number of
exchanges is the largest alternation depth, not the number of columns. Equal expressions are one column. The same
plan applies to a DataFrame and prints as SQL for checks in another engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_name = re.compile(r"[a-z_][a-z_0-9]*")


class Columns:
    def __init__(self, base: list[str]):
        self.at: dict[str, tuple[int, int]] = dict.fromkeys(base, (1, 0))
        self.known: dict[str, str] = {}
        self.text: dict[str, str] = {}

    def add(self, kind: str, expression: str, name: str | None = None) -> str:
        """The name of a column with this expression over columns added before."""
        if name is None and expression in self.known:
            return self.known[expression]
        used = [self.at[t] for t in set(_name.findall(expression)) if t in self.at] or [(1, 0)]
        phase = max(p for p, _ in used)
        if kind == "ts" and phase % 2 == 0 or kind == "xs" and phase % 2:
            phase += 1
        step = 1 + max([s for p, s in used if p == phase], default=0)
        name = name or f"x{len(self.at)}"
        self.at[name], self.text[name] = (phase, step), expression
        self.known.setdefault(expression, name)
        return name

    def needed(self, outputs: list[str]) -> list[list[str]]:
        """The columns that the outputs need, by step."""
        todo, seen = list(outputs), set()
        while todo:
            if (n := todo.pop()) in self.text and n not in seen:
                seen.add(n)
                todo += [t for t in _name.findall(self.text[n]) if t in self.text]
        steps: dict[tuple[int, int], list[str]] = {}
        for n in self.text:
            if n in seen:
                steps.setdefault(self.at[n], []).append(n)
        return [steps[k] for k in sorted(steps)]

    def apply(self, df: DataFrame, outputs: list[str]) -> DataFrame:
        for names in self.needed(outputs):
            df = df.select("*", *(F.expr(self.text[n]).alias(n) for n in names))
        return df

    def sql(self, source: str, outputs: list[str]) -> str:
        out = f"SELECT * FROM ({source})"
        for names in self.needed(outputs):
            out = f"SELECT *, {', '.join(f'{self.text[n]} AS {n}' for n in names)} FROM ({out})"
        return out
