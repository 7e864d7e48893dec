"""Rolling-window SQL helpers with the pandas null rule: no value until ``n`` non-null inputs are in the frame.

Wide feature blocks are written as SQL text: one ``selectExpr`` call is one round trip to the JVM, hundreds of nested
``Column`` objects are hundreds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec, functions as F


class Series:
    """SQL fragments over one ordered series per key."""

    def __init__(self, keys: Sequence[str], order: str, rn: str = "rn"):
        self.spec = f"partition by {', '.join(keys)} order by {order}"
        self.rn = rn

    def lag(self, x: str, k: int = 1) -> str:
        return f"lag({x}, {k}) over ({self.spec})"

    def change(self, x: str, k: int) -> str:
        """Relative change over ``k`` rows; a zero base gives null."""
        return f"try_divide({x}, {self.lag(x, k)}) - 1"

    def so_far(self, agg: str) -> str:
        return f"{agg} over ({self.spec} rows between unbounded preceding and current row)"

    def frame(self, agg: str, n: int) -> str:
        return f"{agg} over ({self.spec} rows between {n - 1} preceding and current row)"

    def dense(self, agg: str, n: int) -> str:
        """Rolling value of an input that is never null: the row number is the gate."""
        return f"if({self.rn} >= {n}, {self.frame(agg, n)}, null)"

    def gated(self, agg: str, seen: str, n: int, min_rows: int | None = None) -> str:
        """Rolling value of an input with nulls. ``seen`` is its running count of non-nulls, an earlier column."""
        return (f"if({seen} - coalesce(lag({seen}, {n}) over ({self.spec}), 0) >= {min_rows or n}, "
                f"{self.frame(agg, n)}, null)")

    def widened(self, extreme: str, x: str, shifts: Sequence[int], gate: str) -> str:
        """Extreme of a longer frame from the extremes ``x`` of a shorter one at the given shifts."""
        return f"if({gate}, {extreme}({', '.join(self.lag(x, k) if k else x for k in shifts)}), null)"

    def full(self, seen: str, n: int) -> str:
        return f"{seen} - coalesce(lag({seen}, {n}) over ({self.spec}), 0) >= {n}"


def true_range(high: str, low: str, prev_close: str) -> str:
    return f"greatest({high} - {low}, abs({high} - {prev_close}), abs({low} - {prev_close}))"


def series(keys, order="day") -> WindowSpec:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return Window.partitionBy(*keys).orderBy(order)


def compounded(r: Column) -> Column:
    """Product of (1+r) minus one, as a sum of logarithms; a total loss gives -1."""
    return (F.when(F.max(F.when(r <= -1, 1)).isNotNull(), F.lit(-1.0))
            .otherwise(F.exp(F.sum(F.when(r > -1, F.log1p(r)))) - 1))
