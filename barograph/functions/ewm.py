"""Exponentially weighted means as window expressions.

An EWM is an affine recurrence over the non-null rows. Inside a block of rows it is a running sum of ``w*x*e^-L`` scaled
by ``e^L`` where ``L`` is the running log-decay; blocks keep ``L`` inside the range of a double, and the state at a
block's end is carried into the following rows. Blocks from further back than e^-40 cannot change a double and are left
out. There is no Python in the row path and no recursion.

A series may begin in the middle: a first row that brings the mean as it was there (``start``) stands for all rows before.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

_MAX_LOG = 500.0   # largest |L| inside a block
_FORGET = 40.0     # decay beyond which a block is forgotten
_GAP_FLOOR = -60.0  # log-decay of one gap; anything smaller is below double precision


@dataclass(frozen=True)
class Ewm:
    out: str
    value: str
    alpha: float
    adjust: bool = False
    dense: bool = True  # the input is never null
    start: str | None = None  # column with the mean at a resumed series' first row, null elsewhere
    start_gap: str = "0"  # rows between the last input and that row
    start_seen: str = "null"  # inputs up to that row, for adjusted means: the weights' sum has no other gaps

    @staticmethod
    def span(out: str, value: str, n: int, adjust: bool = False, dense: bool = True, **resumed: str) -> "Ewm":
        return Ewm(out, value, 2.0 / (n + 1), adjust, dense, **resumed)

    @property
    def log_decay(self) -> float:
        return math.log(1.0 - self.alpha)


    @property
    def known(self) -> str:
        """SQL: the row brings a value or the mean so far."""
        return f"({self.value} is not null or {self.start} is not null)" if self.start else f"{self.value} is not null"

    @property
    def start_weight(self) -> str:
        """SQL: the weights' sum at a resumed series' first row."""
        return f"((1.0d - exp({self.start_seen} * {self.log_decay!r}d)) / {self.alpha!r}d)" if self.adjust else "1.0d"


def block_rows(specs: Sequence[Ewm]) -> int:
    for s in specs:
        if not 0 < s.alpha < 1:
            raise ValueError(f"alpha must lie between 0 and 1: {s}")
    return max(1, min(4096, *(int(_MAX_LOG / -s.log_decay) for s in specs)))


def add_ewm(df: DataFrame, keys: Sequence[str], order: str, specs: Sequence[Ewm], *, rn: str | None = None,
            block: int | None = None, total: str | None = None) -> DataFrame:
    """Add one column per spec. Rows of one key must fit a window partition (see ``operators.halo`` for hot keys).

    ``rn`` names an existing row-number column that starts at 1 in every key; ``total``, for resumed series, one that
    counts the rows before the first as well.
    """
    size = block or block_rows(specs)
    part = ", ".join(keys)
    w = f"partition by {part} order by {order}"
    before = f"over ({w} rows between unbounded preceding and 1 preceding)"
    run = f"over (partition by {part}, _blk order by {order} rows between unbounded preceding and current row)"
    gappy = [s for s in specs if not s.dense]
    base = df.columns

    rows = df if rn else df.selectExpr("*", f"row_number() over ({w}) as _rn")
    rn = rn or "_rn"
    rows = rows.selectExpr(
        "*", f"floor(({rn} - 1) / {size}) as _blk",
        *[f"last(if({s.known}, {rn}{f' - coalesce(if({s.start} is null, 0, {s.start_gap}), 0)' if s.start else ''}, null)) ignore nulls {before} "
          f"as _p_{s.out}" for s in gappy])

    # log-decay since the block's start: closed form without gaps, running sum with them
    log = {s.out: f"({s.log_decay!r} * if(_blk = 0, {rn} - 1, pmod({rn} - 1, {size}) + 1))" for s in specs if s.dense}
    weight = {s.out: f"if({rn} = 1, 1.0d, {1.0 if s.adjust else s.alpha!r}d)" for s in specs if s.dense}
    if gappy:
        steps, sums = [], []
        for s in gappy:
            gap = f"greatest(({rn} - _p_{s.out}) * {s.log_decay!r}d, {_GAP_FLOOR}d)"
            norm = "1.0d" if s.adjust else f"(exp({gap}) + {s.alpha!r}d)"
            missing, first = f"not {s.known}", f"_p_{s.out} is null"
            steps += [f"case when {missing} or {first} then 0.0d else {gap} - ln({norm}) end as _a_{s.out}",
                      f"case when {missing} then 0.0d when {first} then 1.0d "
                      f"else {'1.0d' if s.adjust else f'{s.alpha!r}d / {norm}'} end as _w_{s.out}"]
            sums.append(f"sum(_a_{s.out}) {run} as _L_{s.out}")
            log[s.out], weight[s.out] = f"_L_{s.out}", f"_w_{s.out}"
        rows = rows.selectExpr("*", *steps).selectExpr("*", *sums)

    # m, the sum of weights, has a closed form without gaps and is 1 for non-adjusted means
    begun = lambda s, x, y: f"if({s.start} is null, {y}, {x})" if s.start else y
    parts = [(s, "n", begun(s, f"{s.start} * {s.start_weight}", f"coalesce({s.value}, 0.0d)")) for s in specs] + \
            [(s, "m", begun(s, s.start_weight, "1.0d")) for s in gappy if s.adjust]
    rows = rows.selectExpr("*", *[
        f"exp({log[s.out]}) * sum({weight[s.out]} * {x} * exp(-({log[s.out]}))) {run} as _{p}_{s.out}"
        for s, p, x in parts])
    at_end = f"{rn} % {size} = 0"
    rows = rows.selectExpr("*", *[
        f"last(if({at_end}, {col}, null)) ignore nulls {before} as _e{col}"
        for col in [f"_{p}_{s.out}" for s, p, _ in parts] + [f"_L_{s.out}" for s in gappy]])

    outs = []
    for s in specs:
        depth = math.ceil(_FORGET / (-s.log_decay * size))

        def carried(p: str) -> str:
            terms, decay = [f"coalesce(_e_{p}_{s.out}, 0.0d)"], "1.0d"
            for j in range(1, depth):
                if s.dense:
                    decay = f"{math.exp(s.log_decay * size * j)!r}d"
                else:
                    decay += f" * exp(coalesce(lag(_e_L_{s.out}, {size * (j - 1)}) over ({w}), 0.0d))"
                terms.append(f"{decay} * coalesce(lag(_e_{p}_{s.out}, {size * j}) over ({w}), 0.0d)")
            return f"({' + '.join(terms)}) * exp({log[s.out]})"

        value = f"_n_{s.out} + {carried('n')}"
        if s.adjust and s.dense:
            value = f"({value}) * {s.alpha!r}d / (1.0d - exp({total or rn} * {s.log_decay!r}d))"
        elif s.adjust:
            value = f"try_divide({value}, _m_{s.out} + {carried('m')})"
        if not s.dense:
            value = f"if({s.known} or _p_{s.out} is not null, {value}, null)"
        outs.append(f"{value} as {s.out}")
    return rows.selectExpr(*base, *outs)
