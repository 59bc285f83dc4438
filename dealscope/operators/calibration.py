"""Chances from margins: the share of positives as a rising function of the margin.

Margins are counted in cells of equal width with the positives among them. Pooling adjacent violators (Ayer and others
1955) turns the cells' shares into the rising step function closest to them; its input is at most ``cells`` counts, so it runs
on the driver whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

CELLS = 1000


def rising(counts: Sequence[tuple[int, int]]) -> list[float]:
    """For cells of (rows, positives) the rising shares of least squared distance, weighted by rows."""
    pools: list[list[int]] = []
    for rows, positives in counts:
        pools.append([rows, positives, 1])
        # Shares are compared as products of whole numbers.
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return [positives / rows for rows, positives, cells in pools for _ in range(cells)]


@dataclass(frozen=True)
class Calibration:
    """Chance per cell of margins from ``low`` on; margins beyond either end count as in the last cell."""

    low: float
    width: float
    chances: tuple[float, ...]

    def chance(self, margin: Column) -> Column:
        """Null for a margin that is unknown or no number."""
        known = F.when(F.isnan(margin), None).otherwise(margin)
        last = F.lit(len(self.chances) - 1)
        cell = F.greatest(F.lit(0), F.least(F.floor((known - F.lit(self.low)) / F.lit(self.width)), last.cast("bigint"))).cast("int")
        return F.when(known.isNotNull(), F.get(F.array(*[F.lit(c) for c in self.chances]), cell))


def calibrate(scored: DataFrame, margin: str = "margin", label: str = "label", cells: int = CELLS) -> Calibration:
    """Fit to rows that were not fitted, in two passes. A cell without rows has the chance of the one below it."""
    known = scored.select(F.col(margin).cast("double").alias("m"), F.col(label).cast("boolean").alias("y")).where(
        "m is not null and not isnan(m) and abs(m) < double('infinity') and y is not null")
    ends = known.agg(F.min("m").alias("low"), F.max("m").alias("high")).first()
    if ends["low"] is None:
        raise ValueError("no row has a margin and a label")
    width = (ends["high"] - ends["low"]) / cells or 1.0
    cell = F.least(F.floor((F.col("m") - F.lit(ends["low"])) / F.lit(width)), F.lit(cells - 1).cast("bigint"))
    counts = {r["cell"]: (r["n"], r["positives"]) for r in known.groupBy(cell.alias("cell")).agg(
        F.count("*").alias("n"), F.count_if("y").alias("positives")).collect()}
    order = sorted(counts)
    shares = dict(zip(order, rising([counts[c] for c in order])))
    chances, last = [], shares[order[0]]
    for c in range(cells):
        last = shares.get(c, last)
        chances.append(last)
    return Calibration(float(ends["low"]), float(width), tuple(chances))
