"""Window operators over ordered series of one entity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Series:
    """The rows of an entity in order of time; columns of this class share one sort."""

    def __init__(self, by: str | list[str] = "id", order: str = "d"):
        self.by, self.order = [by] if isinstance(by, str) else by, order

    @property
    def w(self) -> Window:
        return Window.partitionBy(*self.by).orderBy(self.order)

    @property
    def past(self) -> Window:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    def last(self, k: int) -> Window:
        return self.w.rowsBetween(1 - k, 0)

    def rolled(self, fn, v: Column | str, k: int, least: int | None = None) -> Column:
        """fn over the last k rows where at least `least` (k by default) of them have a value."""
        v = F.col(v) if isinstance(v, str) else v
        return F.when(F.count(v).over(self.last(k)) >= (k if least is None else least), fn(v).over(self.last(k)))

    def mean(self, v, k: int, least: int | None = None) -> Column:
        return self.rolled(F.avg, v, k, least)

    def std(self, v, k: int, least: int | None = None) -> Column:
        return self.rolled(F.stddev_samp, v, k, least)

    def total(self, v, k: int, least: int | None = None) -> Column:
        return self.rolled(F.sum, v, k, least)

    def highest(self, v, k: int, least: int | None = None) -> Column:
        return self.rolled(F.max, v, k, least)

    def lowest(self, v, k: int, least: int | None = None) -> Column:
        return self.rolled(F.min, v, k, least)

    def lag(self, v, k: int = 1) -> Column:
        return F.lag(v, k).over(self.w)

    def lead(self, v, k: int = 1) -> Column:
        return F.lead(v, k).over(self.w)

    def change(self, v: str, k: int = 1) -> Column:
        """v over its value k rows before, less 1."""
        return F.col(v) / F.nullif(self.lag(v, k), F.lit(0.0)) - 1

    def filled(self, v) -> Column:
        """The last value that is not null."""
        return F.last(v, ignorenulls=True).over(self.past)

    def index(self) -> Column:
        return F.row_number().over(self.w)

    def grown(self, r: Column | str) -> Column:
        """Running product of 1 + r."""
        r = F.col(r) if isinstance(r, str) else r
        return F.exp(F.sum(F.log1p(r)).over(self.past))

    def smoothed(self, rows: DataFrame, index: Column, block: int | None = None, **spans: tuple[str, int]) -> DataFrame:
        """rows with an exponential mean of each named (column, span): alpha 2 / (span + 1), started at the first value.

        A step y -> (1 - alpha) y + alpha x is an affine map, and so is any run of steps. Within a block of rows the map
        is a weighted running sum, whose weights stay within a double's range; the mean at a block's end then goes into
        the next one by that block's map. Series may have any length. index counts the rows from 0; a null adds nothing.
        """
        alphas = {name: 2.0 / (span + 1) for name, (_, span) in spans.items()}
        if steady := {name: v for name, (v, _) in spans.items() if alphas[name] >= 1.0}:
            rest = {name: x for name, x in spans.items() if name not in steady}
            rows = rows.withColumns({name: F.col(v) for name, v in steady.items()})
            return self.smoothed(rows, index, block, **rest) if rest else rows
        slow, fast = (f(-math.log1p(-a) for a in alphas.values()) for f in (min, max))
        # the slowest mean forgets all but e^-64 of what it had within a block, unless the fastest one's weights pass e^500
        size = block or max(1, min(math.ceil(64 / slow), int(500 / fast)))
        ends = math.ceil(45 / (size * slow))  # blocks back whose ends still weigh more than a rounding
        at = rows.withColumns({"_i": index.cast("long"), "_b": F.floor(index / size).cast("long")}).withColumn("_j", F.col("_i") - F.col("_b") * size)
        inner = Window.partitionBy(*self.by, "_b").orderBy(self.order).rowsBetween(Window.unboundedPreceding, 0)
        outer = Window.partitionBy(*self.by).orderBy("_b", self.order)
        grow = lambda a, j: F.exp(j * -math.log1p(-a))
        at = at.withColumns({
            f"_{name}": F.coalesce(F.sum(F.when(F.col("_i") == 0, 1.0).otherwise(alphas[name]) * F.col(v) * grow(alphas[name], F.col("_j"))).over(inner), F.lit(0.0)) * grow(alphas[name], -F.col("_j"))
            for name, (v, _) in spans.items()
        })
        carry = {
            name: sum((F.coalesce(F.lag(f"_{name}", 1 + k * size).over(outer), F.lit(0.0)) * (1 - a) ** (k * size) for k in range(ends)), F.lit(0.0)) for name, a in alphas.items()
        }
        at = at.withColumns({f"_c_{name}": F.when(F.col("_j") == 0, c) for name, c in carry.items()})
        past = outer.rowsBetween(Window.unboundedPreceding, 0)
        at = at.withColumns({name: F.col(f"_{name}") + F.last(f"_c_{name}", ignorenulls=True).over(past) * grow(a, -F.col("_j") - 1) for name, a in alphas.items()})
        return at.drop("_i", "_b", "_j", *(f"_{name}" for name in spans), *(f"_c_{name}" for name in spans))


def latest_row(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def runs(rows: DataFrame, by: list[str], order: str, breaks: Column, name: str = "run") -> DataFrame:
    """rows with the length so far of the run since the last break; a row that breaks starts a run of its own."""
    w = Window.partitionBy(*by).orderBy(order)
    i = F.row_number().over(w)
    # in the entity's own order: the row less the last break, without a sort by run
    since = F.coalesce(F.max(F.when(breaks, F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1))
    return rows.withColumn("_i", i).withColumn(name, F.col("_i") - since + 1).drop("_i")


def expanding_pcts(rows: DataFrame, by: str, order: str, values: dict[str, tuple[str, bool]], least: int = 60, keep: bool = True) -> DataFrame:
    """rows with, for each name: (column, whether it must be positive), the share of an entity's known values so far that are below the present one, times 100.

    Null where the value isn't known, and where fewer than `least` values are. An entity has one row for each value of
    `order`. keep: with the other columns too, else with by, order and the shares only.
    """
    w = Window.partitionBy(by).orderBy(order)
    past, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(by)
    # the n-th known value of an entity (from 0) is compared with the earlier ones by levels, as in a merge sort: at level
    # k, values in the right half of a block of 2^(k + 1) count the lower ones in its left half. n log n narrow rows; the
    # row itself goes along with one of them, and all of it stays where the entity's rows are.
    known = [F.when(F.col(c) > 0 if positive else F.col(c).isNotNull(), F.col(c).cast("double")) for c, positive in values.values()]
    counts = {f"_i{j}": F.count(v).over(past) - 1 for j, v in enumerate(known)} | {f"_m{j}": F.count(v).over(whole) for j, v in enumerate(known)}
    numbered = rows.withColumns(counts)
    rest = [c for c in rows.columns if c not in (by, order)] if keep else []
    packed = [F.struct(*rest)] if rest else []

    def levels(j: int, v: Column) -> Column:
        ks = F.when(v.isNotNull(), F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(f"_m{j}", F.lit(2)).cast("double"))).cast("int") - 1)).otherwise(F.array(F.lit(0)) if j == 0 else F.array().cast("array<int>"))
        row = lambda k: [F.when((k == 0) & F.lit(j == 0), x).alias("row") for x in packed]
        return F.transform(ks, lambda k: F.struct((k + 64 * j).alias("at"), v.alias("v"), F.col(f"_i{j}").alias("i"), *row(k)))

    each = numbered.select(F.col(by).alias("_by"), F.col(order).alias("_order"), F.explode(F.concat(*[levels(j, v) for j, v in enumerate(known)])).alias("_e")).select("_by", "_order", "_e.*")
    each = each.withColumns({"block": F.expr("shiftright(i, at % 64 + 1)"), "left": F.when(F.expr("v IS NOT NULL AND shiftright(i, at % 64) % 2 = 0"), 1).otherwise(0)})
    block = Window.partitionBy("_by", "at", "block")
    upto = F.sum("left").over(block.orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = F.sum("left").over(Window.partitionBy("_by", "at", "block", "v"))
    met = each.withColumn("below", F.when((F.col("left") == 0) & F.col("v").isNotNull(), upto - ties).otherwise(0))
    mine = lambda j, c: F.when(F.col("at").between(64 * j, 64 * j + 63) & F.col("v").isNotNull(), F.col(c))
    sums = [f(mine(j, c)).alias(f"_{c}{j}") for j in range(len(known)) for f, c in ((F.sum, "below"), (F.max, "i"))]
    row = [F.first("row", ignorenulls=True).alias("_row") for _ in packed]
    done = met.groupBy("_by", "_order").agg(*row, *sums)
    own = {by: F.col("_by").alias(by), order: F.col("_order").alias(order)}
    shares = [F.when(F.col(f"_i{j}") + 1 >= least, F.col(f"_below{j}") * 100.0 / (F.col(f"_i{j}") + 1)).alias(name) for j, name in enumerate(values)]
    return done.select(*[own.get(c, F.col(f"_row.{c}")) for c in rows.columns if c in own or c in rest], *shares)


def expanding_pct(rows: DataFrame, by: str, order: str, value: str, least: int = 60) -> DataFrame:
    """`expanding_pcts` of one column's positive values, as `pct`."""
    return expanding_pcts(rows, by, order, {"pct": (value, True)}, least)


def debounced(rows: DataFrame, by: list[str], order: str, raw: str, up: int, down: int, name: str = "state") -> DataFrame:
    """rows with the confirmed state of a boolean: it flips when `up` (or `down`) equal observations stand in a row.

    No state machine is needed: a run that has reached its length is an event, and the state is the last event.
    """
    w = Window.partitionBy(*by).orderBy(order)
    same = rows.withColumn("_before", F.lag(raw).over(w))
    ran = runs(same, by, order, F.col("_before").isNull() | (F.col("_before") != F.col(raw)), "_run")
    event = F.when(F.col("_run") >= F.when(F.col(raw), up).otherwise(down), F.col(raw))
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    return ran.withColumn(name, F.coalesce(F.last(event, ignorenulls=True).over(past), F.first(raw).over(past))).drop("_before", "_run")
