"""Volume profiles: where the volume of the last bars was traded, seen from chosen bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .technical import chase_band
from .windows import Series

S = Series()
#: Least bars of a profile, and the jumps between two bars that are read as a change of scale: fixed values.
LEAST, LOW, HIGH = 30, 0.7, 1.5
#: Volume of a high and of a low node, as shares of the fullest bin's; least distance of a resistance: fixed values.
HIGH_NODE, LOW_NODE, CLEAR = 0.25, 0.10, 1.005
#: A price is strong above the centre from this share of the chase band on, between two bounds: fixed values.
STRONG, STRONG_LEAST, STRONG_MOST = 0.4, 10.0, 25.0


def windows_of(bars: DataFrame, chosen: Column, window: int) -> DataFrame:
    """(id, d, cur, band, p, volume): for each chosen bar, its last `window` bars with prices in its own scale.

    A jump out of LOW..HIGH rescales all earlier prices, by a product over the jumps between the two bars: a difference
    of running logarithms. A bar goes to the chosen ones that can see it, by one window and no join.
    """
    jump = F.col("close") / S.lag("close")
    rows = chase_band(bars).withColumn("_ln", F.when((jump < LOW) | (jump > HIGH), F.ln(jump)).otherwise(0.0)).withColumn("_scale", F.sum("_ln").over(S.past))
    now = F.when(chosen, F.struct("d", F.col("close").alias("cur"), F.bround("band", 1).alias("band"), F.col("_scale").alias("to")))
    seen = rows.select("id", "close", "volume", "_scale", F.collect_list(now).over(S.w.rowsBetween(0, window - 1)).alias("seen")).select("id", "close", "volume", "_scale", F.explode("seen").alias("now"))
    return seen.select("id", "now.d", "now.cur", "now.band", (F.col("close") * F.exp(F.col("now.to") - F.col("_scale"))).alias("p"), "volume")


def volume_profiles(bars: DataFrame, chosen: Column, window: int = 90, bins: int = 30, area: float = 0.7) -> DataFrame:
    """One row per chosen bar of bars (id, d, t, high, low, close, volume): where it stands in the profile of its last `window` bars.

    id, d, cur; poc, val, vah (the fullest bin, the lower of equals, and the span of the bins, fullest first, that hold
    `area` of the volume), distance (percent above poc), status (above, below, strong or inside), support, resistance,
    high_nodes (bins, fullest first), low_nodes (bins), confidence. Bars with fewer than LEAST before them, or of one
    price or no volume, have none. Prices are those of the bins' centres, to cents, half even.
    """
    at = Window.partitionBy("id", "d")
    keys = ("id", "d", "cur", "band", "_lo", "_w", "_n")
    each = windows_of(bars, chosen, window).withColumns({"_lo": F.min("p").over(at), "_hi": F.max("p").over(at), "_n": F.count("*").over(at)}).where(f"_n >= {LEAST} AND _hi > _lo")
    each = each.withColumn("_w", (F.col("_hi") - F.col("_lo")) / bins)
    bin_of = lambda p: F.least(F.lit(bins - 1), F.floor((p - F.col("_lo")) / F.col("_w")).cast("int"))
    full = each.groupBy(*keys, bin_of(F.col("p")).alias("bin")).agg(F.sum("volume").alias("v"))
    before = F.coalesce(F.sum("v").over(at.orderBy(F.desc("v"), F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = full.withColumns({"_before": before, "_all": F.sum("v").over(at), "_top": F.max("v").over(at)}).where("_all > 0")
    taken = F.when(F.col("_before") < F.col("_all") * area, F.col("bin"))
    nodes = F.sort_array(F.collect_list(F.when(F.col("v") >= F.col("_top") * HIGH_NODE, F.struct((-F.col("v")).alias("less"), "bin"))))
    found = full.groupBy(*keys, "_all", "_top").agg(
        F.min(F.when(F.col("v") == F.col("_top"), F.col("bin"))).alias("_p"), F.min(taken).alias("_a"), F.max(taken).alias("_z"),
        F.transform(nodes, lambda x: x["bin"]).alias("high_nodes"), F.collect_list(F.when(F.col("v") > F.col("_top") * LOW_NODE, F.col("bin"))).alias("_busy"),
    )
    centre = lambda b: F.col("_lo") + (b + 0.5) * F.col("_w")
    found = found.withColumns({"_poc": centre(F.col("_p")), "_val": centre(F.col("_a")), "_vah": centre(F.col("_z")), "_here": bin_of(F.col("cur")), "low_nodes": F.array_except(F.sequence(F.lit(0), F.lit(bins - 1)), "_busy")})
    found = found.withColumn("distance", (F.col("cur") - F.col("_poc")) / F.col("_poc") * 100)
    strong = F.bround(F.greatest(F.least(F.col("band") * STRONG, F.lit(STRONG_MOST)), F.lit(STRONG_LEAST)), 1)
    dear = (F.col("cur") > F.col("_poc")) & (F.col("distance") >= F.col("band")) | (F.col("cur") > F.col("_vah"))
    status = F.when(dear, "above").when(F.col("cur") < F.col("_val"), "below").when((F.col("cur") > F.col("_poc")) & (F.col("distance") >= strong), "strong").otherwise("inside")
    levels = F.transform("high_nodes", lambda b: F.col("_lo") + (b + 0.5) * F.col("_w"))
    edge = F.col("_lo") + F.col("_here") * F.col("_w")
    under = lambda bound: F.array_max(F.filter("_levels", bound))
    standing = under(lambda x: x <= F.col("cur"))
    support = F.when(F.col("status") == "above", under(lambda x: x < edge)).when(F.col("status") == "strong", standing).otherwise(F.when(F.col("_poc") <= F.col("cur"), F.col("_poc")).otherwise(standing))
    resistance = F.array_min(F.filter("_levels", lambda x: x > F.greatest(edge + F.col("_w"), F.col("cur") * CLEAR)))
    sharp = F.least(F.col("_top") / F.col("_all") * bins / 3.0, F.lit(1.0))
    found = found.withColumns({"status": status, "_levels": levels})
    cents = lambda x: F.bround(x, 2)
    return found.select(
        "id", "d", "cur", *[cents(F.col(f"_{c}")).alias(c) for c in ("poc", "val", "vah")], "distance", "status", cents(support).alias("support"), cents(resistance).alias("resistance"), "high_nodes", "low_nodes",
        F.bround(F.least(F.lit(100.0), 60.0 * F.least(F.lit(1.0), F.col("_n") / float(window)) + 40.0 * sharp)).alias("confidence"),
    )
