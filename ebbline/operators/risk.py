"""Questions about the scored customers: who is at risk, what it costs, where, of which kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.plans.skew import first_per_key

# Fixed values.
PERCENT_COLUMNS = ["p_cutoff", "f_late", "f_zero_vol", "f_anom3_vol", "f_manom3_vol"]
SAMPLE_ADDRESSES = [
    "1234 N MAIN ST, ANYTOWN, USA",
    "2345 N MAIN ST, ANYTOWN, USA",
    "3456 N MAIN ST, ANYTOWN, USA",
    "4567 N MAIN ST, ANYTOWN, USA",
]
TOTAL_FACTORS = {
    "mean_charge_tot": 0.001, "mean_charge_late": 0.001, "mean_vol": 1.0, "nCutPrior": 1.0,
}
CUSTOMER_COLUMNS = [
    "meter_address", "p_cutoff", "mean_charge_tot", "mean_charge_late", "mean_vol", "f_late",
    "nCutPrior", "municipality", "cust_type", "meter_size",
]
LONG_NAMES = {
    "p_cutoff": "Cutoff Probability (%)",
    "mean_charge_tot": "Mean Monthly Charges ($/mo)",
    "mean_charge_late": "Mean Late Charges ($/mo)",
    "mean_vol": "Mean Volume Usage (kGal/mo)",
    "f_late": "Late Payment Pct (%)",
    "nCutPrior": "Number of Prior Cutoffs",
    "meter_address": "Address",
    "cust_type": "Customer Type",
    "municipality": "Municipality",
    "meter_size": "Meter Size",
}
DEFAULT_THRESHOLD = 50.0


def risk_table(features: DataFrame, predictions: DataFrame) -> DataFrame:
    """Features with the probability of the same customer."""
    return features.join(predictions.select("occupant_id", "p_cutoff"), "occupant_id")


def as_percentages(risk: DataFrame) -> DataFrame:
    return risk.withColumns({c: F.col(c) * 100 for c in PERCENT_COLUMNS})


def one_per_location(risk: DataFrame) -> DataFrame:
    """The first customer of each location, by customer id."""
    return first_per_key(risk, ["location_id"], [F.col("occupant_id")])


def anonymize(risk: DataFrame) -> DataFrame:
    """Every address becomes one of four sample addresses, chosen by location."""
    choices = F.array(*[F.lit(a) for a in SAMPLE_ADDRESSES])
    pick = F.pmod("location_id", F.lit(len(SAMPLE_ADDRESSES))).cast("int") + 1
    return risk.withColumn(
        "meter_address", F.coalesce(F.element_at(choices, pick), F.lit(SAMPLE_ADDRESSES[0]))
    )


def dashboard_table(features: DataFrame, predictions: DataFrame) -> DataFrame:
    """What every question below is asked of."""
    return anonymize(one_per_location(as_percentages(risk_table(features, predictions))))


def at_risk(risk: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Customers at or above the threshold.  No score, or NaN (which Spark orders above all), is not."""
    return risk.filter((F.col("p_cutoff") >= float(threshold)) & ~F.isnan("p_cutoff"))


def predicted_cutoffs(risk: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    return at_risk(risk, threshold).agg(F.count(F.lit(1)).alias("predicted_cutoffs"))


def expected_values(risk: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Per feature: probability-weighted total in display units, and its mean per customer.

    All features come from one aggregation; without customers the total is 0, the mean NULL.
    """
    weighted = [
        F.coalesce(F.sum(F.col(c) * F.col("p_cutoff") / 100), F.lit(0.0)) * F.lit(factor)
        for c, factor in TOTAL_FACTORS.items()
    ]
    totals = at_risk(risk, threshold).agg(
        F.count(F.lit(1)).alias("n"),
        *[w.alias(c) for w, c in zip(weighted, TOTAL_FACTORS)],
    )
    return totals.unpivot(["n"], list(TOTAL_FACTORS), "feature", "total").select(
        "feature", "total", F.try_divide("total", "n").alias("mean"), "n"
    )


def map_points(
    risk: DataFrame, value: str, threshold: float = DEFAULT_THRESHOLD, digits: int | None = None
) -> DataFrame:
    """Points to draw.  With ``digits``, one point per rounded coordinate: count and mean value."""
    points = at_risk(risk, threshold)
    if digits is None:
        return points.select("latitude", "longitude", F.col(value).alias("value"), "meter_address")
    return points.groupBy(
        F.round("latitude", digits).alias("latitude"), F.round("longitude", digits).alias("longitude")
    ).agg(F.count(F.lit(1)).alias("customers"), F.avg(value).alias("value"))


def category_share(
    risk: DataFrame, category: str, threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """Percentage of customers per value; customers without one count as 0 % but in the total."""
    above = at_risk(risk, threshold)
    total = above.agg(F.count(F.lit(1)))
    return above.groupBy(category).agg(F.count(F.lit(1)).alias("customers")).select(
        category,
        F.when(F.col(category).isNull(), F.lit(0.0))
        .otherwise(F.col("customers") * 100.0 / total.scalar())
        .alias("share"),
    )


def category_shares(risk: DataFrame, categories: Sequence[str], threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """category, value, customers and share for several categories, from one scan.

    Customers without a value count as 0 % but in the total, as in ``category_share``.
    """
    given = at_risk(risk, threshold).select(*categories)
    sets = given.groupingSets([[F.col(c)] for c in categories], *[F.col(c) for c in categories]).agg(
        *[F.grouping(c).alias(f"_{c}") for c in categories], F.count(F.lit(1)).alias("customers"))
    category = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.lit(c)) for c in categories])
    value = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.col(c).cast("string")) for c in categories])
    total = F.sum("customers").over(Window.partitionBy("category"))
    return sets.select(category.alias("category"), value.alias("value"), "customers").withColumn(
        "share", F.when(F.col("value").isNull(), F.lit(0.0)).otherwise(F.col("customers") * 100.0 / total))


#: Halvings of the world's latitudes and longitudes; the smallest cell is some 300 m by 600 m.
DEEPEST_CELL = 16


def map_cells(
    risk: DataFrame, value: str, threshold: float | None = DEFAULT_THRESHOLD, limit: int = 1000, deepest: int = DEEPEST_CELL
) -> DataFrame:
    """cell, level, south, west, north, east, customers, value: a quadtree for maps with too many points to draw.

    A cell with more than ``limit`` customers is cut into four, down to level ``deepest``; each
    customer is in one cell.  ``cell`` names the quarters from the whole world on (0 to 3: south-west,
    south-east, north-west, north-east); ``value`` is the mean.  Customers without a place are together in a row without a cell.
    Rows are summed to the smallest cells before anything is shuffled; the tree is built from those sums.
    """
    rows = risk if threshold is None else at_risk(risk, threshold)
    top = F.lit(1 - 2.0 ** -(deepest + 1))  # the pole and the date line belong to the last cells
    y, x = ((F.col("latitude") + 90) / 180, (F.col("longitude") + 180) / 360)
    y, x = F.when(y > top, top).otherwise(y), F.when(x > top, top).otherwise(x)
    path = F.concat(*[
        (F.floor(y * 2**n) % 2 * 2 + F.floor(x * 2**n) % 2).cast("int").cast("string") for n in range(1, deepest + 1)
    ]) if deepest else F.when(x.isNotNull() & y.isNotNull(), F.lit(""))
    smallest = rows.groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.count(value).alias("v"))
    nodes = smallest.filter("path IS NOT NULL").select("*", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("level")).groupBy(
        F.expr("substring(path, 1, level)").alias("cell"), "level").agg(F.sum("n").alias("customers"), F.sum("s").alias("s"), F.sum("v").alias("v"))
    up = nodes.select(F.col("cell").alias("up"), (F.col("level") + 1).alias("level"), F.col("customers").alias("above"))
    leaves = nodes.withColumn("up", F.expr("substring(cell, 1, level - 1)")).join(up, ["up", "level"], "left").filter(
        ((F.col("customers") <= limit) | (F.col("level") == deepest)) & ((F.col("above") > limit) | (F.col("level") == 0)))
    nowhere = smallest.filter("path IS NULL").select(F.lit(None).cast("string").alias("cell"), F.lit(None).cast("int").alias("level"), F.col("n").alias("customers"), "s", "v")
    edge = F.pow(F.lit(2.0), -F.col("level"))
    digits = F.transform(F.filter(F.split("cell", ""), lambda c: c != ""), lambda c: c.cast("int"))

    def start(bit: int) -> Column:
        return F.aggregate(digits, F.lit(0.0), lambda s, d: s * 2 + (F.shiftright(d, bit) % 2)) * edge

    south, west = start(1) * 180 - 90, start(0) * 360 - 180
    return leaves.select("cell", "level", "customers", "s", "v").unionByName(nowhere).select(
        "cell", "level", south.alias("south"), west.alias("west"), (south + edge * 180).alias("north"), (west + edge * 360).alias("east"),
        "customers", F.try_divide("s", "v").alias("value"))


def customer_table(
    risk: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    limit: int | None = None,
    digits: int = 2,
    long_names: bool = True,
) -> DataFrame:
    """The report: most likely first, ten columns; with ``limit`` a top-k instead of a full sort."""
    rounded = ["p_cutoff", "mean_charge_tot", "mean_charge_late", "mean_vol", "f_late"]
    top = at_risk(risk, threshold).orderBy(F.desc("p_cutoff"), "location_id")
    top = top if limit is None else top.limit(limit)
    shown = top.select(*[
        F.bround(c, digits).alias(c) if c in rounded else F.col(c) for c in CUSTOMER_COLUMNS
    ])
    return shown.withColumnsRenamed(LONG_NAMES) if long_names else shown

