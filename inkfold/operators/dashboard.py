"""Aggregates and pages over the audit log and the tables around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: A median is looked for among so many equal ranges at a time.
RANGES = 1 << 16


def _kth(values: DataFrame, rank: int, low: int, high: int) -> tuple[int, int]:
    """The value (column v, whole numbers from low to high) with `rank` values before it in order, and how many are at most it.
    Each scan counts the values in RANGES equal ranges and goes on in the one that holds the rank, so nothing that grows with the
    values is kept anywhere; values that differ by less than 2**16 take one scan."""
    before = 0
    while True:
        width = -(-(high - low + 1) // RANGES)
        within = values.where(F.col("v").between(low, high))
        bins = within.groupBy(F.expr(f"(v - {low}) div {width}").alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(bins, key=lambda r: r["bin"]):
            if before + r["n"] > rank:
                break
            before += r["n"]
        low = low + r["bin"] * width
        high = min(high, low + width - 1)
        if width == 1:
            return low, before + r["n"]


def median(log: DataFrame, column: str) -> int | None:
    """The exact median of a column of whole numbers, nulls apart, rounded half to even; None without any."""
    values = log.select(F.col(column).cast("long").alias("v")).where("v is not null")
    n, low, high = values.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if not n:
        return None
    first, upto = _kth(values, (n - 1) // 2, low, high)
    second = first if upto > n // 2 else values.where(F.col("v") > first).agg(F.min("v")).first()[0]
    whole, rest = divmod(first + second, 2)
    return whole + (whole & 1 if rest else 0)


def totals(log: DataFrame) -> DataFrame:
    """One row: total_requests, blocked_requests, median_latency_ms (exact, nulls apart, rounded half to even). The median is
    looked for when this is called, in a few scans of its column."""
    return log.agg(F.count(F.lit(1)).alias("total_requests"), F.count_if("blocked").alias("blocked_requests")).withColumn("median_latency_ms", F.lit(median(log, "latency_ms")).cast("long"))


def by_provider(log: DataFrame) -> DataFrame:
    return log.groupBy("provider").agg(F.count(F.lit(1)).alias("n_requests"))


def by_entity(log: DataFrame) -> DataFrame:
    """Totals of the counts by type. entity_counts is a map; values that aren't whole numbers are skipped."""
    return log.select(F.explode("entity_counts").alias("entity_type", "n")).groupBy("entity_type").agg(F.coalesce(F.sum(F.col("n").try_cast("long")), F.lit(0)).alias("n_entities"))


def shares(counted: DataFrame, name: str, n: str) -> DataFrame:
    """Counts in descending order, with the grand total and each one's ratio to the largest."""
    every = Window.partitionBy()
    return counted.withColumns({"grand_total": F.sum(n).over(every), "scale": F.try_divide(F.col(n), F.max(n).over(every))}).orderBy(F.desc(n), name)


def filtered(log: DataFrame, team: str | None = None, *, provider: str | None = None, blocked: bool | None = None) -> DataFrame:
    for column, wanted in (("team_id", team), ("provider", provider), ("blocked", blocked)):
        if wanted is not None:
            log = log.where(F.col(column) == wanted)
    return log


def audit_page(log: DataFrame, limit: int = 50, offset: int = 0, team: str | None = None, **filters) -> DataFrame:
    """A page of events, the newest first. provider and blocked are further filters."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset 0 or more")
    return filtered(log, team, **filters).orderBy(F.desc("id")).offset(offset).limit(limit)


#: Ids are serial numbers; so many in a row make a block of a clustered log.
BLOCK = 1 << 16


def cluster(log: DataFrame, path: str) -> None:
    """Append events to a log that is kept in blocks of ids, with the number of each team's events in each block beside it. A
    block that gets events twice has its numbers in two rows."""
    blocks = log.withColumn("block", F.expr(f"id div {BLOCK}"))
    blocks.repartition("block").sortWithinPartitions("block", "id").write.mode("append").partitionBy("block").parquet(f"{path}/events")
    blocks.groupBy("block", "team_id").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("append").parquet(f"{path}/counts")


def clustered_page(spark: SparkSession, path: str, page: int, limit: int = 50, team: str | None = None) -> DataFrame:
    """A page (from 1) of a clustered log, the newest events first. The counts tell which blocks hold it, and only those are
    read, so a deep page costs what the first one does."""
    if not 1 <= limit <= 500 or page < 1:
        raise ValueError("limit must be 1 to 500 and page 1 or more")
    counts = filtered(spark.read.parquet(f"{path}/counts"), team).groupBy("block").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, 0))
    skip = (page - 1) * limit
    held = counts.withColumn("upto", upto).where((F.col("upto") > skip) & (F.col("upto") - F.col("n") < skip + limit)).collect()
    before = min((r["upto"] - r["n"] for r in held), default=0)
    rows = spark.read.parquet(f"{path}/events").where(F.col("block").isin([r["block"] for r in held]))
    return filtered(rows, team).drop("block").orderBy(F.desc("id")).offset(skip - before if held else 0).limit(limit)


def audit_total(log: DataFrame, team: str | None = None, **filters) -> DataFrame:
    """How many events the pages of the same filters hold: one row, total."""
    return filtered(log, team, **filters).agg(F.count(F.lit(1)).alias("total"))


def latest_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1 to 200")
    return runs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def newest_policies(policies: DataFrame) -> DataFrame:
    return policies.orderBy(F.desc("created_at"), F.desc("policy_id"))


def page_bounds(total: Column, offset: Column, limit: Column) -> Column:
    """The first and last row shown, the page and the number of pages."""
    return F.struct(
        F.when(total > 0, offset + 1).otherwise(0).cast("long").alias("first_row"),
        F.least(offset + limit, total).cast("long").alias("last_row"),
        (F.floor(offset / limit) + 1).cast("long").alias("page"),
        F.greatest(F.lit(1), F.ceil(total / limit)).cast("long").alias("pages"),
    )


def sorted_counts(counts: Column) -> Column:
    """A map's entries as an array, the largest count first, then by name."""
    entries = F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("down"), e["key"].alias("entity_type"), e["value"].alias("n")))
    return F.transform(F.array_sort(entries), lambda e: F.struct(e["entity_type"], e["n"]))


def score_band(score: Column) -> Column:
    return F.when(score.isNull(), "none").when(score >= 0.9, "good").otherwise("fair")


def shown_date(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm"), F.lit("–"))
