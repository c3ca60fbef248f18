"""Statistics of the table and of events: counts, gauges, histograms, differences; all aggregates combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.functions.prefix import BITS
from prefixlake.operators.ingresses import sessions


def store_counts(rib: DataFrame) -> DataFrame:
    """Routes and distinct prefixes of each store and family. Prefixes are made distinct once, for all three counts."""
    per = rib.groupBy("safi", *BITS).agg(F.count("*").alias("n"))
    four, six = F.col("afi") == 1, F.col("afi") == 2
    return per.groupBy("safi").agg(
        F.sum("n").alias("routes"), F.sum(F.when(four, F.col("n")).otherwise(0)).alias("routes_v4"), F.sum(F.when(six, F.col("n")).otherwise(0)).alias("routes_v6"),
        F.count("*").alias("prefixes"), F.count(F.when(four, 1)).alias("prefixes_v4"), F.count(F.when(six, 1)).alias("prefixes_v6"),
    )


def top_ingresses(active: DataFrame, k: int) -> DataFrame:
    return active.groupBy("mui").agg(F.count("*").alias("routes")).orderBy(F.desc("routes"), "mui").limit(k)


def first_prefixes(routes: DataFrame, most: int = 50_000) -> DataFrame:
    """The first ``most`` prefixes by family, length and address, as a view shows them, and their routes."""
    return routes.groupBy(*BITS).agg(F.count("*").alias("routes")).orderBy(*BITS).limit(most)


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` and their ``place`` (from 1) by ``order``. Rows are dealt by ranges of the order; a window numbers each range's rows, another one the ranges alone."""
    dealt = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    before = dealt.groupBy("__part").agg(F.count("*").alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__k", within).join(before, "__part").withColumn("place", F.col("__before") + F.col("__k")).drop("__part", "__before", "__k")


def adj_rib_in(active: DataFrame, ingresses: DataFrame) -> DataFrame:
    """Active routes of each session and family; path children count for their session."""
    per = active.groupBy("mui", "afi", "safi").agg(F.count("*").alias("n"))
    s = sessions(ingresses).withColumnRenamed("id", "mui")
    return per.join(s, "mui", "left").groupBy(F.coalesce("session", "mui").alias("session"), "afi", "safi").agg(F.sum("n").alias("adj_rib_in"))


def update_counts(events: DataFrame) -> DataFrame:
    kind = lambda k: F.count(F.when(F.col("kind") == k, 1))
    return events.groupBy("mui").agg(F.count("*").alias("updates"), kind("announce").alias("announcements"), kind("withdraw").alias("withdrawals"))


def observed(active: DataFrame) -> DataFrame:
    """Routes of each mui and what their attributes hold: communities 1, large communities 4, only-to-customer 8."""
    a = F.col("attrs")
    bit = lambda c, v: F.max(F.when(c, v).otherwise(0))
    some = lambda c: F.coalesce(F.size(a[c]) > 0, F.lit(False))
    return active.groupBy("mui").agg(F.count("*").alias("routes"), (bit(some("communities"), 1) + bit(some("large_communities"), 4) + bit(a["otc"].isNotNull(), 8)).alias("observed"))


def packed(active: DataFrame, most: int) -> DataFrame:
    """Messages of at most ``most`` prefixes: mui, afi, attrs, message, n. Prefixes of a peer and family with equal attributes share messages.

    A prefix's place comes from a window over its group, so a group is never held whole.
    """
    key = F.to_json("attrs")
    group = Window.partitionBy("mui", "afi", "__key").orderBy("plen", "p_hi", "p_lo")
    rows = active.withColumn("__key", key).withColumn("message", F.floor((F.row_number().over(group) - 1) / most))
    return rows.groupBy("mui", "afi", "__key", "message").agg(F.count("*").alias("n"), F.first("attrs").alias("attrs")).drop("__key")


def update_report(events: DataFrame, bucket: Column) -> DataFrame:
    """Of each mui and bucket: announcements, withdrawals, and prefixes announced for the first time."""
    first = F.min(F.when(F.col("kind") == "announce", F.col("seq"))).over(Window.partitionBy("safi", *BITS, "mui"))
    rows = events.where(F.col("kind").isin("announce", "withdraw")).withColumn("__first", (F.col("seq") == first) & (F.col("kind") == "announce"))
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("mui", bucket).agg(n(F.col("__first")).alias("new_prefixes"), n(F.col("kind") == "announce").alias("announcements"), n(F.col("kind") == "withdraw").alias("withdrawals"))


def stat_rows(active: DataFrame) -> DataFrame:
    """Rows of a statistics report: total routes in Adj-RIB-In (7), those per family (9), and duplicate updates (13, not tracked: 0)."""
    top = 4294967295
    n = lambda a: F.least(F.count(F.when((F.col("afi") == a) & (F.col("safi") == 1), 1)), F.lit(top))
    per = active.groupBy("mui").agg(F.count("*").alias("total"), n(1).alias("v4"), n(2).alias("v6"))
    return per.selectExpr("mui", "stack(4, 7, 0, total, 9, 1, v4, 9, 2, v6, 13, 0, 0L) AS (stat, afi, value)")


def bucket(n: Column) -> Column:
    """The bound of the histogram's bucket that ``n`` falls in."""
    out = F.when(n <= 1, "1")
    for le in (10, 100, 1000, 10000):
        out = out.when(n <= le, str(le))
    return out.otherwise("+Inf")


def epochs(events: DataFrame) -> DataFrame:
    """``events`` and the number of downs of their mui up to them."""
    by = Window.partitionBy("mui").orderBy("seq")
    return events.withColumn("epoch", F.count(F.when(F.col("kind") == "peer_down", 1)).over(by))


def uptime(changes: DataFrame, now: Column) -> DataFrame:
    """peer, its last state, and the seconds since it was last established (null if it isn't). ``changes`` has peer, state, seq, ts."""
    idle = F.max(F.when(F.col("state") != "Established", F.col("seq")).otherwise(-1)).over(Window.partitionBy("peer"))
    rows = changes.withColumn("idle", idle)
    last = rows.groupBy("peer").agg(F.max_by("state", "seq").alias("state"), F.min(F.when(F.col("seq") > F.col("idle"), F.col("ts"))).alias("since"))
    up = F.unix_timestamp(now) - F.unix_timestamp(F.date_trunc("second", "since"))
    return last.select("peer", "state", F.when(F.col("state") == "Established", up).alias("up_seconds"))


def begin(lines: DataFrame, hit: Column) -> DataFrame:
    """The lines from the first hit on; one aggregate finds it."""
    first = lines.where(hit).agg(F.min("line").alias("__from"))
    return lines.join(F.broadcast(first), F.col("line") >= F.col("__from")).drop("__from")


def sides(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the side that has them: only_a, only_b, both."""
    rows = a.select(*keys, F.lit(1).alias("s")).unionByName(b.select(*keys, F.lit(2).alias("s")))
    seen = rows.groupBy(*keys).agg(F.bit_or("s").alias("s"))
    return seen.select(*keys, F.when(F.col("s") == 3, "both").when(F.col("s") == 1, "only_a").otherwise("only_b").alias("side"))


def routes_diff(active: DataFrame, a: int, b: int) -> DataFrame:
    """Prefixes of two ingresses, and which has them."""
    return sides(active.where(F.col("mui") == a), active.where(F.col("mui") == b), BITS)


def roles_fit(a: Column, b: Column) -> Column:
    """Whether two BGP roles fit: provider and customer, route server and its client, two peers; null if one is missing."""
    pair = F.concat_ws("|", a, b)
    fits = ["provider|customer", "customer|provider", "rs|rs-client", "rs-client|rs", "peer|peer"]
    return F.when(a.isNotNull() & b.isNotNull(), pair.isin(fits))


BOUNDS = (1, 10, 100, 1000, 10000)


def histogram(values: DataFrame, value: str) -> DataFrame:
    """le, n and total: the number and the sum of the values up to each bound, cumulative; ``+Inf`` last. One aggregate of constant size."""
    up = lambda b: F.col(value) <= b if b else F.lit(True)
    bounds = [*BOUNDS, None]
    one = values.agg(*(F.count(F.when(up(b), 1)).alias(f"n{k}") for k, b in enumerate(bounds)), *(F.coalesce(F.sum(F.when(up(b), F.col(value))), F.lit(0)).alias(f"t{k}") for k, b in enumerate(bounds)))
    rows = F.array(*(F.struct(F.lit(str(b) if b else "+Inf").alias("le"), F.col(f"n{k}").alias("n"), F.col(f"t{k}").alias("total")) for k, b in enumerate(bounds)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def set_sides(local: Column, remote: Column) -> tuple[Column, Column, Column]:
    """What only one side can, what only the other can, and what both can; sorted."""
    return F.array_sort(F.array_except(local, remote)), F.array_sort(F.array_except(remote, local)), F.array_sort(F.array_intersect(local, remote))
