"""Registered queries: one operator each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.functions.dates import (
    as_date,
    as_datetime,
    day_label,
    days_between,
    hours_between,
    in_period,
    month_key,
    overlaps,
    parse_ymd,
    whole_days_between,
)
from sojourn.functions.nulls import ascending, descending, is_in
from sojourn.functions.text import KEPT_WORDS, SMALL_WORDS, close_path, split_path, title_case
from sojourn.operators.classify import classify
from sojourn.operators.cohort import drop_flagged, only_in, repeated, restrict_to, restrict_to_ids
from sojourn.operators.counts import (
    count_by_month,
    count_rows,
    freq,
    n_people,
    n_people_by,
    null_count,
    share,
    table_of,
)
from sojourn.operators.dedupe import collapse_episodes, dedupe_first, history, latest
from sojourn.operators.joins import crosswalk, label_codes, lookup, merge_inner
from sojourn.operators.pivot import fold_other, pivot_wide, pivot_with_total, row_total
from sojourn.operators.quantiles import duration_profile, histogram, quantiles, summary
from sojourn.operators.rolling import densify, rolling_mean_centered
from sojourn.operators.topk import top_n, top_n_with_ties, with_row_index
from sojourn.plans.fixtures import facilities, stints, table
from sojourn.plans.registry import query
from sojourn.session import scratch_path
from sojourn.sources.sinks import sink_csv, sink_dated
from sojourn.sources.tables import file_info, register, scan_csv, scan_period

# Fixed values of the test tables.
PRIORITY_KEEP = ["1-URGENT", "5-LOW", "NA"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in cols})


# Scans and sinks


@query(
    """SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders
    WHERE o_orderdate > TIMESTAMP '1996-11-20 00:00:00' AND o_orderdate <= TIMESTAMP '1998-02-10 00:00:00'"""
)
def dated_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders laid out by month, and those of a period read back from its months only."""
    path = scratch_path(spark, ".parquet")
    sink_dated(table(spark, sf_dir, "orders"), path, "o_orderdate")
    rows = scan_period(spark, path, "o_orderdate", "1996-11-20 00:00:00", "1998-02-10 00:00:00", "right")
    return rows.select("o_orderkey", "o_orderstatus", "o_orderdate")


@query(
    """SELECT o_orderkey, o_custkey, o_orderdate FROM orders
    WHERE o_orderdate > TIMESTAMP '1998-12-01 00:00:00'
      AND (o_orderpriority LIKE '%HIGH%' OR o_orderstatus = 'F')"""
)
def view_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan with its filter, named as a view, read back through the name."""
    orders = table(spark, sf_dir, "orders")
    rule = F.col("o_orderpriority").contains("HIGH") | (F.col("o_orderstatus") == "F")
    rows = orders.where(in_period(F.col("o_orderdate"), "1998-12-01 00:00:00") & rule)
    return register(rows.select("o_orderkey", "o_custkey", "o_orderdate"), "period_orders")


@query("SELECT count(*) AS n_rows, true AS all_sized FROM lineitem")
def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows over the files of a table, and whether each file has a size."""
    files = file_info(table(spark, sf_dir, "lineitem"))
    return files.agg(F.sum("n_rows").alias("n_rows"), F.min(F.col("file_size") > 0).alias("all_sized"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY ALL")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frequency table written as CSV to the shared folder and read with a declared schema."""
    counted = freq(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")
    path = scratch_path(spark, ".csv")
    sink_csv(counted, path)
    return scan_csv(spark, path, counted.schema)


@query(
    """SELECT row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS row_index, o_custkey, count(*) AS count
    FROM orders GROUP BY o_custkey"""
)
def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("count"))
    return with_row_index(counted, [*descending("count"), *ascending("o_custkey")])


# Predicates


@query(
    """SELECT count(*) FILTER (WHERE o_orderdate > '1998-12-01') AS after_midnight,
      count(*) FILTER (WHERE CAST(o_orderdate AS DATE) > DATE '1998-12-01') AS after_day,
      count(*) FILTER (WHERE CAST(o_orderdate AS DATE) >= DATE '1998-12-01') AS from_day,
      count(*) FILTER (WHERE o_orderdate > '1998-08-24' AND o_orderdate <= '1998-12-01') AS prior_period,
      count(*) FILTER (WHERE o_orderdate < '1998-12-01') AS before
    FROM orders"""
)
def period_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    day = as_date(at)
    return table(spark, sf_dir, "orders").agg(
        F.count_if(in_period(at, "1998-12-01")).alias("after_midnight"),
        F.count_if(in_period(day, "1998-12-01")).alias("after_day"),
        F.count_if(in_period(day, "1998-12-01", closed="left")).alias("from_day"),
        F.count_if(in_period(at, "1998-08-24", "1998-12-01", "right")).alias("prior_period"),
        F.count_if(in_period(at, hi="1998-12-01")).alias("before"),
    )


@query(
    """SELECT o_orderkey, o_orderpriority FROM orders
    WHERE NOT coalesce(nullif(o_orderpriority, '1-URGENT') IN ('2-HIGH', '5-LOW'), false)"""
)
def isin_nullsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT"))
    rows = table(spark, sf_dir, "orders").where(~is_in(reason, ["2-HIGH", "5-LOW"]))
    return rows.select("o_orderkey", "o_orderpriority")


@query(
    """SELECT p_partkey, p_name, p_size FROM part
    WHERE (p_size BETWEEN 7 AND 11 OR p_size = 16) AND nullif(p_type, 'ECONOMY') IS NULL"""
)
def range_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    missing = F.nullif(F.col("p_type"), F.lit("ECONOMY")).isNull()
    rows = table(spark, sf_dir, "part").where((size.between(7, 11) | (size == 16)) & missing)
    return rows.select("p_partkey", "p_name", "p_size")


@query("SELECT p_brand, count(*) AS count FROM part WHERE p_name LIKE 'small%' GROUP BY p_brand")
def prefix_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freq(table(spark, sf_dir, "part").where(F.col("p_name").startswith("small")), "p_brand")


@query(
    """SELECT l_returnflag, count(*) AS count FROM lineitem
    WHERE CASE WHEN l_discount > 0.05 THEN true WHEN l_tax < 0.04 THEN false END = false GROUP BY l_returnflag"""
)
def drop_flagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("l_discount") > 0.05, True).when(F.col("l_tax") < 0.04, False)
    return freq(drop_flagged(table(spark, sf_dir, "lineitem").withColumn("flag", flag), "flag"), "l_returnflag")


@query(
    """SELECT l_linenumber AS step, l_quantity, l_shipdate, l_extendedprice * (1 - l_discount) AS net
    FROM lineitem WHERE l_quantity > 49"""
)
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derive a column, move it to the front, drop columns by name, keep rows over a threshold."""
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 49)
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    front = rows.select(net.alias("net"), "l_quantity", "l_shipdate", F.col("l_linenumber").alias("step"), "l_tax")
    return front.drop("l_tax")


# Joins


@query(
    """SELECT o.o_custkey AS id, o.o_orderkey AS key, o.o_orderdate AS "day.x", o.o_totalprice AS "amount.x",
      e.day AS "day.y", e.amount AS "amount.y", e.event_type
    FROM orders o JOIN (SELECT user_id, event_type, min(ts) AS day, round(sum(value), 4) AS amount
                        FROM events GROUP BY user_id, event_type) e ON o.o_custkey = e.user_id"""
)
def merge_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many-to-many merge: orders of a customer with the customer's event types (at most five per customer)."""
    left = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("day"),
        F.col("o_totalprice").alias("amount"),
    )
    right = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("id"), "event_type")
        .agg(F.min("ts").alias("day"), F.round(F.sum("value"), 4).alias("amount"))
    )
    return merge_inner(left, right, "id")


@query(
    """SELECT nullif(o_orderpriority, '5-LOW') AS reason, l.n AS "n.x", r.n AS "n.y" FROM
      (SELECT nullif(o_orderpriority, '5-LOW') AS o_orderpriority, count(*) AS n FROM orders GROUP BY 1) l JOIN
      (SELECT nullif(o_orderpriority, '5-LOW') AS p, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) r
      ON l.o_orderpriority IS NOT DISTINCT FROM r.p"""
)
def merge_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null keys match each other; the right side counts a part of the rows on purpose."""
    orders = table(spark, sf_dir, "orders").withColumn("reason", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")))
    everyone = orders.groupBy("reason").agg(F.count("*").alias("n"))
    closed = orders.where(F.col("o_orderstatus") == "F").groupBy("reason").agg(F.count("*").alias("n"))
    return merge_inner(everyone, closed, "reason")


@query(
    """SELECT s_name, n_name, count(*) AS n_rows FROM lineitem
    JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal >= 500 JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL"""
)
def lookup_facility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per code, then the crosswalk; codes it lacks drop out."""
    dim = facilities(spark, sf_dir).select(
        "detention_facility_code", F.col("name").alias("s_name"), F.col("state").alias("n_name")
    )
    counted = stints(spark, sf_dir).groupBy("detention_facility_code").agg(F.count("*").alias("n_rows"))
    return lookup(counted, dim, "detention_facility_code").select("s_name", "n_name", "n_rows")


@query(
    """SELECT coalesce(s_name, CAST(l_suppkey AS VARCHAR)) AS label, count(*) AS n_rows FROM lineitem
    LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal >= 5000 GROUP BY 1"""
)
def label_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = table(spark, sf_dir, "supplier").where(F.col("s_acctbal") >= 5000)
    names = crosswalk(half.withColumn("code", F.col("s_suppkey").cast("string")), "code", "s_name")
    counted = stints(spark, sf_dir).groupBy("detention_facility_code").agg(F.count("*").alias("n_rows"))
    labelled = label_codes(counted, names, "detention_facility_code", "label")
    return labelled.groupBy("label").agg(F.sum("n_rows").alias("n_rows"))


@query(
    """SELECT event_id, user_id, event_type FROM events
    WHERE user_id IN (SELECT o_custkey FROM orders WHERE o_orderdate > '2001-01-01' AND o_orderstatus = 'F')"""
)
def cohort_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    cohort = table(spark, sf_dir, "orders").where(
        in_period(F.col("o_orderdate"), "2001-01-01") & (F.col("o_orderstatus") == "F")
    )
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("id"), "event_type")
    found = restrict_to(events, cohort.select(F.col("o_custkey").alias("id")), "id")
    return found.withColumnRenamed("id", "user_id")


@query(
    """SELECT c_custkey AS id FROM customer
    EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate > '2000-01-01'"""
)
def cohort_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = table(spark, sf_dir, "orders").where(in_period(F.col("o_orderdate"), "2000-01-01"))
    everyone = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return only_in(everyone, recent.select(F.col("o_custkey").alias("id")), "id")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM')")
def restrict_to_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return restrict_to_ids(orders, "o_orderpriority", ["1-URGENT", "3-MEDIUM"])


# Counts


@query("SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def freq_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freq(table(spark, sf_dir, "events"), "event_type")


@query(
    """SELECT CAST(o_orderdate AS DATE) AS day, nullif(o_orderstatus, 'P') AS status, count(*) AS count
    FROM orders GROUP BY ALL"""
)
def freq_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        as_date(F.col("o_orderdate")).alias("day"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status")
    )
    return freq(orders, "day", "status", sort="key")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month_year, count(*) AS count FROM orders GROUP BY 1")
def count_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by_month(table(spark, sf_dir, "orders"), "o_orderdate")


@query("SELECT count(*) AS count FROM lineitem")
def total_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rows(table(spark, sf_dir, "lineitem"))


@query("SELECT count(DISTINCT nullif(l_suppkey, 7)) + 1 AS n_people FROM lineitem")
def people_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ids; null, here made from one id, counts as one."""
    ids = table(spark, sf_dir, "lineitem").select(F.nullif(F.col("l_suppkey"), F.lit(7)).alias("id"))
    return n_people(ids, "id")


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS n_people FROM lineitem GROUP BY l_returnflag")
def people_count_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n_people_by(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_partkey")


@query("SELECT o_custkey, count(*) AS count FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "orders"), "o_custkey", more_than=12)


@query(
    """SELECT o_orderkey, id FROM (SELECT o_orderkey, o_custkey AS id FROM orders)
    WHERE id IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 12)"""
)
def repeat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the keys that a group filter kept."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id"))
    return restrict_to(orders, repeated(orders, "id", more_than=12), "id")


@query("SELECT nullif(l_linenumber, 3) AS l_linenumber, count(*) AS count FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1")
def freq_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-way table of an integer; its nulls are left out."""
    steps = table(spark, sf_dir, "lineitem").select(F.nullif(F.col("l_linenumber"), F.lit(3)).alias("l_linenumber"))
    return table_of(steps, "l_linenumber")


@query(
    """SELECT round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 9) AS over_50,
      round(100.0 * sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) / count(*), 9) AS percent_view,
      count(*) FILTER (WHERE nullif(event_type, 'error') IS NULL) AS n_null
    FROM events"""
)
def share_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    shares = table(spark, sf_dir, "events").agg(
        share(F.col("value") > 50).alias("over_50"),
        (share(kind == "view") * 100).alias("percent_view"),
        null_count(F.nullif(kind, F.lit("error"))).alias("n_null"),
    )
    return rounded(shares, "over_50", "percent_view", digits=9)


# Order statistics


@query("SELECT round(quantile_cont(value, 0.9), 9) AS p90 FROM events")
def quantile_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quantiles(table(spark, sf_dir, "events"), "value", {"p90": 0.9})
    return rounded(found, "p90", digits=9)


@query(
    """SELECT event_type, round(quantile_cont(value, 0.1), 9) AS p10, round(median(value), 9) AS p50
    FROM events GROUP BY event_type"""
)
def quantiles_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quantiles(table(spark, sf_dir, "events"), "value", {"p10": 0.1, "p50": 0.5}, ["event_type"])
    return rounded(found, "p10", "p50", digits=9)


@query(
    """SELECT round(min(v), 6) AS "min", round(quantile_cont(v, 0.25), 6) AS q1, round(median(v), 6) AS "median",
      round(avg(v), 6) AS mean, round(quantile_cont(v, 0.75), 6) AS q3, round(max(v), 6) AS "max",
      count(*) FILTER (WHERE v IS NULL) AS n_null
    FROM (SELECT CASE WHEN event_type <> 'error' THEN value END AS v FROM events)"""
)
def summary6(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("event_type") != "error", F.col("value"))
    found = summary(table(spark, sf_dir, "events").select(known.alias("v")), "v")
    return rounded(found, "min", "q1", "median", "mean", "q3", "max")


@query(
    """SELECT CAST(bin * 20 AS DOUBLE) AS bin_from, CAST((bin + 1) * 20 AS DOUBLE) AS bin_to, count(*) AS count FROM
      (SELECT greatest(CAST(ceil(value / 20.0) AS BIGINT) - 1, 0) AS bin FROM events) GROUP BY bin"""
)
def histogram_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(table(spark, sf_dir, "events"), "value", width=20)


@query(
    """SELECT l_suppkey, round(avg(d), 6) AS avg_stint_days, round(median(d), 6) AS median_stint_days,
      round(max(d), 6) AS max_stint_days, count(*) AS n_stints, count(DISTINCT l_partkey) AS n_people
    FROM (SELECT l_suppkey, l_partkey, date_diff('microsecond', o_orderdate, l_shipdate) / 8.64e10 AS d
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY l_suppkey"""
)
def duration_profile_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rows = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey")
    rows = rows.select("l_suppkey", "l_partkey", days_between(F.col("o_orderdate"), F.col("l_shipdate")).alias("d"))
    profile = duration_profile(rows, "l_suppkey", "d", "l_partkey")
    return rounded(profile, "avg_stint_days", "median_stint_days", "max_stint_days")


# Deduplication

FIRST = """SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM
  (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")


@query(FIRST, name="dedupe_first")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_first(_orders(spark, sf_dir), ["o_custkey", "o_orderdate"], ascending("o_orderkey"))


@query(
    """SELECT o_custkey, day, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
        ORDER BY day DESC NULLS FIRST, o_orderkey DESC) AS rn
      FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice < 480000 THEN o_orderdate END AS day FROM orders))
    WHERE rn = 1"""
)
def latest_per_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last order per customer; a missing date, here made from the price, counts as the last."""
    day = F.when(F.col("o_totalprice") < 480000, F.col("o_orderdate")).alias("day")
    return latest(table(spark, sf_dir, "orders").select("o_custkey", day, "o_orderkey"), "o_custkey", "day", ["o_orderkey"])


@query(
    """SELECT o_custkey, min(o_orderdate) AS o_orderdate, CAST(count(*) AS BIGINT) AS n_stints, count(*) AS n_rows
    FROM orders GROUP BY o_custkey""",
    name="collapse_episodes",
)
def collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", F.lit(1).alias("n_stints"))
    return collapse_episodes(rows, "o_custkey", "o_orderdate", "n_stints")


@query(
    """SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position,
      o_orderpriority || '; ' AS path FROM orders""",
    name="concat_over",
)
def path_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path strings of every person in order, one per row."""
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderdate", "o_orderkey", close_path(F.col("o_orderpriority")).alias("path")
    )
    return history(rows, "o_custkey", "o_orderdate", "path", ["o_orderkey"])


# Reshape and rolling means

DAILY = "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL"
ROLLED = f"""SELECT day, event_type, n, CASE WHEN count(*) OVER w = 7 THEN round(avg(n) OVER w, 6) ELSE 0 END AS rolling_avg
  FROM ({DAILY}) WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"""


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("day", as_date(F.col("ts")))
    return events.groupBy("day", "event_type").agg(F.count("*").alias("n"))


def _cells(expr: str, types: list[str] = EVENT_TYPES) -> str:
    return ", ".join(f"""{expr.format(t=t)} AS "{t}" """ for t in types)


@query(ROLLED)
def rolling_mean_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rolling_mean_centered(_daily(spark, sf_dir), ["event_type"], "day", "n"), "rolling_avg")


@query(
    f"""SELECT event_type, CAST(d.day AS DATE) AS day, coalesce(n, 0) AS n FROM
      (SELECT event_type, unnest(range(min(day), max(day) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day FROM ({DAILY}) GROUP BY 1) d
      LEFT JOIN ({DAILY}) USING (event_type, day)"""
)
def calendar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts with a row for every day."""
    return densify(_daily(spark, sf_dir), ["event_type"], "day", "n")


@query(f"SELECT day, {_cells("max(CASE WHEN event_type = '{t}' THEN rolling_avg END)")} FROM ({ROLLED}) GROUP BY day")
def rolling_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = rolling_mean_centered(_daily(spark, sf_dir), ["event_type"], "day", "n")
    return rounded(pivot_wide(rolled, ["day"], "event_type", "rolling_avg", EVENT_TYPES), *EVENT_TYPES)


@query(f"SELECT day, {_cells("sum(CASE WHEN event_type = '{t}' THEN n END)::BIGINT")} FROM ({DAILY}) GROUP BY day")
def pivot_day_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_wide(_daily(spark, sf_dir), ["day"], "event_type", "n", EVENT_TYPES)


@query(
    f"""SELECT user_id, {_cells("count(*) FILTER (WHERE event_type = '{t}')", ["click", "purchase", "signup", "view"])},
      count(*) FILTER (WHERE event_type = 'error') AS "NA" FROM events GROUP BY user_id"""
)
def pivot_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing cells as 0, and the null name (here made from one type) as the column NA."""
    named = table(spark, sf_dir, "events").withColumn("kind", F.nullif(F.col("event_type"), F.lit("error")))
    counted = named.groupBy("user_id", "kind").agg(F.count("*").alias("n"))
    return pivot_wide(counted, ["user_id"], "kind", "n", ["click", "purchase", "signup", "view", "NA"], fill=0)


@query(
    """SELECT user_id, nullif(count(*) FILTER (WHERE event_type = 'click'), 0) AS click,
      nullif(count(*) FILTER (WHERE event_type = 'error'), 0) AS "NA",
      count(*) AS total, count(*) FILTER (WHERE event_type NOT IN ('click', 'error')) AS other
    FROM events GROUP BY user_id"""
)
def pivot_total_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "events").withColumn("kind", F.nullif(F.col("event_type"), F.lit("error")))
    return pivot_with_total(named, "user_id", "kind", keep=["click", "NA"])


@query(
    f"""SELECT user_id, {_cells("nullif(count(*) FILTER (WHERE event_type = '{t}'), 0)")}, count(*) AS total
    FROM events GROUP BY user_id"""
)
def pivot_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names are found in the data."""
    return pivot_with_total(table(spark, sf_dir, "events"), "user_id", "event_type")


@query(
    """SELECT s_suppkey, coalesce(CASE WHEN s_acctbal >= 0 THEN s_acctbal END, 0) + coalesce(nullif(s_nationkey, 3), 0)
      AS total FROM supplier"""
)
def row_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("a"),
        F.nullif(F.col("s_nationkey"), F.lit(3)).alias("b"),
    )
    return cells.select("s_suppkey", row_total(["a", "b"]).alias("total"))


@query(
    """SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN o_orderpriority ELSE 'other' END AS reason,
      count(*) AS count FROM orders GROUP BY 1"""
)
def fold_to_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = fold_other("o_orderpriority", ["1-URGENT", "5-LOW"]).alias("reason")
    return freq(table(spark, sf_dir, "orders").select(folded), "reason")


# Sorts with a limit


@query(
    """SELECT o_custkey, count FROM (SELECT o_custkey, count(*) AS count FROM orders GROUP BY o_custkey)
    ORDER BY count DESC, o_custkey LIMIT 15""",
    name="top_n",
)
def first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("count"))
    return top_n(counted, [*descending("count"), *ascending("o_custkey")], 15)


@query(
    """SELECT o_custkey, count FROM (SELECT o_custkey, count(*) AS count, rank() OVER (ORDER BY count(*) DESC) AS r
      FROM orders GROUP BY o_custkey) WHERE r <= 10"""
)
def top10_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("count"))
    return top_n_with_ties(counted, "count", 10)


# Scalar functions


def _sql_list(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


TITLE = f"""array_to_string(list_transform(
    regexp_extract_all(lower({{x}}), '[ \\-/"()\\n\\t]|[^ \\-/"()\\n\\t]+'),
    lambda w, i: CASE WHEN (i > 1 AND w IN ({_sql_list(SMALL_WORDS)})) OR w IN ({_sql_list(KEPT_WORDS)}) OR length(w) = 1
      THEN w ELSE upper(w[1]) || w[2:] END), '')"""


@query(
    f"""SELECT p_partkey, {TITLE.format(x="CASE WHEN p_size < 48 THEN p_name || ' of the ' || p_type || '-OR-' || p_brand END")}
      AS title FROM part""",
    name="title_case",
)
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(" of the "), "p_type", F.lit("-OR-"), "p_brand")
    shown = F.when(F.col("p_size") < 48, F.upper(raw))
    return table(spark, sf_dir, "part").select("p_partkey", title_case(shown).alias("title"))


@query(
    """SELECT o_orderkey, o_orderpriority || '; ' || o_orderstatus || '; ' AS path, 2 AS n_places,
      o_orderpriority AS first_place, o_orderstatus AS last_place FROM orders"""
)
def path_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = close_path(F.concat("o_orderpriority", F.lit("; "), "o_orderstatus"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"))
    places = split_path(F.col("path"))
    return rows.select(
        "o_orderkey", "path", F.size(places).alias("n_places"),
        F.element_at(places, 1).alias("first_place"), F.element_at(places, -1).alias("last_place"),
    )


@query(
    """SELECT event_id, CAST(ts AS DATE) AS day, strftime(ts, '%Y-%m') AS month_year, strftime(ts, '%b %d, %Y') AS label,
      CASE WHEN value > 20 THEN CAST(ts AS DATE) END AS parsed,
      round(date_diff('microsecond', TIMESTAMP '2024-01-10 12:00:00', ts) / 3.6e9, 6) AS hours,
      round(date_diff('microsecond', TIMESTAMP '2024-01-10 12:00:00', ts) / 8.64e10, 6) AS days,
      CAST(floor(date_diff('microsecond', TIMESTAMP '2024-01-10 12:00:00', ts) / 8.64e10) AS BIGINT) AS whole_days,
      CAST(ts AS DATE) BETWEEN DATE '2024-01-07' AND DATE '2024-01-13' AS in_week
    FROM events"""
)
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    noon = as_datetime(F.lit("2024-01-10 12:00:00"))
    text = F.when(F.col("value") > 20, F.date_format(ts, "yyyy-MM-dd")).otherwise("no date")
    week = (F.to_date(F.lit("2024-01-07")), F.to_date(F.lit("2024-01-13")))
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        as_date(ts).alias("day"),
        month_key(ts).alias("month_year"),
        day_label(ts).alias("label"),
        parse_ymd(text).alias("parsed"),
        hours_between(noon, ts).alias("hours"),
        days_between(noon, ts).alias("days"),
        whole_days_between(noon, ts).cast("long").alias("whole_days"),
        overlaps(as_date(ts), as_date(ts), *week).alias("in_week"),
    )
    return rounded(rows, "hours", "days")


@query(
    """SELECT coalesce(CASE WHEN value < 10 THEN 'low' WHEN value < 100 THEN 'middle' WHEN event_type = 'error' THEN 'error'
      END, 'none') AS label, count(*) AS count FROM events GROUP BY 1"""
)
def classify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules without a default; the null label is then replaced."""
    value = F.col("value")
    rules = [(value < 10, "low"), (value < 100, "middle"), (F.col("event_type") == "error", "error")]
    labelled = table(spark, sf_dir, "events").select(classify(rules).alias("label")).na.fill("none")
    return freq(labelled, "label")

