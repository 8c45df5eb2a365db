"""The driver's test tables in the shape of the analyses' inputs (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.session import tune
from sojourn.sources.tables import scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table."""
    return scan(tune(spark), f"{sf_dir}/{name}.parquet")


REASON = """CASE
    WHEN o_orderstatus = 'O' THEN NULL
    WHEN o_orderpriority = '1-URGENT' THEN 'Removed'
    WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN 'Voluntary departure'
    WHEN o_orderstatus = 'F' AND o_orderpriority = '3-MEDIUM' THEN 'Bonded Out - IJ'
    WHEN o_orderstatus = 'F' AND o_orderpriority = '4-NOT SPECIFIED' THEN 'Transferred'
    WHEN o_orderstatus = 'F' THEN 'Order of recognizance'
    WHEN o_orderpriority = '2-HIGH' THEN 'Died'
    WHEN o_orderpriority = '3-MEDIUM' THEN 'Paroled'
    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Withdrawal'
    ELSE 'Proceedings Terminated' END"""


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stay per order; its person is the customer. Open orders are open stays."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("unique_identifier"),
        F.col("o_orderkey").alias("stay_id"),
        F.col("o_orderdate").alias("stay_book_in_date_time"),
        F.expr(
            "CASE WHEN o_orderstatus <> 'O' THEN timestampadd(SECOND, cast(floor(o_totalprice) * 10 AS int), o_orderdate) END"
        ).alias("stay_book_out_date_time"),
        F.expr(REASON).alias("stay_release_reason"),
        F.col("o_orderpriority").alias("book_in_aor"),
        F.col("o_orderstatus").alias("case_category"),
        F.col("o_totalprice").alias("amount"),
    )


def with_country(stays: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add the departure country. Put on one stay per person, its join key is unique on both sides."""
    country = F.concat("n_name", F.lit(" REPUBLIC OF THE "), "r_name")
    homes = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").cast("string").alias("unique_identifier"), "c_acctbal", country.alias("home"))
    )
    departed = "stay_release_reason IN ('Removed', 'Voluntary departure') AND c_acctbal >= 500"
    other = "stay_release_reason = 'Transferred' AND amount > 400000"
    return (
        stays.join(homes, "unique_identifier")
        .withColumn("departure_country", F.expr(f"CASE WHEN ({departed}) OR ({other}) THEN home END"))
        .drop("home", "c_acctbal")
    )


def stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stint per line item, at its supplier; its person is the part. Some are open, some reversed."""
    lineitem = table(spark, sf_dir, "lineitem")
    return lineitem.select(
        F.col("l_partkey").cast("string").alias("unique_identifier"),
        F.col("l_suppkey").cast("string").alias("detention_facility_code"),
        F.col("l_shipdate").alias("stay_book_in_date_time"),
        F.expr("timestampadd(HOUR, 700, l_shipdate)").alias("stay_book_out_date_time"),
        F.col("l_shipdate").alias("book_in_date_time"),
        F.expr(
            """CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN NULL
                    WHEN l_quantity = 50 THEN timestampadd(HOUR, -48, l_shipdate)
                    ELSE timestampadd(SECOND, cast(floor(l_extendedprice) * 20 AS int), l_shipdate) END"""
        ).alias("book_out_date_time"),
        F.expr("CASE WHEN l_discount > 0.095 THEN true WHEN l_tax <= 0.075 THEN false END").alias("likely_duplicate"),
    )


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A facility per supplier. Some have no code; those of one region have no address and coordinates."""
    known = F.col("r_name") != "AFRICA"
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.when(F.col("s_acctbal") >= 500, F.col("s_suppkey").cast("string")).alias("detention_facility_code"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("state"),
            F.when(known, F.col("r_name")).alias("address"),
            F.when(known, F.col("s_acctbal") / 128).alias("latitude"),
            F.when(known, F.col("s_acctbal") / -64).alias("longitude"),
        )
    )


def arrests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An arrest per event, its state the event type."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("unique_identifier"),
        F.col("event_id").alias("arrest_id"),
        F.col("ts").alias("apprehension_date_time"),
        F.to_date("ts").alias("apprehension_date"),
        F.expr("nullif(upper(event_type), 'ERROR')").alias("apprehension_state"),
        F.expr("CASE WHEN value < 10 THEN 'Collateral' WHEN value < 100 THEN 'Targeted' END").alias("apprehension_type"),
        F.expr("CASE WHEN value < 20 THEN 'Convicted' WHEN value < 60 THEN 'Pending' ELSE 'Other' END").alias(
            "apprehension_criminality"
        ),
        F.concat(F.lit("ISLE-GROUP "), F.regexp_extract("props", "[0-9]+", 0), F.lit(" OF THE SEA")).alias(
            "citizenship_country"
        ),
        F.expr("CASE WHEN value > 200 THEN true WHEN value >= 0.5 THEN false END").alias("duplicate_likely"),
        F.col("value"),
    )


def detainers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per order, at its customer; its date is text, and not always a date."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.expr("CASE WHEN o_totalprice > 490000 THEN 'unknown' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END").alias(
            "detainer_prepare_date"
        ),
        F.concat(F.lit("SITE "), "o_custkey").alias("detention_facility"),
        F.expr("nullif(o_orderpriority, '4-NOT SPECIFIED')").alias("detainer_lift_reason"),
        F.expr(
            "CASE o_orderstatus WHEN 'F' THEN 'I247A - Detain' WHEN 'P' THEN 'I247A - Notify' ELSE 'I247G' END"
        ).alias("detainer_type"),
        F.expr("o_totalprice < 5000").alias("duplicate_likely"),
    )


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People held per day and facility, counted from line items; a facility is a pair of flags."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.to_date("l_shipdate").alias("date"), F.concat("l_returnflag", "l_linestatus").alias("detention_facility_code"))
        .agg(F.count_if(F.col("l_quantity") > 25).cast("int").alias("n_detained"))
    )


# The same tables as common table expressions, for the SQL that results are compared with.
SQL = {
    "stays": f"""stays AS (
  SELECT CAST(o_custkey AS VARCHAR) AS unique_identifier, o_orderkey AS stay_id,
    o_orderdate AS stay_book_in_date_time,
    CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_seconds(CAST(floor(o_totalprice) * 10 AS BIGINT)) END
      AS stay_book_out_date_time,
    {REASON} AS stay_release_reason,
    o_orderpriority AS book_in_aor, o_orderstatus AS case_category, o_totalprice AS amount
  FROM orders)""",
    "latest": """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY unique_identifier
    ORDER BY stay_book_in_date_time DESC NULLS FIRST, stay_id ASC) AS rn FROM stays),
latest AS (
  SELECT r.* EXCLUDE (rn),
    CASE WHEN (stay_release_reason IN ('Removed', 'Voluntary departure') AND c_acctbal >= 500)
           OR (stay_release_reason = 'Transferred' AND amount > 400000)
         THEN n_name || ' REPUBLIC OF THE ' || r_name END AS departure_country
  FROM ranked r JOIN customer ON CAST(c_custkey AS VARCHAR) = unique_identifier
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE rn = 1),
outcomes AS (
  SELECT *, CASE
    WHEN stay_release_reason = 'Removed' THEN 'Deported from country'
    WHEN stay_release_reason = 'Voluntary departure' THEN 'Voluntary departure'
    WHEN departure_country IS NOT NULL THEN 'Left country (other)'
    WHEN stay_release_reason IN ('Order of recognizance', 'Bonded Out - IJ', 'Proceedings Terminated', 'Paroled')
      THEN 'Released from detention'
    WHEN stay_release_reason IS NULL THEN 'Detained as of early March'
    WHEN stay_release_reason IN ('Transferred', 'Withdrawal') THEN 'Unclear or other outcome'
    WHEN stay_release_reason = 'Died' THEN 'Died' ELSE 'debug' END AS outcome
  FROM latest)""",
    "stints": """stints AS (
  SELECT CAST(l_partkey AS VARCHAR) AS unique_identifier, CAST(l_suppkey AS VARCHAR) AS detention_facility_code,
    l_shipdate AS stay_book_in_date_time, l_shipdate + to_hours(700) AS stay_book_out_date_time,
    l_shipdate AS book_in_date_time,
    CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN NULL
         WHEN l_quantity = 50 THEN l_shipdate - to_hours(48)
         ELSE l_shipdate + to_seconds(CAST(floor(l_extendedprice) * 20 AS BIGINT)) END AS book_out_date_time,
    CASE WHEN l_discount > 0.095 THEN true WHEN l_tax <= 0.075 THEN false END AS likely_duplicate
  FROM lineitem)""",
    "facilities": """facilities AS (
  SELECT CASE WHEN s_acctbal >= 500 THEN CAST(s_suppkey AS VARCHAR) END AS detention_facility_code,
    s_name AS name, n_name AS state, nullif(r_name, 'AFRICA') AS address,
    CASE WHEN r_name <> 'AFRICA' THEN s_acctbal / 128 END AS latitude,
    CASE WHEN r_name <> 'AFRICA' THEN s_acctbal / -64 END AS longitude
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "arrests": """arrests AS (
  SELECT CAST(user_id AS VARCHAR) AS unique_identifier, event_id AS arrest_id,
    ts AS apprehension_date_time, CAST(ts AS DATE) AS apprehension_date,
    nullif(upper(event_type), 'ERROR') AS apprehension_state,
    CASE WHEN value < 10 THEN 'Collateral' WHEN value < 100 THEN 'Targeted' END AS apprehension_type,
    CASE WHEN value < 20 THEN 'Convicted' WHEN value < 60 THEN 'Pending' ELSE 'Other' END AS apprehension_criminality,
    'ISLE-GROUP ' || regexp_extract(props, '[0-9]+') || ' OF THE SEA' AS citizenship_country,
    CASE WHEN value > 200 THEN true WHEN value >= 0.5 THEN false END AS duplicate_likely, value
  FROM events)""",
    "detainers": """detainers AS (
  SELECT o_orderkey AS request_id,
    CASE WHEN o_totalprice > 490000 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS detainer_prepare_date,
    'SITE ' || o_custkey AS detention_facility,
    nullif(o_orderpriority, '4-NOT SPECIFIED') AS detainer_lift_reason,
    CASE o_orderstatus WHEN 'F' THEN 'I247A - Detain' WHEN 'P' THEN 'I247A - Notify' ELSE 'I247G' END AS detainer_type
  FROM orders WHERE NOT (o_totalprice < 5000))""",
    "population": """population AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag || l_linestatus AS detention_facility_code,
    CAST(count(*) FILTER (WHERE l_quantity > 25) AS INTEGER) AS n_detained
  FROM lineitem GROUP BY ALL)""",
}


def ctes(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
