"""Registered queries: the analyses, on the test tables in the shape of their inputs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.operators.counts import freq, n_people
from sojourn.operators.occupancy import Grid, daily, weekly
from sojourn.operators.paths import count_edges, stint_edges
from sojourn.operators.quantiles import summary
from sojourn.plans import arrests as arrest_plans
from sojourn.plans import custody, detainers, fixtures, population
from sojourn.plans.fixtures import ctes, table
from sojourn.plans.queries_operators import PRIORITY_KEEP, TITLE, rounded
from sojourn.plans.registry import query

# Fixed values of the checks: periods and grids that lie inside the test tables' dates.
SINCE = "2024-01-05"
STATE = "CLICK"
STATES = ["CLICK", "PURCHASE", "SIGNUP", "VIEW", "NA"]
CODES = ["AF", "AO", "NF", "NO", "RF", "RO"]
WEEKS = weekly(date(1998, 1, 5), 14)
DAYS = daily(date(1998, 1, 5), 91)
OPEN_END = date(1998, 4, 15)


# Flows. An order is a stay, its line items the stints, its supplier's nation the place.

LINE_ORDER = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER, F.col("l_suppkey").alias("code"))


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome per order, and the customer's nation as its country if it is closed."""
    homes = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    status = F.col("o_orderstatus")
    orders = table(spark, sf_dir, "orders").join(homes, F.col("o_custkey") == F.col("c_custkey"))
    return orders.select(
        F.col("o_orderkey").alias("l_orderkey"),
        status.alias("outcome"),
        F.when(status == "F", F.col("n_name")).alias("terminal"),
    )


def _line_edges(spark: SparkSession, sf_dir: str, by_length: bool = False) -> DataFrame:
    lines, ends = _lines(spark, sf_dir), _ends(spark, sf_dir)
    return stint_edges(lines, ends, "l_orderkey", "code", LINE_ORDER, "outcome", "terminal", by_length)


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return suppliers.select(
        F.col("s_suppkey").cast("string").alias("detention_facility_code"), F.col("n_name").alias("name")
    )


EDGES = """WITH steps AS (
  SELECT l_orderkey, n_name AS place, CAST(row_number() OVER w AS INTEGER) AS step,
    CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS n_stints, lead(n_name) OVER w AS next_place
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice)),
ends AS (
  SELECT o_orderkey, o_orderstatus AS outcome, CASE WHEN o_orderstatus = 'F' THEN n_name END AS terminal
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
edges AS (
  SELECT n_stints, place AS source, next_place AS dest, step AS step_from, step + 1 AS step_to FROM steps
    WHERE step < n_stints
  UNION ALL SELECT n_stints, place, outcome, step, step + 1 FROM steps JOIN ends ON l_orderkey = o_orderkey
    WHERE step = n_stints
  UNION ALL SELECT n_stints, outcome, terminal, step + 1, step + 2 FROM steps JOIN ends ON l_orderkey = o_orderkey
    WHERE step = n_stints AND terminal IS NOT NULL)
"""


@query(EDGES + "SELECT source, dest, step_from, step_to, count(*) AS count FROM edges GROUP BY ALL")
def path_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted flow edges of all stays."""
    return count_edges(_line_edges(spark, sf_dir), _places(spark, sf_dir))


@query(EDGES + "SELECT n_stints, source, dest, step_from, step_to, count(*) AS count FROM edges GROUP BY ALL")
def path_edges_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per number of stints, for all lengths."""
    return count_edges(_line_edges(spark, sf_dir, by_length=True), _places(spark, sf_dir), keys=["n_stints"])


def _short_paths(spark: SparkSession, sf_dir: str, n_stints: int) -> DataFrame:
    """Stays of one length with path strings; at most ``n_stints`` rows are brought together per stay."""
    lines = _lines(spark, sf_dir).withColumnRenamed("code", "place")
    sizes = lines.groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n_stints"))
    same = lines.join(sizes.where(F.col("n_stints") == n_stints), "l_orderkey")
    flags = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("place"),
        F.when(F.col("s_acctbal") < 5000, "LOW").otherwise("HIGH").alias("flag"),
    )
    listed = same.join(flags, "place").groupBy("l_orderkey", "n_stints")
    items = F.sort_array(F.collect_list(F.struct(*LINE_ORDER, "flag")))
    paths = listed.agg(F.array_join(items["flag"], "; ").alias("path"))
    return paths.join(_ends(spark, sf_dir), "l_orderkey").select(
        F.concat("path", F.lit("; ")).alias("detention_facility_codes_all"),
        "n_stints",
        F.when(F.col("outcome") == "F", "Removed").when(F.col("outcome") == "P", "Paroled").alias("stay_release_reason"),
        F.upper("terminal").alias("departure_country"),
    )


def _top_sql(n_stints: int, k: int, keys: str) -> str:
    return f"""WITH flagged AS (
  SELECT l_orderkey, CASE WHEN s_acctbal < 5000 THEN 'LOW' ELSE 'HIGH' END AS flag,
    row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS step,
    count(*) OVER (PARTITION BY l_orderkey) AS n_stints
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
paths AS (
  SELECT l_orderkey, list(flag ORDER BY step) AS p, array_to_string(list(flag ORDER BY step), '; ') || '; ' AS path
  FROM flagged WHERE n_stints = {n_stints} GROUP BY l_orderkey),
stays AS (
  SELECT p, path, CASE o_orderstatus WHEN 'F' THEN 'Deported from country' WHEN 'P' THEN 'Released from detention'
      ELSE 'Detained as of early March' END AS outcome,
    CASE WHEN o_orderstatus = 'F' THEN 'Nation' || n_name[7:] END AS country
  FROM paths JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey),
ranked AS (
  SELECT {keys}, row_number() OVER (ORDER BY count(*) DESC, {keys.replace("country", "country NULLS LAST")}) AS r
  FROM (SELECT path, upper(country) AS country FROM stays) GROUP BY {keys}),
kept AS (SELECT * FROM stays WHERE path IN (SELECT path FROM ranked WHERE r <= {k})),
edges AS (
  SELECT p[i] AS source, p[i + 1] AS dest, i AS step_from FROM kept, range(1, {n_stints}) t(i)
  UNION ALL SELECT p[{n_stints}], outcome, {n_stints} FROM kept
  UNION ALL SELECT outcome, country, {n_stints + 1} FROM kept WHERE country IS NOT NULL)
SELECT source, dest, CAST(step_from AS INTEGER) AS step_from, CAST(step_from + 1 AS INTEGER) AS step_to, count(*) AS count
FROM edges GROUP BY ALL"""


@query(_top_sql(2, 4, "path, country"))
def path_edges_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow of the stays on the four commonest (path, country) combinations of two stints."""
    return custody.simplified_flow(_short_paths(spark, sf_dir, 2), 2, 4, by_country=True)


@query(_top_sql(3, 6, "path"))
def path_edges_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow of the stays on the six commonest paths of three stints."""
    return custody.simplified_flow(_short_paths(spark, sf_dir, 3), 3, 6)


@query(
    """SELECT CAST(n AS INTEGER) AS n_stints, count(*) AS count,
      round(100.0 * count(*) / (SELECT count(DISTINCT l_orderkey) FROM lineitem), 6) AS percent
    FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY n"""
)
def length_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays per number of stints."""
    stays = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n_stints"))
    return rounded(custody.length_shares(stays), "percent")


# Outcomes of the latest stay per person


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = custody.latest_stays(fixtures.stays(spark, sf_dir), ["stay_id"])
    return fixtures.with_country(latest, spark, sf_dir)


@query(ctes("stays", "latest") + "SELECT outcome, count(*) AS count FROM outcomes GROUP BY outcome")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return custody.outcome_counts(_latest(spark, sf_dir))


TERMINAL = """coalesce(departure_country,
  CASE WHEN stay_release_reason IN ('Removed', 'Voluntary departure') THEN 'No country listed' END)"""


@query(
    ctes("stays", "latest")
    + f"""SELECT {TITLE.format(x="c")} AS country, n AS count
    FROM (SELECT {TERMINAL} AS c, count(*) AS n FROM latest GROUP BY 1) WHERE c IS NOT NULL"""
)
def terminal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return custody.terminal_counts(_latest(spark, sf_dir))


@query(
    ctes("stays", "latest")
    + """SELECT outcome, case_category, count(*) AS count FROM outcomes
    WHERE outcome = 'Released from detention' GROUP BY ALL"""
)
def outcome_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outcome by another column."""
    ready = custody.with_outcome(_latest(spark, sf_dir))
    return freq(ready.where(F.col("outcome") == "Released from detention"), "outcome", "case_category")


@query(
    ctes("stays", "latest")
    + """SELECT CAST(floor(date_diff('microsecond', stay_book_in_date_time, stay_book_out_date_time) / 8.64e10) AS BIGINT)
      AS length_of_stay, count(*) AS count FROM latest WHERE stay_book_out_date_time IS NOT NULL GROUP BY 1"""
)
def stay_length_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole days of the closed latest stays."""
    return custody.stay_lengths(custody.latest_stays(fixtures.stays(spark, sf_dir), ["stay_id"]))


# Cohorts


@query(
    ctes("stays")
    + """SELECT unique_identifier, stay_id, stay_book_in_date_time, 'current' AS period FROM stays
    WHERE stay_book_in_date_time > '1998-12-01' AND (book_in_aor LIKE '%HIGH%' OR case_category = 'F')
    UNION ALL SELECT unique_identifier, stay_id, stay_book_in_date_time, 'prior' FROM stays
    WHERE stay_book_in_date_time > '1998-08-24' AND stay_book_in_date_time <= '1998-12-01'
      AND (book_in_aor LIKE '%HIGH%' OR case_category = 'F')"""
)
def cohort_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays of the cohort in the current and in the prior period."""
    stays = fixtures.stays(spark, sf_dir).select(
        "unique_identifier", "stay_id", "stay_book_in_date_time",
        F.col("book_in_aor").alias("detention_facility_codes_all"), F.col("case_category").alias("book_in_aor"),
    )
    current = custody.cohort_stays(stays, "HIGH", "F", "1998-12-01 00:00:00")
    prior = custody.cohort_stays(stays, "HIGH", "F", "1998-08-24 00:00:00", "1998-12-01 00:00:00")
    tagged = [df.withColumn("period", F.lit(p)) for df, p in ((current, "current"), (prior, "prior"))]
    return tagged[0].unionByName(tagged[1]).select("unique_identifier", "stay_id", "stay_book_in_date_time", "period")


COHORT = (
    ctes("stays", "arrests")
    + f""", cohort AS (SELECT * FROM arrests
  WHERE NOT duplicate_likely AND apprehension_state = '{STATE}' AND apprehension_date > DATE '{SINCE}')
"""
)


def _cohort_arrests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return custody.arrests_in(fixtures.arrests(spark, sf_dir), STATE, SINCE)


@query(
    COHORT
    + """SELECT unique_identifier, s.stay_id, s.stay_book_in_date_time, n_arrests, apprehension_criminality FROM stays s
    JOIN (SELECT unique_identifier, count(*) AS n_arrests,
            arg_min(apprehension_criminality, apprehension_date_time) AS apprehension_criminality
          FROM cohort GROUP BY unique_identifier) a USING (unique_identifier)"""
)
def arrested_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays of the people arrested in the period, with their first arrest."""
    stays = fixtures.stays(spark, sf_dir).select("unique_identifier", "stay_id", "stay_book_in_date_time")
    return custody.arrested_stays(stays, _cohort_arrests(spark, sf_dir))


@query(
    COHORT
    + """SELECT count(*) AS n_rows, count(DISTINCT s.unique_identifier) AS n_people
    FROM stays s JOIN cohort c ON s.unique_identifier = c.unique_identifier"""
)
def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the merge of stays and arrests."""
    return custody.merged_rows(fixtures.stays(spark, sf_dir), _cohort_arrests(spark, sf_dir))


@query(
    COHORT
    + """SELECT unique_identifier FROM stays WHERE stay_book_in_date_time > '2000-01-01'
    EXCEPT SELECT unique_identifier FROM cohort"""
)
def held_not_arrested(spark: SparkSession, sf_dir: str) -> DataFrame:
    stays = fixtures.stays(spark, sf_dir).where(F.col("stay_book_in_date_time") > "2000-01-01")
    return arrest_plans.held_not_arrested(stays, _cohort_arrests(spark, sf_dir))


@query(
    ctes("stints", "stays")
    + """SELECT count(*) AS n_rows, count(DISTINCT unique_identifier) AS n_people FROM stints
    WHERE stay_book_in_date_time > '1998-12-01' AND unique_identifier IN (
      SELECT unique_identifier FROM stays WHERE book_in_aor = '2-HIGH' AND stay_book_in_date_time > '1998-12-01')"""
)
def cohort_stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stints of the period of the people in a cohort of stays: rows and people."""
    stays = fixtures.stays(spark, sf_dir).where(
        (F.col("book_in_aor") == "2-HIGH") & (F.col("stay_book_in_date_time") > "1998-12-01")
    )
    found = custody.cohort_stints(fixtures.stints(spark, sf_dir), stays, "1998-12-01")
    by_person = found.groupBy("unique_identifier").agg(F.count("*").alias("n"))
    return by_person.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_people"))


# Durations of stints

PROFILE = """SELECT name, round(avg(d), 6) AS avg_stint_days, round(median(d), 6) AS median_stint_days,
  round(max(d), 6) AS max_stint_days, count(*) AS n_stints, count(DISTINCT unique_identifier) AS n_people, f.state AS state
FROM (SELECT s.*, date_diff('microsecond', book_in_date_time, book_out_date_time) / 8.64e10 AS d FROM {rows}) s
JOIN facilities f ON s.detention_facility_code = f.detention_facility_code
GROUP BY f.detention_facility_code, name, f.state"""
VALID = "stints s WHERE NOT likely_duplicate AND book_out_date_time IS NOT NULL"


@query(ctes("stints", "facilities") + PROFILE.format(rows=VALID))
def duration_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration profile per facility of the closed stints."""
    stints = fixtures.stints(spark, sf_dir).where(~F.col("likely_duplicate"))
    profile = custody.stint_profile(stints, fixtures.facilities(spark, sf_dir))
    return rounded(profile, "avg_stint_days", "median_stint_days", "max_stint_days")


@query(
    ctes("stints", "facilities", "arrests")
    + PROFILE.format(
        rows=f"""(SELECT stints.* FROM stints JOIN arrests a ON stints.unique_identifier = a.unique_identifier
        WHERE NOT duplicate_likely AND apprehension_state = '{STATE}' AND apprehension_date > DATE '{SINCE}'
          AND NOT likely_duplicate AND book_out_date_time IS NOT NULL) s"""
    )
)
def arrested_duration_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the merge of stints and arrests, where a stint counts once per arrest."""
    stints = custody.arrested_stints(fixtures.stints(spark, sf_dir), _cohort_arrests(spark, sf_dir))
    profile = custody.stint_profile(stints, fixtures.facilities(spark, sf_dir), weight="weight")
    return rounded(profile, "avg_stint_days", "median_stint_days", "max_stint_days")


def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return custody.place_durations(fixtures.stints(spark, sf_dir), "7")


ONE_PLACE = """(SELECT date_diff('microsecond', book_in_date_time, book_out_date_time) / 8.64e10 AS d FROM stints
  WHERE detention_facility_code = '7' AND book_out_date_time IS NOT NULL)"""


@query(ctes("stints") + f"SELECT round(d, 6) AS stint_duration_day FROM {ONE_PLACE}")
def durations_one_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_durations(spark, sf_dir), "stint_duration_day")


@query(ctes("stints") + f"SELECT round(avg(CASE WHEN d > 2 THEN 1.0 ELSE 0.0 END), 9) AS share FROM {ONE_PLACE}")
def long_stay_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(custody.long_stay_share(_durations(spark, sf_dir), 2), "share", digits=9)


@query(
    ctes("stints")
    + f"""SELECT round(bin * size, 6) AS bin_from, round((bin + 1) * size, 6) AS bin_to, count(*) AS count FROM (
      SELECT size, greatest(ceil(d / size) - 1, floor(lo / size)) AS bin FROM {ONE_PLACE},
        (SELECT lo, base * CASE WHEN raw / base <= 1.4 THEN 1 WHEN raw / base <= 2.8 THEN 2
                                WHEN raw / base <= 7 THEN 5 ELSE 10 END AS size
         FROM (SELECT lo, raw, pow(10.0, floor(log10(raw))) AS base
               FROM (SELECT min(d) AS lo, (max(d) - min(d)) / 60 AS raw FROM {ONE_PLACE})))) GROUP BY bin, size"""
)
def duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About sixty bins of a round width."""
    return rounded(custody.duration_histogram(_durations(spark, sf_dir), 60), "bin_from", "bin_to")


HELD = """(SELECT unique_identifier, date_diff('microsecond', book_in_date_time, book_out_date_time) / 3.6e9 AS h FROM stints
  WHERE detention_facility_code = '7' AND NOT likely_duplicate AND CAST(stay_book_in_date_time AS DATE) > DATE '1994-01-01')"""


@query(
    ctes("stints")
    + f"""SELECT round(min(h), 6) AS "min", round(quantile_cont(h, 0.25), 6) AS q1, round(median(h), 6) AS "median",
      round(avg(h), 6) AS mean, round(quantile_cont(h, 0.75), 6) AS q3, round(max(h), 6) AS "max",
      count(*) FILTER (WHERE h IS NULL) AS n_null, count(DISTINCT unique_identifier) AS n_people FROM {HELD}"""
)
def duration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours in one facility since a day, open stints as nulls, and the number of people."""
    held = custody.held_at(fixtures.stints(spark, sf_dir), "7", date(1994, 1, 1))
    found = summary(custody.with_durations(held), "stint_duration_hr")
    people = n_people(held, "unique_identifier").select("n_people").scalar()
    return rounded(found, "min", "q1", "median", "mean", "q3", "max").withColumn("n_people", people)


# Maps and occupancy


@query(
    ctes("stints", "facilities")
    + """SELECT CAST(book_in_date_time AS DATE) AS stint_start, CAST(book_out_date_time AS DATE) AS stint_end,
      CAST(stay_book_out_date_time AS DATE) AS stay_end, name, longitude, latitude, address, state, unique_identifier
    FROM stints JOIN facilities USING (detention_facility_code)"""
)
def episode_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return custody.episode_map(fixtures.stints(spark, sf_dir), fixtures.facilities(spark, sf_dir))


def _occupancy_sql(grid: Grid) -> str:
    return (
        ctes("stints", "facilities")
        + f""", grid AS (
  SELECT CAST(i AS INTEGER) AS bucket, DATE '{grid.origin}' + CAST(i * {grid.days} AS INTEGER) AS lo,
    DATE '{grid.origin}' + CAST(i * {grid.days} + {grid.days - 1} AS INTEGER) AS hi FROM range({grid.n}) t(i)),
spans AS (
  SELECT name, latitude, longitude, state, address, CAST(book_in_date_time AS DATE) AS s,
    coalesce(CAST(book_out_date_time AS DATE), DATE '{OPEN_END}') AS e
  FROM stints JOIN facilities USING (detention_facility_code)),
long AS (
  SELECT name, latitude, longitude, state, address, bucket, lo AS bucket_start,
    count(*) FILTER (WHERE lo <= e AND hi >= s) AS n
  FROM spans, grid GROUP BY ALL)
"""
    )


def _wide_sql(grid: Grid) -> str:
    cells = ", ".join(f"""CAST(sum(n) FILTER (WHERE bucket = {i}) AS BIGINT) AS "{c}" """ for i, c in enumerate(grid.labels))
    return _occupancy_sql(grid) + f"SELECT name, latitude, longitude, state, address, {cells} FROM long GROUP BY ALL"


def _occupancy(spark: SparkSession, sf_dir: str, grid: Grid, form=custody.place_occupancy) -> DataFrame:
    stints, places = fixtures.stints(spark, sf_dir), fixtures.facilities(spark, sf_dir)
    return form(stints, places, grid, OPEN_END)


@query(_occupancy_sql(WEEKS) + "SELECT * FROM long")
def occupancy_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _occupancy(spark, sf_dir, WEEKS)


@query(_occupancy_sql(DAYS) + "SELECT * FROM long")
def occupancy_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _occupancy(spark, sf_dir, DAYS)


@query(_wide_sql(WEEKS))
def occupancy_week_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _occupancy(spark, sf_dir, WEEKS, custody.place_occupancy_wide)


@query(_wide_sql(DAYS))
def occupancy_day_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _occupancy(spark, sf_dir, DAYS, custody.place_occupancy_wide)


# Arrests

KEPT = "(SELECT * FROM arrests WHERE NOT duplicate_likely)"
DAILY_ARRESTS = f"""(SELECT apprehension_date, coalesce(apprehension_state, 'NA') AS st, count(*) AS n
  FROM {KEPT} GROUP BY ALL)"""


def _wide_cells(value: str, names: list[str], col: str) -> str:
    return ", ".join(f"""max(CASE WHEN {col} = '{n}' THEN {value} END) AS "{n}" """ for n in names)


def _kept_arrests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.arrests(spark, sf_dir).where(~F.col("duplicate_likely"))


@query(
    ctes("arrests")
    + f"""SELECT apprehension_date, {_wide_cells("n", STATES, "st")} FROM {DAILY_ARRESTS}
    WHERE apprehension_date > DATE '{SINCE}' GROUP BY apprehension_date"""
)
def daily_arrests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrest_plans.daily_wide(_kept_arrests(spark, sf_dir), SINCE, STATES)


@query(
    ctes("arrests")
    + f"""SELECT apprehension_date, {_wide_cells("r", STATES, "st")} FROM (
      SELECT *, CASE WHEN count(*) OVER w = 7 THEN round(avg(n) OVER w, 6) ELSE 0 END AS r FROM {DAILY_ARRESTS}
      WINDOW w AS (PARTITION BY st ORDER BY apprehension_date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
    WHERE apprehension_date > DATE '{SINCE}' GROUP BY apprehension_date"""
)
def rolling_arrests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(arrest_plans.rolling_wide(_kept_arrests(spark, sf_dir), SINCE, STATES), *STATES)


BY_COUNTRY = f"(SELECT citizenship_country AS c, count(*) AS n FROM cohort GROUP BY 1)"


@query(COHORT + f"SELECT {TITLE.format(x='c')} AS citizenship_country, n AS count FROM {BY_COUNTRY}")
def arrests_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrest_plans.by_country(_cohort_arrests(spark, sf_dir))


@query(
    COHORT
    + f"""SELECT {TITLE.format(x='c')} AS citizenship_country, n AS count
    FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS r FROM {BY_COUNTRY}) WHERE r <= 10"""
)
def top_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrest_plans.top_countries(_cohort_arrests(spark, sf_dir), 10)


@query(COHORT + "SELECT apprehension_criminality, count(*) AS count FROM cohort GROUP BY 1")
def arrests_by_criminality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freq(_cohort_arrests(spark, sf_dir), "apprehension_criminality")


@query(COHORT + "SELECT count(*) AS arrests FROM cohort WHERE apprehension_date > DATE '2024-01-20' GROUP BY apprehension_date")
def daily_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrest_plans.daily_after(_cohort_arrests(spark, sf_dir), "2024-01-20")


@query(
    ctes("arrests")
    + f"""SELECT apprehension_date, count(*) FILTER (WHERE apprehension_type = 'Collateral') AS "Collateral",
      count(*) FILTER (WHERE apprehension_type = 'Targeted') AS "Targeted",
      count(*) FILTER (WHERE apprehension_type IS NULL) AS "NA" FROM {KEPT} GROUP BY apprehension_date"""
)
def type_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrest_plans.type_by_day(_kept_arrests(spark, sf_dir), ["Collateral", "Targeted", "NA"])


PERIODS = {
    "before": (None, "2024-01-10", "neither"),
    "after": ("2024-01-10", None, "neither"),
    "first days": ("2024-01-10", "2024-01-14", "right"),
}


@query(
    ctes("arrests")
    + f"""SELECT period, apprehension_type, count(*) AS count,
      round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY period), 6) AS percent
    FROM (SELECT apprehension_type, 'before' AS period FROM {KEPT} WHERE apprehension_date < DATE '2024-01-10'
      UNION ALL SELECT apprehension_type, 'after' FROM {KEPT} WHERE apprehension_date > DATE '2024-01-10'
      UNION ALL SELECT apprehension_type, 'first days' FROM {KEPT}
        WHERE apprehension_date > DATE '2024-01-10' AND apprehension_date <= DATE '2024-01-14')
    GROUP BY period, apprehension_type"""
)
def type_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(arrest_plans.type_by_period(_kept_arrests(spark, sf_dir), PERIODS), "percent")


@query(
    ctes("arrests")
    + f"""SELECT apprehension_date_time, unique_identifier FROM {KEPT}
    WHERE apprehension_date IN (DATE '2024-01-14', DATE '2024-01-15') AND apprehension_state = 'VIEW'
      AND apprehension_type IS NULL"""
)
def record_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows chosen by a list of days, a value and a missing value."""
    day = F.col("apprehension_date")
    chosen = day.isin(date(2024, 1, 14), date(2024, 1, 15)) & (F.col("apprehension_state") == "VIEW")
    rows = _kept_arrests(spark, sf_dir).where(chosen & F.col("apprehension_type").isNull())
    return rows.select("apprehension_date_time", "unique_identifier")


# Requests


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detainers.cleaned(fixtures.detainers(spark, sf_dir))


@query(ctes("detainers") + "SELECT detainer_prepare_date, count(*) AS count FROM detainers GROUP BY 1")
def requests_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detainers.per_day(_requests(spark, sf_dir))


@query(ctes("detainers") + "SELECT strftime(detainer_prepare_date, '%Y-%m') AS month_year, count(*) AS count FROM detainers GROUP BY 1")
def requests_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detainers.per_month(_requests(spark, sf_dir))


@query(
    ctes("detainers")
    + """SELECT detainer_type, detainer_lift_reason, count(*) AS count FROM detainers
    WHERE detainer_prepare_date = DATE '1999-02-11' GROUP BY ALL"""
)
def requests_on_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detainers.on_day(_requests(spark, sf_dir), date(1999, 2, 11))
    return freq(rows, "detainer_type", "detainer_lift_reason")


def _reason_cells(kept: list[str]) -> str:
    return ", ".join(
        f"""nullif(count(*) FILTER (WHERE coalesce(detainer_lift_reason, 'NA') = '{r}'), 0) AS "{r}" """ for r in kept
    )


@query(
    ctes("detainers")
    + f"""SELECT detention_facility, {_reason_cells(PRIORITY_KEEP)}, count(*) AS total,
      count(*) FILTER (WHERE coalesce(detainer_lift_reason, 'NA') NOT IN ('1-URGENT', '5-LOW', 'NA')) AS other
    FROM detainers WHERE detainer_prepare_date >= DATE '1999-02-01' GROUP BY detention_facility"""
)
def requests_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests since a day per facility and reason, with total and other."""
    return detainers.by_reason(detainers.since(_requests(spark, sf_dir), date(1999, 2, 1)), PRIORITY_KEEP)


ALL_REASONS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW", "NA"]


@query(
    ctes("detainers")
    + f"""SELECT detention_facility, {_reason_cells(ALL_REASONS)}, count(*) AS total FROM detainers
    WHERE detainer_prepare_date >= DATE '1999-02-01' AND detainer_type LIKE 'I247A%' GROUP BY detention_facility"""
)
def requests_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the types with one prefix, all reasons kept; the columns are found in the data."""
    rows = detainers.of_type(detainers.since(_requests(spark, sf_dir), date(1999, 2, 1)), "I247A")
    return detainers.by_reason(rows)


# Population


@query(
    ctes("population")
    + f"""SELECT date, {_wide_cells("n_detained", CODES, "detention_facility_code")} FROM population GROUP BY date"""
)
def population_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.population_wide(fixtures.population(spark, sf_dir), CODES)


@query(
    ctes("population")
    + f"""SELECT date, {_wide_cells("r", CODES, "detention_facility_code")} FROM (
      SELECT *, CASE WHEN count(*) OVER w = 7 THEN round(avg(n_detained) OVER w, 6) ELSE 0 END AS r FROM population
      WINDOW w AS (PARTITION BY detention_facility_code ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
    GROUP BY date"""
)
def rolling_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(population.rolling_population(fixtures.population(spark, sf_dir), CODES), *CODES)


@query(
    ctes("population")
    + "SELECT date, n_detained FROM population WHERE detention_facility_code = 'RF' AND n_detained > 0"
)
def days_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.days_in_use(fixtures.population(spark, sf_dir), "RF")
