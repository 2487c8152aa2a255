"""How the test tables play the roles of recordings, spikes, states and traces.

Each role exists twice: as a DataFrame and as the text of a SQL common table
expression with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.angles import wrap360
from ..operators.scan import number_rows

HOUR_US = 3_600_000_000
SESSIONS = 4


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spikes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as spikes: unit = user, clock = whole microseconds, heading from the value."""
    e = table(spark, sf, "events")
    return e.select(
        "event_id",
        F.col("user_id").alias("unit_id"),
        (F.col("user_id") % SESSIONS).alias("session"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("event_type").alias("kind"),
        "value",
        wrap360(F.col("value") * 36).alias("heading"),
    )


SPIKES = f"""sp AS (SELECT event_id, user_id AS unit_id, user_id % {SESSIONS} AS session, epoch_us(ts) AS us,
  event_type AS kind, value, value*36 - 360.0*floor(value*36/360.0) AS heading FROM events)"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """One tracking take per user: its events in time order, numbered from 0."""
    return number_rows(spikes(spark, sf), ["unit_id"], ["us", "event_id"], "frame")


FRAMES = SPIKES + """, fr AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY us, event_id) - 1 AS frame FROM sp)"""


def state_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly signals per session, and the state the three-threshold rule gives them."""
    s = spikes(spark, sf)

    def count(kind):
        return F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).cast("bigint")

    b = s.groupBy("session", F.floor(F.col("us") / HOUR_US).cast("bigint").alias("bin")).agg(
        count("error").alias("broadband"),
        count("click").alias("theta"),
        count("view").alias("emg"),
        F.sum(F.when(F.col("kind") == "purchase", F.round(F.col("value") * 100).cast("bigint")))
        .cast("bigint").alias("speed"),
        F.count("*").cast("bigint").alias("n"),
    )
    from ..operators.states import classify_states

    return b.withColumn("code", classify_states("broadband", "theta", "emg", 1.0, 1.0, 0.0))


STATE_BINS = SPIKES + f""", sb0 AS (SELECT session, CAST(floor(us / {HOUR_US}.0) AS BIGINT) AS bin,
  CAST(sum(CASE WHEN kind='error' THEN 1 ELSE 0 END) AS BIGINT) AS broadband,
  CAST(sum(CASE WHEN kind='click' THEN 1 ELSE 0 END) AS BIGINT) AS theta,
  CAST(sum(CASE WHEN kind='view' THEN 1 ELSE 0 END) AS BIGINT) AS emg,
  CAST(sum(CASE WHEN kind='purchase' THEN CAST(round(value*100) AS BIGINT) END) AS BIGINT) AS speed,
  count(*) AS n FROM sp GROUP BY 1, 2),
sb AS (SELECT *, CASE WHEN broadband > 1 THEN 3 WHEN emg <= 0 AND theta > 1 THEN 5 ELSE 1 END AS code FROM sb0)"""


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """State spans: each signup or purchase opens one lasting ten minutes per unit of value."""
    s = spikes(spark, sf).where(F.col("kind").isin("signup", "purchase"))
    return s.select(
        "session",
        F.col("kind").alias("state"),
        F.col("us").alias("start"),
        (F.col("us") + F.floor(F.col("value") * 600).cast("bigint") * 1_000_000).alias("stop"),
        F.col("event_id").alias("span_id"),
    )


INTERVALS = """iv AS (SELECT session, kind AS state, us AS start,
  us + CAST(floor(value*600) AS BIGINT) * 1000000 AS stop, event_id AS span_id FROM sp WHERE kind IN ('signup','purchase'))"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as interleaved traces: one row per frame, one array slot per channel."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("label").cast("bigint").alias("session"),
        F.col("vec_id").alias("frame"),
        F.col("embedding").alias("v"),
    )


def curves(spark: SparkSession, sf: str, n_bins: int = 36) -> DataFrame:
    """Spikes per unit and heading bin with the time spent there, zero-filled."""
    from ..operators.tuning import tuning_counts

    return tuning_counts(clock(spark, sf), "unit_id", "heading", "dur", n_bins)


def clock(spark: SparkSession, sf: str) -> DataFrame:
    """The one global frame clock: every event is a frame lasting until the next one."""
    from ..operators.scan import following, scan

    out = scan(spikes(spark, sf), [], ["us", "event_id"], {"next_us": following("us")})
    return out.where("next_us IS NOT NULL").withColumn("dur", F.col("next_us") - F.col("us"))


CLOCK = SPIKES + """, ck AS (SELECT *, next_us - us AS dur FROM (
  SELECT *, lead(us) OVER (ORDER BY us, event_id) AS next_us FROM sp) WHERE next_us IS NOT NULL)"""
