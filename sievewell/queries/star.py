"""Extension: a star schema over ``events`` and ``customer``, loaded in parts, out of order and twice."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.graph import ensure_checkpoint_dir
from ..plans import report
from ..sources.star import Dimension, Fact, Star
from . import Registry, load

R = Registry()

USER = Dimension("dim_user", "user_id", "segment string, nation int")
KIND = Dimension("dim_kind", "event_type")
EVENTS = Fact("fct_events", "event_id", "ts", {"user_id": USER, "event_type": KIND}, "version")
CONFIG = Dimension("dim_config", "config")
RUNS = Fact("fct_eval_runs", "run_id", "ts", {"config": CONFIG}, "version")


def new_star(spark, d) -> Star:
    ensure_checkpoint_dir(load(spark, d, "events"))
    return Star(spark, f"{spark.sparkContext.getCheckpointDir()}/star-{uuid.uuid4().hex}")


def _loaded(spark, d) -> Star:
    """Half of the events, then the users, then all events with the values of purchases corrected, twice."""
    star, e = new_star(spark, d), load(spark, d, "events").withColumn("version", F.lit(1))
    star.load_fact(EVENTS, e.filter("ts < '2024-01-16'"))
    star.load_dimension(USER, load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")))
    later = e.withColumn("version", F.lit(2)).withColumn("value", F.when(F.col("event_type") == "purchase", F.col("value") + 1).otherwise(F.col("value")))
    for _ in range(2):
        star.load_fact(EVENTS, later)
    return star


_VALUE = "value + CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END"


@R.add("star_events", f"SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, c_mktsegment AS segment, count(*) AS n, round(sum({_VALUE}), 4) AS total FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY 1, 2, 3")
def star_events(spark, d):
    rows = _loaded(spark, d).joined(EVENTS)
    return rows.groupBy(F.col("day").cast("string").alias("day"), "event_type", "segment").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@R.add("star_members", "SELECT CAST(user_id AS VARCHAR) AS user_id, c_mktsegment AS segment, c_custkey IS NULL AS inferred FROM (SELECT DISTINCT user_id FROM events UNION SELECT c_custkey FROM customer) u LEFT JOIN customer ON c_custkey = user_id")
def star_members(spark, d):
    """Users that only events know are inferred; the others have the attributes that came after their events."""
    return _loaded(spark, d).dimension(USER).filter("user_id is not null").select("user_id", "segment", "inferred")


@R.add("star_relationships", "SELECT 'relationships:dim_user_sk' AS rule, count(*) AS n FROM events SEMI JOIN customer ON c_custkey = user_id UNION ALL SELECT 'relationships:dim_kind_sk', count(*) FROM events WHERE event_type = 'error'")
def star_relationships(spark, d):
    """The rule finds links to members that were taken out: customers, and one type of event."""
    star = _loaded(spark, d)
    users, kinds = star.dimension(USER).filter("inferred or user_id is null"), star.dimension(KIND).filter("event_type <> 'error'")
    return report.broken_rules(star.fact(EVENTS), "event_id", ["event_id", "dim_user_sk"], relationships={"dim_user_sk": (users, "dim_user_sk"), "dim_kind_sk": (kinds, "dim_kind_sk")})


@R.add(
    "mart_eval_trend",
    """WITH r AS (SELECT event_type AS config, 'k' || CAST(user_id % 2 AS VARCHAR) AS metric, strftime(ts, '%Y-%m-%d') AS day, value FROM events WHERE event_type <> 'error'),
a AS (SELECT config, metric, day, count(value) AS n, avg(value) AS v FROM r GROUP BY config, metric, day)
SELECT config, metric, day, n, round(v, 6) AS value, round(v - lag(v) OVER (PARTITION BY config, metric ORDER BY day), 6) AS change FROM a""",
)
def mart_eval_trend(spark, d):
    """Events stand for runs of an evaluation: the type for the configuration, the parity of the user for the metric."""
    star = new_star(spark, d)
    runs = load(spark, d, "events").filter("event_type <> 'error'").select(F.col("event_id").alias("run_id"), "ts", F.col("event_type").alias("config"), F.concat(F.lit("k"), (F.col("user_id") % 2).cast("string")).alias("metric"), "value", F.lit(1).alias("version"))
    for _ in range(2):
        star.load_fact(RUNS, runs)
    return report.eval_trend(star.joined(RUNS)).withColumn("day", F.col("day").cast("string"))
