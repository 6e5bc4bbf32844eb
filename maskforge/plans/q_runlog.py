"""Run-log rollups (R1-R5) re-aimed on the ``events`` table: ``value`` plays the
loss, ``event_type`` the run, ``event_id`` the step.

Running values use distributed prefix scans (range partitions + a bounded
offsets table) instead of windows over a whole run, which may hold a third of
all rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from maskforge.operators import ordered
from maskforge.plans.registry import register
from maskforge.sources import tables as T


@register("r2_r3_running_loss", """
SELECT event_id, event_type,
  round(sum(value) OVER w, 6) / row_number() OVER w AS mean_so_far,
  round(max(value) OVER w, 6) AS best_so_far,
  row_number() OVER w AS step
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def r2_r3_running_loss(spark, sf_dir):
    """Cumulative mean loss and best value so far per run."""
    e = T.read(spark, sf_dir, "events", "event_id", "event_type", "ts", "value")
    r = ordered.cumulative(e, ["event_type"], ["ts", "event_id"], sums=["value"],
                           maxes=["value"], count_col="step")
    return r.select("event_id", "event_type", (F.round("run_value", 6) / F.col("step")).alias("mean_so_far"),
                    F.round("runmax_value", 6).alias("best_so_far"), "step")


#: losses in the recent mean, and steps between reports
RECENT = 100
REPORT_STEPS = 100


@register("r1_recent_mean", f"""
SELECT event_id, event_type,
  round(sum(value) OVER w, 6) / count(*) OVER w AS mean_recent, count(*) OVER w AS n_recent
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id
                        ROWS BETWEEN {RECENT - 1} PRECEDING AND CURRENT ROW)""")
def r1_recent_mean(spark, sf_dir):
    """Mean of the last 100 losses of a run (no task ever holds a whole run)."""
    e = T.read(spark, sf_dir, "events", "event_id", "event_type", "ts", "value")
    r = ordered.sliding_window(e, ["event_type"], ["ts", "event_id"], "value", RECENT, "w")
    return r.select("event_id", "event_type", (F.round("w_sum", 6) / F.col("w_n")).alias("mean_recent"),
                    F.col("w_n").alias("n_recent"))


@register("r4_interval_perplexity", f"""
SELECT event_type, (step - 1) // {REPORT_STEPS} AS report, round(exp(avg(value / 100.0)), 4) AS ppl, count(*) AS steps
FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step FROM events)
GROUP BY 1, 2""")
def r4_interval_perplexity(spark, sf_dir):
    """Perplexity exp(mean loss) of the steps since a run's last report, every
    100 steps of the run (the last report may be short); losses are hundredths here."""
    e = T.read(spark, sf_dir, "events", "event_id", "event_type", "ts", "value")
    r = ordered.cumulative(e, ["event_type"], ["ts", "event_id"], count_col="step")
    return (r.groupBy("event_type", F.floor((F.col("step") - 1) / REPORT_STEPS).alias("report"))
            .agg(F.round(F.exp(F.avg(F.col("value") / 100.0)), 4).alias("ppl"),
                 F.count(F.lit(1)).alias("steps")))


@register("r5_latest_checkpoint", """
SELECT user_id, arg_max(event_id, (k, ts, event_id)) AS checkpoint, max(k) AS epoch FROM (
  SELECT user_id, event_id, ts, CAST(regexp_extract('checkpoint-epoch-' || json_extract_string(props, '$.k')
         || '-run-' || user_id, 'checkpoint-epoch-([0-9]+)-run-', 1) AS INTEGER) AS k
  FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL) GROUP BY user_id""")
def r5_latest_checkpoint(spark, sf_dir):
    """The checkpoint of the highest epoch of a run (the latest of equal ones), the
    epoch parsed from the checkpoint's name."""
    e = T.read(spark, sf_dir, "events", "event_id", "user_id", "ts", "props")
    k = F.get_json_object("props", "$.k")
    name = F.concat(F.lit("checkpoint-epoch-"), k, F.lit("-run-"), F.col("user_id").cast("string"))
    e = e.where(k.isNotNull()).withColumn("k", F.regexp_extract(name, "checkpoint-epoch-([0-9]+)-run-", 1).cast("int"))
    return e.groupBy("user_id").agg(
        F.max_by("event_id", F.struct("k", "ts", "event_id")).alias("checkpoint"), F.max("k").alias("epoch"))
