"""Streams over the events table, each drained to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import operations as O
from ..operators import sketches
from ..streaming import stateful as S
from ..streaming import tumbling
from .common import Registry
from .models import rounded
from .contracts import semantic_rows
from .operations import _LOG, _SKETCH, _TIERED

R = Registry()
_ARMS = {"control": 0.5, "small": 0.3, "large": 0.2}
_MOD = """(SELECT list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 16), lambda i: ('0x' || substr(sha256('exp:' || user_id), i * 4 + 1, 4))::BIGINT)), lambda a, b: (a * 65536 + b) % 10000))"""


def _events(spark, d):
    return S.stream_of(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@R.add("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_window_counts(spark, d):
    out = S.drained(S.window_counts(_events(spark, d), "ts", 3600, ("event_type",), "value"), "complete")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


@R.add("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, d):
    return S.drained(S.first_seen(_events(spark, d).select("user_id", "event_type"), ("user_id", "event_type")))


@R.add(f"""SELECT arm, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM (
  SELECT event_type, value, CASE WHEN {_MOD} / 10000.0::DOUBLE <= 0.5 THEN 'control' WHEN {_MOD} / 10000.0::DOUBLE <= 0.8 THEN 'small' ELSE 'large' END AS arm FROM events) GROUP BY 1, 2""")
def stream_experiment_totals(spark, d):
    events = _events(spark, d).withColumn("arm", O.variant(F.lit("exp"), F.col("user_id"), _ARMS))
    return S.drained(S.metric_totals(events, ("arm", "event_type"), "value"), "complete").withColumn("total", F.round("total", 4))


@R.add(_LOG.format(second="epoch_us(ts) / 1e6::DOUBLE", key="user_id, "))
def stream_rate_limit(spark, d):
    hits = _events(spark, d).withColumn("second", F.unix_micros("ts") / 1e6)
    return S.drained(S.limited(hits, "user_id", "second", "event_id", 86400.0, 2))


@R.add(_TIERED)
def stream_rate_limit_tiers(spark, d):
    tiers = F.array(*map(F.lit, ("free", "pro", "academic", "trial")))
    hits = _events(spark, d).select("user_id", "event_id", (F.unix_micros("ts") / 1e6).alias("second"), F.get(tiers, (F.col("user_id") % 4).cast("int")).alias("tier"))
    return S.drained(S.limited_by_tier(hits, "user_id", "tier", "second", "event_id", {"free": (2, 86400), "pro": (5, 172800), "academic": None, "commercial": None}, (3, 259200)))


@R.add(_SKETCH)
def stream_latency_sketch(spark, d):
    return S.drained(sketches.sketch(_events(spark, d), "value", ("event_type",)), "complete")


@R.add(f"""SELECT 'all' AS source, "window", peaks_ks, peaks_p, precursor_ks, precursor_p, intensity_gap AS gap, adduct_chi2, reasons, drift FROM ({semantic_rows.sql}) WHERE ("window" + 1) * 100 <= (SELECT count(*) FROM embeddings)""".replace("'peak counts'", "'peaks'").replace("'precursor masses'", "'precursor'").replace("'intensity quantiles'", "'intensities'"))
def stream_semantic_drift(spark, d):
    rows = semantic_rows(S.stream_of(spark, d, "embeddings")).withColumn("source", F.lit("all"))
    with tumbling.rocks_state(spark):
        out = S.drained(tumbling.tumbling_drift(rows, "source", "vec_id", 100, ("peaks", "precursor"), "intensities", ("adduct",)))
    return rounded(out.drop("adduct_p"), 6)
