"""Queries about runs: schedules, ordered stacks, assignments, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackwright.operators import pairs, sequence
from stackwright.plans import monitor, presets
from stackwright.plans.registry import query, table
from stackwright.staging import fresh_path


@query("select event_id, round(case when e < 1 then 0.25 when e < 3 then 0.25 + 0.125*e else least(0.95, 0.5 + 0.05*e) end::double, 6) as radius from (select event_id, event_id/1000.0::double as e from events)")
def scheduled_radius(spark, d):
    """The share of the band that a coarse-to-fine run uses at each turn."""
    turns = table(spark, d, "events").select("event_id", (F.col("event_id") / 1000.0).alias("epoch"))
    out = presets.scheduled(turns, {"radius": presets.settings("coarse_to_fine")["radius"]})
    return out.select("event_id", F.round("radius", 6).alias("radius"))


@query("with s as (select c_custkey as row_id, c_name as name, 0 as stack from customer union all select s_suppkey + (select count(*) from customer), s_name, 1 from supplier) select row_number() over (order by row_id) - 1 as place, row_id, stack::int as stack, name from s")
def ordered_stacks(spark, d):
    """Two stacks as one, with the place of each row in the order in which they are gone through."""
    parts = [table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_name").alias("name")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_name").alias("name"))]
    return pairs.in_order(pairs.stacked(parts, "row_id"), "row_id").select("place", "row_id", F.col("stack").cast("int").alias("stack"), "name")


@query("select row_number() over (order by c, event_id) - 1 as image_id, event_id, c::int as ctf_id from (select event_id, (((event_id + 5) * 2654435761) % 4294967296) % 12 as c from events)")
def sorted_assignment(spark, d):
    """Optics drawn for each image, in such an order that images with equal ones lie together."""
    events = table(spark, d, "events").select("event_id", (sequence.shuffle_key(F.col("event_id"), 5) % 12).cast("int").alias("ctf_id"))
    return sequence.numbered(events, ["ctf_id", "event_id"], "image_id")


@query("select event_id, event_type || ' ' || user_id as line from events")
def run_log(spark, d):
    """Lines that were appended to a log in three goes, in the order of the log."""
    path, events = fresh_path(spark, "log"), table(spark, d, "events")
    for part in range(3):
        monitor.append_log(events.where(F.col("event_id") % 3 == part), path, "event_id", F.concat_ws(" ", "event_type", "user_id"))
    return monitor.read_log(spark, path).select(F.col("at").alias("event_id"), "line")
