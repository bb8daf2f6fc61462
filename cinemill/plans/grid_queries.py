"""Queries of the grid problem."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinemill.operators.regular_grid import MISSING, regular_grid
from cinemill.plans.tables import table


def _grid(spark, folder, bounds: bool):
    packets = table(spark, folder, "frame_packet")
    motion = F.col("motion_score")
    ends = None
    if bounds:
        # Every stream runs from second 0 to that of its last packet, usable or not.
        t = F.col("timestamp_ms")
        ends = packets.filter(t.isNotNull() & ~F.isnan(t)).groupBy("video_id").agg(
            F.lit(0).cast("long").alias("first_step"), F.floor(F.max(t) / 1000).alias("last_step")
        )
    return regular_grid(
        packets,
        "video_id",
        "timestamp_ms",
        ["motion_score", "audio_energy"],
        key="frame_id",
        usable=motion.between(0.0, 1.0),
        rate="fps_used",
        bounds=ends,
    )


def p4_found(spark, folder):
    return _grid(spark, folder, False).filter(F.col("status") == MISSING).select("video_id", F.col("step").alias("ts_second")).distinct()


def p4_grid(spark, folder):
    # Rounded, since sums of doubles depend on the order of their rows in the last digits.
    values = {c: F.round(c, 9) for c in ("motion_score", "audio_energy")}
    return _grid(spark, folder, True).withColumnRenamed("step", "ts_second").withColumns(values)


_USABLE = """u as (
  select distinct video_id, frame_id, timestamp_ms t, fps_used, motion_score m, case when isnan(audio_energy) then null else audio_energy end a
  from frame_packet where motion_score between 0 and 1 and not isnan(motion_score) and timestamp_ms is not null),
p as (
  select *, lead(t) over w nt, lead(fps_used) over w nf, lead(m) over w nm, lead(a) over w na from u
  window w as (partition by video_id order by t, frame_id)),
g as (
  select *, (nt - t) > 4 * greatest(1000 / fps_used, 1000 / nf) hole, unnest(range(floor(t / 1000)::bigint + 1, floor(nt / 1000)::bigint)) s
  from p where nt is not null)"""

QUERIES = {"p4_found": p4_found, "p4_grid": p4_grid}
SQL = {
    "p4_found": f"with {_USABLE} select distinct video_id, s as ts_second from g where hole",
    "p4_grid": f"""with {_USABLE},
e as (select video_id, floor(max(timestamp_ms) / 1000)::bigint z from frame_packet group by 1),
f as (select video_id, min(floor(t / 1000)::bigint) a, max(floor(t / 1000)::bigint) b from u group by 1),
x as (select e.video_id, unnest(range(0, z + 1)) s, a, b from e left join f using (video_id))
select video_id, ts_second, status, round(motion_score, 9) as motion_score, round(audio_energy, 9) as audio_energy from (
select video_id, floor(t / 1000)::bigint as ts_second, 'observed' as status, avg(m) as motion_score, avg(a) as audio_energy from u group by 1, 2
union all select video_id, s, case when hole then 'missing' else 'interpolated' end,
  case when not hole then m + (nm - m) * (((s + 0.5) * 1000 - t) / (nt - t)) end,
  case when not hole then a + (na - a) * (((s + 0.5) * 1000 - t) / (nt - t)) end from g
union all select video_id, s, 'edge', null, null from x where a is null or s < a or s > b)""",
}
