"""Motion segments and the sampling plans made from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rushes.operators import joins, sampling, segments, timeplans
from rushes.plans.bindings import FILES, FRAMES, OBS, durations, motion_frames, observations
from rushes.plans.registry import query

SEGS = FRAMES + """, marks AS (
  SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER w THEN 1 ELSE 0 END AS opens,
         lead(t) OVER w AS next_t
  FROM frames WINDOW w AS (PARTITION BY file_id ORDER BY t, idx)
), runs AS (
  SELECT *, sum(opens) OVER (PARTITION BY file_id ORDER BY t, idx) - 1 AS seg FROM marks
), segs AS (
  SELECT file_id, seg::BIGINT AS seg, min(t) AS "start", max(coalesce(next_t, t + 0.2)) AS "end", min(label) AS label,
         avg(intensity) AS intensity, count(*) AS n_rows, sum(intensity) AS value_sum
  FROM runs GROUP BY file_id, seg)"""

# Absorption step by step, as the definition reads.
MERGED = SEGS + """, folded AS (
  SELECT file_id, seg, seg AS head, "start", "end", label, intensity FROM segs WHERE seg = 0
  UNION ALL
  SELECT s.file_id, s.seg,
         CASE WHEN s."end" - s."start" < 0.5 THEN f.head ELSE s.seg END,
         CASE WHEN s."end" - s."start" < 0.5 THEN f."start" ELSE s."start" END,
         s."end",
         CASE WHEN s."end" - s."start" < 0.5 AND f."end" - f."start" > s."end" - s."start" THEN f.label ELSE s.label END,
         CASE WHEN s."end" - s."start" < 0.5 THEN (f.intensity + s.intensity) / 2 ELSE s.intensity END
  FROM folded f JOIN segs s ON s.file_id = f.file_id AND s.seg = f.seg + 1
), merged AS (
  SELECT file_id, head AS seg, max("start") AS "start", max("end") AS "end",
         max_by(label, seg) AS label, max_by(intensity, seg) AS intensity
  FROM folded GROUP BY file_id, head)"""

SUMMARY = """per_label AS (
  SELECT file_id, label, sum("end" - "start") AS total, min(seg) AS first_seg, count(*) AS n FROM merged GROUP BY ALL
), summary AS (
  SELECT p.file_id, any_value(f.duration) AS duration,
         max_by(label, {'t': total, 'f': -first_seg}) AS primary_label,
         any_value(m.mean_intensity) AS mean_intensity,
         sum(CASE WHEN label = 'static' THEN total ELSE 0 END) AS static_time,
         sum(CASE WHEN label = 'static' THEN total ELSE 0 END) > any_value(f.duration) * 0.7
           OR any_value(m.mean_intensity) < 2.0 AS is_stable,
         sum(p.n)::BIGINT AS n_segments, any_value(m.n)::BIGINT AS n_frames
  FROM per_label p JOIN files f USING (file_id)
       JOIN (SELECT file_id, avg(intensity) AS mean_intensity, count(*) AS n FROM frames GROUP BY 1) m USING (file_id)
  GROUP BY p.file_id)"""

ALL = "WITH RECURSIVE " + MERGED + ", " + FILES + ", " + SUMMARY


def merged_segments(spark, sf_dir):
    return segments.absorb_short(segments.run_segments(motion_frames(spark, sf_dir)))


def summaries(spark, sf_dir, merged=None):
    merged = merged if merged is not None else merged_segments(spark, sf_dir)
    return segments.motion_summary(merged, files=durations(spark, sf_dir))


@query("motion_segments", "WITH " + SEGS + """
SELECT file_id, seg, round("start", 6) AS "start", round("end", 6) AS "end", label,
       round(intensity, 6) AS intensity, n_rows FROM segs""")
def motion_segments(spark, sf_dir):
    segs = segments.run_segments(motion_frames(spark, sf_dir))
    return segs.select(
        "file_id", "seg", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "label",
        F.round("intensity", 6).alias("intensity"), "n_rows",
    )


@query("absorbed_segments", "WITH RECURSIVE " + MERGED + """
SELECT file_id, seg, round("start", 6) AS "start", round("end", 6) AS "end", label, round(intensity, 6) AS intensity
FROM merged""")
def absorbed_segments(spark, sf_dir):
    return merged_segments(spark, sf_dir).select(
        "file_id", "seg", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "label",
        F.round("intensity", 6).alias("intensity"),
    )


@query("motion_summary", ALL + """
SELECT file_id, round(duration, 6) AS duration, primary_label, round(mean_intensity, 6) AS mean_intensity,
       round(static_time, 6) AS static_time, is_stable, n_segments, n_frames FROM summary""")
def motion_summary(spark, sf_dir):
    out = summaries(spark, sf_dir)
    rounded = {c: F.round(c, 6) for c in ("duration", "mean_intensity", "static_time")}
    return out.withColumns(rounded).withColumn("n_segments", F.col("n_segments").cast("long")).drop("has_motion")


ADAPTIVE = ALL + """, stable AS (
  SELECT file_id, unnest(CASE
           WHEN mean_intensity < 1.0 AND duration < 10 THEN [duration / 2]
           WHEN mean_intensity < 1.0 THEN [duration * 0.15, duration * 0.5, duration * 0.85]
           WHEN least(5, greatest(1, trunc(duration / 10))) = 1 THEN [duration / 2]
           ELSE list_transform(range(1, least(5, greatest(1, trunc(duration / 10)))::BIGINT + 1),
                  lambda j: duration / (least(5, greatest(1, trunc(duration / 10))) + 1) * j) END) AS t,
         duration
  FROM summary WHERE is_stable
), stepped AS (
  SELECT file_id, duration, "start", "end", lag("start") OVER (PARTITION BY file_id ORDER BY "start", "end") AS before,
         CASE WHEN intensity < 0.5 THEN 10.0 WHEN intensity < 2 THEN 4.0 WHEN intensity < 4 THEN 2.0
              WHEN intensity < 6 THEN 1.0 ELSE 0.5 END AS every
  FROM merged JOIN summary USING (file_id) WHERE NOT is_stable
), own AS (
  SELECT s.file_id, s.duration, "start", "start" + 0.1 + i * every AS t
  FROM stepped s, range(0, 200) r(i) WHERE "start" + 0.1 + i * every < "end" - 0.1
), all_t AS (
  SELECT file_id, duration, t FROM own
  UNION
  SELECT file_id, duration, ("start" + "end") / 2 FROM stepped s
  WHERE NOT EXISTS (FROM own o WHERE o.file_id = s.file_id AND o."start" = s."start")
    AND before IS DISTINCT FROM "start"
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY file_id) AS n
  FROM all_t
), picked AS (
  SELECT file_id, duration, pos AS sample_no, t FROM placed WHERE n <= 100
  UNION ALL
  SELECT p.file_id, duration, i, t FROM placed p, range(0, 100) r(i)
  WHERE n > 100 AND pos = floor(i * (n::DOUBLE / 100))
), plan AS (
  SELECT file_id, sample_no, greatest(0.1, least(t, duration - 0.1)) AS t FROM picked
  UNION ALL
  SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY t) - 1, t FROM stable)"""


@query("adaptive_plan", ADAPTIVE + "\nSELECT file_id, sample_no::BIGINT AS sample_no, round(t, 6) AS t FROM plan")
def adaptive_plan(spark, sf_dir):
    merged = merged_segments(spark, sf_dir)
    plan = timeplans.adaptive_plan(summaries(spark, sf_dir, merged), merged)
    return plan.withColumn("t", F.round("t", 6))


@query("keypoint_plan", ALL + """, state AS (
  SELECT s.*, m.moves FROM summary s JOIN
    (SELECT file_id, bool_or(label NOT IN ('static', 'handheld')) AS moves FROM merged GROUP BY 1) m USING (file_id)
), cand AS (
  SELECT DISTINCT file_id, duration, unnest(CASE
      WHEN label IN ('static', 'handheld') THEN [("start" + "end") / 2]
      WHEN "end" - "start" > 1.0 THEN ["start" + 0.2, "end" - 0.2] ELSE ["start" + 0.2] END) AS t
  FROM merged JOIN state USING (file_id) WHERE moves OR NOT is_stable
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY file_id) AS n
  FROM cand
), picked AS (
  SELECT file_id, duration, pos AS sample_no, t FROM placed WHERE n <= 5
  UNION ALL
  SELECT p.file_id, duration, i, t FROM placed p, range(0, 5) r(i)
  WHERE n > 5 AND pos = CASE WHEN i = 4 THEN n - 1 ELSE floor(i * ((n - 1)::DOUBLE / 4)) END)
SELECT file_id, sample_no::BIGINT AS sample_no, round(greatest(0.1, least(t, duration - 0.1)), 6) AS t FROM picked
UNION ALL
SELECT file_id, 0, round(duration / 2, 6) FROM state WHERE NOT moves AND is_stable""")
def keypoint_plan(spark, sf_dir):
    merged = merged_segments(spark, sf_dir)
    plan = timeplans.keypoint_plan(summaries(spark, sf_dir, merged), merged)
    return plan.withColumn("t", F.round("t", 6))


@query("face_plan", "WITH " + FRAMES + ", " + FILES + """, f AS (
  SELECT file_id, duration, CASE WHEN m >= 10 THEN 3.0 WHEN m >= 6 THEN 2.0 WHEN m >= 2 THEN 1.5 ELSE 1.0 END AS fps
  FROM files JOIN (SELECT file_id, avg(intensity) AS m FROM frames GROUP BY 1) USING (file_id)
), n AS (SELECT *, greatest(1, trunc(duration * fps))::BIGINT AS n FROM f)
SELECT file_id, (j - 1)::BIGINT AS sample_no, round(duration / (n + 1) * j, 6) AS t
FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM n)""")
def face_plan(spark, sf_dir):
    frames = motion_frames(spark, sf_dir).groupBy("file_id").agg(F.avg("intensity").alias("mean_intensity"))
    files = durations(spark, sf_dir).join(frames, "file_id")
    return timeplans.face_plan(files).withColumn("t", F.round("t", 6))


@query("fallback_plan", "WITH " + OBS + ", " + FILES + """,
n AS (SELECT *, least(10, greatest(3, trunc(duration / 10)))::BIGINT AS n FROM files)
SELECT file_id, (j - 1)::BIGINT AS sample_no, round(duration / (n + 1) * j, 6) AS t
FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM n)""")
def fallback_plan(spark, sf_dir):
    return timeplans.fallback_plan(durations(spark, sf_dir)).withColumn("t", F.round("t", 6))


@query("shot_plan", "WITH " + OBS + ", " + FILES + """
SELECT file_id, i::BIGINT AS sample_no, round((i + 0.5) * duration / 5, 6) AS t FROM files, range(0, 5) r(i)""")
def shot_plan(spark, sf_dir):
    return timeplans.shot_plan(durations(spark, sf_dir)).withColumn("t", F.round("t", 6))


@query("thin_plan", ADAPTIVE + """, counted AS (
  SELECT p.file_id, sample_no, t, mean_intensity, is_stable,
         row_number() OVER (PARTITION BY p.file_id ORDER BY sample_no) - 1 AS pos,
         count(*) OVER (PARTITION BY p.file_id) AS n
  FROM plan p JOIN summary USING (file_id))
SELECT file_id, sample_no::BIGINT AS sample_no, round(t, 6) AS t FROM counted
WHERE CASE WHEN NOT is_stable THEN true
           WHEN mean_intensity < 1 THEN n <= 3 OR pos IN (0, n // 2, n - 1)
           ELSE pos % 4 = 0 END""")
def thin_plan(spark, sf_dir):
    merged = merged_segments(spark, sf_dir)
    summary = summaries(spark, sf_dir, merged)
    thinned = timeplans.thin_plan(timeplans.adaptive_plan(summary, merged), summary)
    return thinned.withColumn("t", F.round("t", 6))


GREEDY = """
SELECT file_id, round(t, 6) AS t, idx FROM kept"""


@query("sample_every", "WITH RECURSIVE " + OBS + """, ordered AS (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY t, idx) AS rn FROM obs
), walk AS (
  SELECT file_id, t, idx, rn, t AS last, true AS keep FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.file_id, o.t, o.idx, o.rn, CASE WHEN o.t - w.last >= 1.0 THEN o.t ELSE w.last END, o.t - w.last >= 1.0
  FROM walk w JOIN ordered o ON o.file_id = w.file_id AND o.rn = w.rn + 1
), kept AS (SELECT * FROM walk WHERE keep)""" + GREEDY)
def sample_every(spark, sf_dir):
    obs = observations(spark, sf_dir).select("file_id", "t", "idx")
    return sampling.sample_every(obs, interval=1.0, order=["t", "idx"]).withColumn("t", F.round("t", 6))


@query("sample_every_valid", "WITH RECURSIVE " + OBS + """, ordered AS (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY t, idx) AS rn FROM obs
), walk AS (
  SELECT file_id, t, idx, rn, t AS last, true AS keep, label FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.file_id, o.t, o.idx, o.rn, CASE WHEN o.t - w.last >= 1.0 THEN o.t ELSE w.last END, o.t - w.last >= 1.0, o.label
  FROM walk w JOIN ordered o ON o.file_id = w.file_id AND o.rn = w.rn + 1
), kept AS (SELECT * FROM walk WHERE keep AND label <> 'error')""" + GREEDY)
def sample_every_valid(spark, sf_dir):
    obs = observations(spark, sf_dir).select("file_id", "t", "idx", "label")
    kept = sampling.sample_every(obs, interval=1.0, order=["t", "idx"], valid=F.col("label") != "error")
    return kept.drop("label").withColumn("t", F.round("t", 6))


@query("merge_times", "WITH RECURSIVE " + OBS + """, times AS (
  SELECT DISTINCT file_id, t FROM obs WHERE label IN ('view', 'click')
), ordered AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY t) AS rn FROM times
), walk AS (
  SELECT file_id, t, rn, t AS last, true AS keep FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.file_id, o.t, o.rn, CASE WHEN o.t - w.last >= 0.3 THEN o.t ELSE w.last END, o.t - w.last >= 0.3
  FROM walk w JOIN ordered o ON o.file_id = w.file_id AND o.rn = w.rn + 1)
SELECT file_id, round(t, 6) AS t FROM walk WHERE keep""")
def merge_times(spark, sf_dir):
    obs = observations(spark, sf_dir)
    merged = sampling.merge_times(obs.filter("label = 'view'"), obs.filter("label = 'click'"))
    return merged.withColumn("t", F.round("t", 6))


@query("union_times", "WITH " + OBS + """
SELECT DISTINCT file_id, round(t, 6) AS t FROM obs WHERE label IN ('view', 'purchase')""")
def union_times(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("t", F.round("t", 6))
    return sampling.union_times(obs.filter("label = 'view'"), obs.filter("label = 'purchase'"))


@query("label_times", "WITH " + OBS + "\nSELECT DISTINCT file_id, round(t, 6) AS t FROM obs WHERE label = 'purchase'")
def label_times(spark, sf_dir):
    return sampling.label_times(observations(spark, sf_dir).withColumn("t", F.round("t", 6)), "purchase")


@query("scenes_from_scores", "WITH " + OBS + """, scored AS (
  SELECT file_id, t, intensity * 3 AS score, row_number() OVER (PARTITION BY file_id ORDER BY t) AS rn FROM obs
), numbered AS (
  SELECT *, sum(CASE WHEN rn > 1 AND score >= 27 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY t) AS scene,
         lead(t) OVER (PARTITION BY file_id ORDER BY t) AS next_t
  FROM scored
), s AS (
  SELECT file_id, scene::BIGINT AS scene, CASE WHEN scene = 0 THEN 0 ELSE min(t) END AS "start",
         max(coalesce(next_t, t + 0.2)) AS "end" FROM numbered GROUP BY file_id, scene)
SELECT file_id, scene, round("start", 6) AS "start", round("end", 6) AS "end", round("end" - "start", 3) AS duration FROM s""")
def scenes_from_scores(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("score", F.col("intensity") * 3)
    scenes = segments.scenes_from_scores(obs, durations=durations(spark, sf_dir))
    return scenes.withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})
