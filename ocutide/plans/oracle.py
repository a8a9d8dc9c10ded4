"""Independent SQL for the registered queries, as one chain of common table expressions."""

from __future__ import annotations

import re

from ocutide.model import MAD_SCALE, Params

FRAMES, SECONDS = 100, 1.0
#: Thresholds of the example signal, which is noisier than a recording.
P = Params(good_corr=0.5, best_corr=0.7, min_good_blinks=2, amp_range=(1.0, 50.0), min_good_ratio=0.3)

CTES = f"""
ev AS (SELECT event_type AS ch, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, CAST(round(value * 100) AS BIGINT) AS c FROM events),
sm AS (SELECT ch, i, sum(c) OVER (PARTITION BY ch ORDER BY i ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS s FROM ev),
samples AS MATERIALIZED (SELECT ch, i, CAST(s - floor(median(s) OVER (PARTITION BY ch)) AS DOUBLE) AS v FROM sm),
len AS (SELECT ch, max(i) + 1 AS n FROM samples GROUP BY ch),
med AS (SELECT ch, avg(v) AS mean, median(v) AS med FROM samples GROUP BY ch),
madt AS (SELECT ch, mean, med, median(abs(v - med)) AS mad FROM samples JOIN med USING (ch) GROUP BY ch, mean, med),
thr AS (SELECT ch, mean + {P.std_threshold} * {MAD_SCALE} * mad AS thr FROM madt),
st AS (SELECT ch, i, CASE WHEN v > thr THEN 1 WHEN v < thr THEN 0 END AS st FROM samples JOIN thr USING (ch)),
edge AS (SELECT ch, i, st, lag(st, 1, 0) OVER (PARTITION BY ch ORDER BY i) AS before FROM st WHERE st IS NOT NULL),
runs AS (SELECT ch, i AS start_blink, stop AS end_blink FROM (SELECT ch, i, st, lead(i) OVER (PARTITION BY ch ORDER BY i) AS stop FROM edge WHERE st <> before) WHERE st = 1),
cand AS (SELECT * FROM runs WHERE end_blink - start_blink > {P.min_event_len} * {P.sfreq}),
blinks AS MATERIALIZED (SELECT ch, start_blink, end_blink FROM (SELECT *, lag(end_blink) OVER w AS pe, lead(start_blink) OVER w AS ns FROM cand WINDOW w AS (PARTITION BY ch ORDER BY start_blink))
  WHERE NOT (coalesce((start_blink - pe) / {P.sfreq} <= {P.min_event_len}, false) OR coalesce((ns - end_blink) / {P.sfreq} <= {P.min_event_len}, false))),
pk AS (SELECT b.ch, start_blink, end_blink, s.i, s.v, max(s.v) OVER (PARTITION BY b.ch, start_blink) AS max_value FROM blinks AS b JOIN samples AS s ON s.ch = b.ch AND s.i BETWEEN start_blink AND end_blink),
peaks AS MATERIALIZED (SELECT ch, start_blink, end_blink, max_value, min(i) AS max_blink FROM pk WHERE v = max_value GROUP BY ALL),
bounded AS MATERIALIZED (SELECT p.*, n, coalesce(lag(max_blink) OVER w, 0) AS outer_start, coalesce(lead(max_blink) OVER w, n) AS outer_end FROM peaks AS p JOIN len USING (ch) WINDOW w AS (PARTITION BY ch ORDER BY max_blink)),
zeros AS MATERIALIZED (SELECT b.*, (SELECT max(i) FROM samples AS s WHERE s.ch = b.ch AND s.i < b.max_blink AND s.v < 0) AS left_zero, (SELECT min(i) FROM samples AS s WHERE s.ch = b.ch AND s.i >= b.max_blink AND s.v < 0) AS right_zero FROM bounded AS b),
vel AS MATERIALIZED (SELECT * FROM (SELECT ch, i, lead(v) OVER (PARTITION BY ch ORDER BY i) - v AS vel FROM samples) WHERE vel IS NOT NULL),
strokes AS MATERIALIZED (SELECT * FROM (SELECT z.*,
  (SELECT i FROM vel AS s WHERE s.ch = z.ch AND i BETWEEN left_zero AND max_blink ORDER BY vel DESC, i LIMIT 1) AS mpv,
  (SELECT i FROM vel AS s WHERE s.ch = z.ch AND i BETWEEN max_blink AND right_zero ORDER BY vel, i LIMIT 1) AS mnv FROM zeros AS z WHERE left_zero IS NOT NULL AND right_zero IS NOT NULL) WHERE outer_start < mpv),
based AS MATERIALIZED (SELECT * FROM (SELECT z.*,
  greatest(mpv - coalesce(mpv - (SELECT max(i) FROM vel AS s WHERE s.ch = z.ch AND i BETWEEN outer_start AND mpv AND vel <= 0), 0) - 1, 0) AS left_base,
  CASE WHEN mnv <= outer_end AND mnv <= least(outer_end, n - 1) - 1 THEN coalesce((SELECT min(i) FROM vel AS s WHERE s.ch = z.ch AND i BETWEEN mnv AND least(outer_end, n - 1) - 1 AND vel >= 0), mnv) + 1 END AS right_base FROM strokes AS z) WHERE right_base IS NOT NULL),
levels AS (SELECT z.*, t.v AS top, t.v - 0.5 * (t.v - b.v) AS half, t.v - {P.base_fraction} * (t.v - l.v) AS hi, l.v + {P.base_fraction} * (t.v - l.v) AS lo
  FROM based AS z JOIN samples AS t ON t.ch = z.ch AND t.i = max_blink JOIN samples AS b ON b.ch = z.ch AND b.i = left_base JOIN samples AS l ON l.ch = z.ch AND l.i = left_zero),
halves AS MATERIALIZED (SELECT z.*,
  coalesce((SELECT min(i) FROM samples AS s WHERE s.ch = z.ch AND i BETWEEN left_zero AND max_blink AND v >= 0.5 * top), left_zero) + 1 AS left_zero_half_height,
  least(outer_end, coalesce((SELECT min(i) FROM samples AS s WHERE s.ch = z.ch AND i BETWEEN max_blink AND right_zero AND v <= 0.5 * top), max_blink)) AS right_zero_half_height,
  coalesce((SELECT min(i) FROM samples AS s WHERE s.ch = z.ch AND i BETWEEN left_base AND max_blink AND v >= half), left_base) + 1 AS left_base_half_height,
  least(outer_end, coalesce((SELECT min(i) FROM samples AS s WHERE s.ch = z.ch AND i BETWEEN max_blink AND outer_end AND v <= half), max_blink)) AS right_base_half_height,
  (SELECT min(i) FROM samples AS s WHERE s.ch = z.ch AND i BETWEEN left_zero AND max_blink AND v > lo) AS left_lo,
  (SELECT max(i) FROM samples AS s WHERE s.ch = z.ch AND i BETWEEN left_zero AND max_blink AND v < hi) AS left_hi,
  coalesce((SELECT min(i) FROM samples AS s WHERE s.ch = z.ch AND i BETWEEN max_blink AND right_zero AND v < hi), max_blink) AS right_lo,
  (SELECT max(i) FROM samples AS s WHERE s.ch = z.ch AND i BETWEEN max_blink AND right_zero AND v > lo) AS right_hi FROM levels AS z),
ranges AS MATERIALIZED (SELECT * FROM halves WHERE left_hi - left_lo >= 1 AND right_hi - right_lo >= 1),
sides AS (SELECT z.ch, start_blink, regr_slope(v, i) AS ls, regr_intercept(v, i) AS li, abs(corr(v, i)) AS lr FROM ranges AS z JOIN samples AS s ON s.ch = z.ch AND i BETWEEN left_lo AND left_hi GROUP BY ALL),
sides2 AS (SELECT z.ch, start_blink, regr_slope(v, i) AS rs, regr_intercept(v, i) AS ri, abs(corr(v, i)) AS rr FROM ranges AS z JOIN samples AS s ON s.ch = z.ch AND i BETWEEN right_lo AND right_hi GROUP BY ALL),
lines AS MATERIALIZED (SELECT z.*, ls AS left_slope, rs AS right_slope, lr AS left_r2, rr AS right_r2, (ri - li) / nullif(ls - rs, 0) AS x_intersect, ls * ((ri - li) / nullif(ls - rs, 0)) + li AS y_intersect, -li / nullif(ls, 0) AS left_x_intercept, -ri / nullif(rs, 0) AS right_x_intercept
  FROM ranges AS z JOIN sides USING (ch, start_blink) JOIN sides2 USING (ch, start_blink)),
graded AS (SELECT *, left_r2 >= {P.best_corr} AND right_r2 >= {P.best_corr} AS best, left_r2 >= {P.good_corr} AND right_r2 >= {P.good_corr} AS good FROM lines),
gmed AS (SELECT ch, median(max_value) FILTER (best) AS bm, median(max_value) FILTER (NOT good) AS wm FROM graded GROUP BY ch),
gstd AS (SELECT ch, bm, wm, count(*) AS nb, count(*) FILTER (good) AS ng, {MAD_SCALE} * median(abs(max_value - bm)) FILTER (best) AS bs, {MAD_SCALE} * median(abs(max_value - wm)) FILTER (NOT good) AS ws FROM graded JOIN gmed USING (ch) GROUP BY ALL),
grat AS (SELECT ch, count(*) FILTER (good AND abs(max_value - bm) <= 2 * bs) / nullif(count(*) FILTER (abs(max_value - bm) <= 2 * bs), 0) AS gr FROM graded JOIN gstd USING (ch) GROUP BY ch),
mask AS (SELECT DISTINCT ch, unnest(range(left_zero - 1, right_zero)) AS i FROM lines),
ratio AS (SELECT s.ch, avg(v) FILTER (m.i IS NOT NULL) / nullif(avg(v) FILTER (m.i IS NULL), 0) AS ar FROM samples AS s LEFT JOIN mask AS m USING (ch, i) WHERE v > 0 GROUP BY s.ch),
stats AS MATERIALIZED (SELECT ch, nb AS number_blinks, ng AS number_good_blinks, ar AS blink_amp_ratio, bm AS best_median, bs AS best_robust_std, (bm * ws + wm * bs) / nullif(bs + ws, 0) AS cutoff, gr AS good_ratio FROM gstd JOIN grat USING (ch) LEFT JOIN ratio USING (ch)),
masked AS MATERIALIZED (SELECT l.*, s.best_median, s.best_robust_std FROM lines AS l JOIN stats AS s USING (ch) WHERE coalesce(
  left_r2 >= {P.good_corr} AND right_r2 >= {P.good_corr} AND max_value BETWEEN greatest(best_median - {P.good_z} * best_robust_std, 0) AND best_median + {P.good_z} * best_robust_std
  OR left_r2 >= {P.best_corr} AND right_r2 >= {P.best_corr} AND max_value BETWEEN greatest(best_median - {P.best_z} * best_robust_std, 0) AND best_median + {P.best_z} * best_robust_std, false)),
ext AS (SELECT z.*,
  (SELECT max(vel) FROM vel AS s WHERE s.ch = z.ch AND i BETWEEN left_zero AND max_blink) AS pvz, (SELECT min(vel) FROM vel AS s WHERE s.ch = z.ch AND i BETWEEN max_blink AND right_zero) AS nvz,
  (SELECT max(vel) FROM vel AS s WHERE s.ch = z.ch AND i BETWEEN left_base AND max_blink) AS pvb, (SELECT min(vel) FROM vel AS s WHERE s.ch = z.ch AND i BETWEEN max_blink AND right_base) AS nvb,
  (SELECT i FROM vel AS s WHERE s.ch = z.ch AND i BETWEEN left_zero AND max_blink ORDER BY vel DESC, i LIMIT 1) AS peaks_pos_vel_zero,
  (SELECT i FROM vel AS s WHERE s.ch = z.ch AND i BETWEEN left_base AND max_blink ORDER BY vel DESC, i LIMIT 1) AS peaks_pos_vel_base,
  (SELECT min(i) FROM samples AS s WHERE s.ch = z.ch AND i BETWEEN left_base AND right_base AND v >= {P.shut_amp_fraction} * max_value) AS shut_from,
  greatest(trunc(left_x_intercept), 0) AS tent_lo, greatest(trunc(right_x_intercept), 0) AS tent_hi FROM masked AS z),
ext2 AS (SELECT z.*, (SELECT min(i) FROM samples AS s WHERE s.ch = z.ch AND i BETWEEN shut_from AND right_base AND v < {P.shut_amp_fraction} * max_value) - shut_from AS shut_len,
  (SELECT min(i) FROM samples AS s WHERE s.ch = z.ch AND i BETWEEN tent_lo AND tent_hi AND v >= {P.shut_amp_fraction} * max_value) AS tent_from FROM ext AS z),
props AS MATERIALIZED (SELECT z.*,
  (right_base - left_base) / 100.0 AS duration_base, (right_zero - left_zero) / 100.0 AS duration_zero, (max_blink - left_zero) / 100.0 AS closing_time_zero, (right_zero - max_blink) / 100.0 AS reopening_time_zero,
  CASE WHEN shut_from IS NULL THEN 0 ELSE shut_len / 100.0 END AS time_shut_base, max_value AS peak_max_blink, max_blink / 100.0 AS peak_time_blink,
  100 * abs(top / nullif(pvz, 0)) / 100.0 AS pos_amp_vel_ratio_zero, 100 * abs(top / nullif(nvz, 0)) / 100.0 AS neg_amp_vel_ratio_zero,
  100 * abs(top / nullif(pvb, 0)) / 100.0 AS pos_amp_vel_ratio_base, 100 * abs(top / nullif(nvb, 0)) / 100.0 AS neg_amp_vel_ratio_base,
  -peaks_pos_vel_base / 100.0 AS inter_blink_max_vel_base, -peaks_pos_vel_zero / 100.0 AS inter_blink_max_vel_zero,
  (coalesce(lead(max_blink) OVER (PARTITION BY ch ORDER BY max_blink), n) - max_blink) / 100.0 AS inter_blink_max_amp,
  (right_x_intercept - left_x_intercept) / 100.0 AS duration_tent, (right_base_half_height - left_base_half_height + 1) / 100.0 AS duration_half_base, (right_zero_half_height - left_zero_half_height + 1) / 100.0 AS duration_half_zero,
  100 * abs(top / nullif(right_slope, 0)) / 100.0 AS neg_amp_vel_ratio_tent, 100 * abs(top / nullif(left_slope, 0)) / 100.0 AS pos_amp_vel_ratio_tent,
  (x_intersect - left_x_intercept) / 100.0 AS closing_time_tent, (right_x_intercept - x_intersect) / 100.0 AS reopening_time_tent,
  CASE WHEN tent_from IS NULL THEN 0 ELSE ((SELECT min(i) FROM samples AS s WHERE s.ch = z.ch AND i >= tent_from AND i < tent_hi AND v < {P.shut_amp_fraction} * max_value) - tent_from) / 100.0 END AS time_shut_tent,
  y_intersect AS peak_max_tent, x_intersect / 100.0 AS peak_time_tent FROM ext2 AS z),
final AS MATERIALIZED (SELECT * FROM props WHERE NOT coalesce(pos_amp_vel_ratio_zero < {P.p_avr_threshold} AND max_value < best_median - best_robust_std, false)),
c1 AS (SELECT * FROM stats WHERE blink_amp_ratio BETWEEN {P.amp_range[0]} AND {P.amp_range[1]} OR NOT coalesce((SELECT bool_or(blink_amp_ratio BETWEEN {P.amp_range[0]} AND {P.amp_range[1]}) FROM stats), false)),
c2 AS (SELECT * FROM c1 WHERE number_good_blinks > {P.min_good_blinks} OR NOT coalesce((SELECT bool_or(number_good_blinks > {P.min_good_blinks}) FROM c1), false)),
chosen AS (SELECT * FROM c2 WHERE good_ratio >= {P.min_good_ratio} OR NOT coalesce((SELECT bool_or(good_ratio >= {P.min_good_ratio}) FROM c2), false)),
ann AS MATERIALIZED (SELECT ch, start_blink, end_blink, start_blink / 100.0 AS onset, (end_blink - start_blink) / 100.0 AS duration FROM blinks),
ep AS MATERIALIZED (SELECT ch, e AS epoch_id FROM (SELECT ch, unnest(range(CAST(floor(n / {FRAMES}) AS BIGINT))) AS e FROM len)),
epx AS MATERIALIZED (SELECT ep.ch, epoch_id, i - epoch_id * {FRAMES} AS k, v FROM ep JOIN samples AS s ON s.ch = ep.ch AND floor(s.i / {FRAMES}) = epoch_id),
hit AS (SELECT b.*, ep.epoch_id, epoch_id * {FRAMES} AS ep_start, (least(end_blink, epoch_id * {FRAMES} + {FRAMES - 1}) - greatest(start_blink, epoch_id * {FRAMES}) + 1) / (end_blink - start_blink + 1) AS fraction
  FROM blinks AS b JOIN ep ON ep.ch = b.ch AND start_blink <= epoch_id * {FRAMES} + {FRAMES - 1} AND end_blink >= epoch_id * {FRAMES}),
major AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ch, start_blink ORDER BY fraction DESC, epoch_id) AS k FROM hit) WHERE k = 1 AND fraction >= 0.5),
mapped AS MATERIALIZED (SELECT ep.ch, ep.epoch_id, count(m.start_blink) AS n_blinks,
  coalesce(list((greatest(start_blink, ep_start) - ep_start) / 100.0 ORDER BY start_blink) FILTER (start_blink IS NOT NULL), []) AS blink_onset, coalesce(list((end_blink - start_blink) / 100.0 ORDER BY start_blink) FILTER (start_blink IS NOT NULL), []) AS blink_duration
  FROM ep LEFT JOIN major AS m ON m.ch = ep.ch AND m.epoch_id = ep.epoch_id WHERE ep.ch IN (SELECT ch FROM blinks) GROUP BY ep.ch, ep.epoch_id),
ow0 AS (SELECT a.*, epoch_id, greatest(onset, epoch_id * {SECONDS}) - epoch_id * {SECONDS} AS rs, least(onset + duration, (epoch_id + 1) * {SECONDS}) - epoch_id * {SECONDS} AS re
  FROM ann AS a JOIN ep USING (ch) WHERE greatest(onset, epoch_id * {SECONDS}) < least(onset + duration, (epoch_id + 1) * {SECONDS})),
ow1 AS (SELECT *, least(greatest(CAST(round_even(rs * 100.0, 0) AS BIGINT), 0), {FRAMES - 1}) AS start_rel, least(greatest(CAST(round_even(re * 100.0, 0) AS BIGINT) - 1, 0), {FRAMES - 1}) AS er FROM ow0),
ow AS MATERIALIZED (SELECT ch, start_blink, epoch_id, start_rel, greatest(er, start_rel) AS end_rel FROM ow1),
win AS MATERIALIZED (SELECT ch, epoch_id, greatest(a, 0) AS win_start, least(a + b, {FRAMES}) AS win_stop, duration FROM (SELECT ch, epoch_id, duration, CAST(round_even(onset * 100.0, 0) AS BIGINT) AS a, CAST(round_even(duration * 100.0, 0) AS BIGINT) AS b FROM (SELECT ch, epoch_id, unnest(blink_onset) AS onset, unnest(blink_duration) AS duration FROM mapped)) WHERE least(a + b, {FRAMES}) - greatest(a, 0) > 1),
wx AS MATERIALIZED (SELECT w.ch, w.epoch_id, win_start, any_value(w.duration) AS duration, list(v ORDER BY k) AS x FROM win AS w JOIN epx AS e ON e.ch = w.ch AND e.epoch_id = w.epoch_id AND k >= win_start AND k < win_stop GROUP BY w.ch, w.epoch_id, win_start),
kx AS MATERIALIZED (SELECT ch, epoch_id, list(v ORDER BY k) AS x FROM epx GROUP BY ALL),
shut AS (SELECT DISTINCT o.ch, o.epoch_id, unnest(range(start_rel, end_rel + 1)) AS k FROM ow AS o),
flagged AS MATERIALIZED (SELECT e.*, s.k IS NOT NULL AS shut FROM epx AS e LEFT JOIN shut AS s USING (ch, epoch_id, k)),
open_ AS MATERIALIZED (SELECT ch, epoch_id, k, v, row_number() OVER (PARTITION BY ch, epoch_id ORDER BY k) - 1 AS j FROM flagged WHERE NOT shut)
"""


def sql(final: str) -> str:
    """A statement over the chain."""
    return f"WITH {CTES.strip()}\n{final}"


def part(*names: str) -> str:
    """Some expressions of the chain, for use over other tables."""
    found = {text.split(" ", 1)[0]: text for text in re.split(r",\n(?=\w+ AS )", CTES.strip().rstrip(","))}
    return ",\n".join(found[name] for name in names)


def rounded(columns: list[str], digits: int = 4) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
