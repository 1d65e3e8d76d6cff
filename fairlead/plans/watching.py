"""Queries of tracking and of anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.operators import anomalies, risk, tracker
from fairlead.operators.fixes import is_sar_aircraft
from fairlead.plans.traffic import _ROUND, MOTIONS_SQL, RISKS_SQL, SESSIONS_SQL, rounded, rounded_up
from fairlead.sources import recorder
from fairlead.sources.tables import FIXES_SQL, fixes


def t5_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tracker.track(fixes(spark, sf_dir)).select("seq", "mmsi", "outcome", "nis", "lat", "lon", "sigma_m", "updates")
    return rounded(found, {"nis": 4, "lat": 6, "lon": 6, "sigma_m": 3})


def t6_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tracker.track(fixes(spark, sf_dir)).select("seq", "predicted_lat", "predicted_lon", "predicted_sigma_m")
    return rounded(found, {"predicted_lat": 6, "predicted_lon": 6, "predicted_sigma_m": 3})


def t8_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracker.tracks(tracker.track(fixes(spark, sf_dir))), {"lat": 6, "lon": 6, "v_east": 4, "v_north": 4, "sigma_m": 3})


def t9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.statistics(tracker.track(fixes(spark, sf_dir)))


def r5_track_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encounters of the filtered tracks instead of the last reports."""
    seen = fixes(spark, sf_dir)
    motions = risk.tracked(tracker.accepted(seen)).join(F.broadcast(risk.last_minute(seen)), F.col("minute") <= F.col("last_minute")).drop("last_minute")
    return rounded_up(risk.encountered(motions), _ROUND)


def a1_impossible_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(anomalies.impossible_speeds(fixes(spark, sf_dir)), {"lat": 6, "lon": 6})


def a2_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each report can be reached from the vessel's report before it."""
    order = Window.partitionBy("mmsi").orderBy("t", "seq")
    names = ("t", "lat", "lon", "sog")
    both = fixes(spark, sf_dir).withColumn("b", F.lag(F.struct(*names)).over(order)).filter("b IS NOT NULL")
    found = anomalies.reachable({n: F.col(f"b.{n}") for n in names}, {n: F.col(n) for n in names})
    return both.select("seq", found.alias("reachable"))


def k4_anomaly_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flags as JSON objects, read back."""
    names = {"kind": "string", "mmsi": "long", "t": "double", "lat": "double", "lon": "double", "value": "double", "distance_m": "double"}
    made = recorder.as_json(anomalies.detect(fixes(spark, sf_dir)), list(names))
    back = made.select(F.from_json("json", ", ".join(f"{n} {t}" for n, t in names.items())).alias("r")).select("r.*")
    return rounded(back, {"lat": 6, "lon": 6, "value": 3, "distance_m": 3})


def k5_encounter_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first assessment of every encounter as JSON objects, read back."""
    names = {"t": "double", "mmsi_a": "long", "mmsi_b": "long", "type": "string", "role_a": "string", "role_b": "string", "range_m": "double", "tcpa_s": "double", "dcpa_m": "double"}
    found = risk.encountered(risk.dead_reckoned(fixes(spark, sf_dir))).withColumnRenamed("minute", "t")
    back = recorder.as_json(found, list(names)).select(F.from_json("json", ", ".join(f"{n} {t}" for n, t in names.items())).alias("r")).select("r.*")
    return rounded(back, {"range_m": 3, "tcpa_s": 2, "dcpa_m": 2})


def n12_aircraft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether numbers, every fifth of them made one of a search and rescue aircraft, are such."""
    number = F.when(F.col("seq") % 5 == 0, 111_000_000 + F.col("seq") % 1_000_000).otherwise(F.col("mmsi"))
    return fixes(spark, sf_dir).select("seq", is_sar_aircraft(number).alias("aircraft"))


def a3_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(anomalies.detect(fixes(spark, sf_dir)), {"lat": 6, "lon": 6, "value": 3, "distance_m": 3})


def a6_gap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = anomalies.gap_candidates(fixes(spark, sf_dir)).select("mmsi", "t", "value", "verdict")
    return found


def a7_judged_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = fixes(spark, sf_dir)
    candidates = anomalies.gap_candidates(seen).filter("verdict = 'candidate'").drop("verdict")
    return anomalies.judged_gaps(candidates, seen).select("mmsi", "t", "value", F.col("down").cast("long").alias("down"), "others", "judged")


def a11_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.statistics(fixes(spark, sf_dir))


def a12_implied_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(anomalies.implied_speeds(fixes(spark, sf_dir)), {"distance_m": 3, "implied_kn": 3})


def e16_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of speeds and silences, by kind."""
    seen = fixes(spark, sf_dir)
    gaps = anomalies.judged_gaps(anomalies.gap_candidates(seen).filter("verdict = 'candidate'").drop("verdict"), seen).filter("judged = 'gap'")
    flags = anomalies.impossible_speeds(seen).select("kind", "mmsi", "t").unionByName(gaps.select(F.lit("gap").alias("kind"), "mmsi", "t"))
    return anomalies.summary(flags)


_PREVIOUS = "b AS (SELECT *, lag(t) OVER w AS bt, lag(lat) OVER w AS blat, lag(lon) OVER w AS blon, lag(sog) OVER w AS bsog FROM fixes WINDOW w AS (PARTITION BY mmsi ORDER BY t, seq))"
_STEP = geo.haversine_sql("blat", "blon", "lat", "lon")
_CANDIDATES = """
d AS (SELECT mmsi, t, arg_max(sog, seq) FILTER (WHERE sog IS NOT NULL) AS sog FROM fixes WHERE mmsi // 1000000 <> 111 GROUP BY mmsi, t),
w AS (SELECT *, lag(t) OVER p AS l1, lag(t, 3) OVER p AS l3, coalesce(last_value(sog IGNORE NULLS) OVER (PARTITION BY mmsi ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ls
      FROM d WINDOW p AS (PARTITION BY mmsi ORDER BY t)),
c AS (SELECT mmsi, t, l1, t - l1 AS value, CASE WHEN ls < 2 THEN 'slow' WHEN l3 IS NULL OR l1 - l3 > 600 THEN 'not_regular' ELSE 'candidate' END AS verdict FROM w WHERE t - l1 >= 600 AND floor(t / 600) * 600 - l1 <= 10800)"""
JUDGED_SQL = f"""{_CANDIDATES},
h AS (SELECT CAST(floor(t / 60) AS BIGINT) AS m, count(*) AS n FROM fixes GROUP BY 1),
cal AS (SELECT m, coalesce(n, 0) AS n FROM (SELECT unnest(range((SELECT min(m) FROM h), (SELECT max(m) FROM h) + 1)) AS m) LEFT JOIN h USING (m)),
k AS (SELECT mmsi, t, value, CAST(floor(l1 / 60) AS BIGINT) AS f, CAST(floor(t / 60) AS BIGINT) AS l FROM c WHERE verdict = 'candidate'),
u AS (SELECT k.*, (SELECT list(n ORDER BY n) FROM cal WHERE m >= greatest(f - 60, (SELECT min(m) FROM h) + 1) AND m < f) AS before FROM k),
s AS (SELECT *, CASE WHEN coalesce(len(before), 0) < 5 THEN 0 ELSE (SELECT count(*) FROM cal WHERE m > f AND m < l AND n < 0.25 * before[len(before) // 2 + 1]) END AS down FROM u),
j AS (SELECT mmsi, t, value, CAST(down AS BIGINT) AS down, (SELECT count(*) FROM k WHERE k.t >= s.t - 120 AND k.t < s.t + 120) - 1 AS others FROM s),
judged AS (SELECT *, CASE WHEN value - 60 * down < 600 THEN 'outage' WHEN others >= 3 THEN 'coverage_returned' ELSE 'gap' END AS judged FROM j)"""

_FAR = lambda a, b: geo.haversine_sql(f"{a}lat", f"{a}lon", f"{b}lat", f"{b}lon")
_REACH = lambda a: f"(CASE WHEN {a}sog IS NOT NULL AND fsog IS NOT NULL THEN least(50, greatest({a}sog, fsog) + 15) ELSE 50 END * {geo.KNOT_MS} * abs(ft - {a}t) + 500)"
_KNOTS = lambda d, a, b: f"{d} / greatest(abs({b} - {a}), 1) / {geo.KNOT_MS}"
_PLACE = ("t", "lat", "lon", "sog")
#: seen(...): where each vessel is taken to be, as a recursion over its n-th report: m (the leading place), b (the one
#: before) and r (a rival); every level of subqueries adds what the next needs.
SEEN_SQL = f"""
heard AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t, seq) AS k FROM fixes WHERE mmsi // 1000000 <> 111),
seen AS (
  SELECT k, mmsi, t AS ft, lat AS flat, lon AS flon, t AS last_t, t AS mt, lat AS mlat, lon AS mlon, sog AS msog, CAST(NULL AS DOUBLE) AS bt, CAST(NULL AS DOUBLE) AS blat, CAST(NULL AS DOUBLE) AS blon, CAST(NULL AS DOUBLE) AS bsog,
    CAST(NULL AS DOUBLE) AS rt, CAST(NULL AS DOUBLE) AS rlat, CAST(NULL AS DOUBLE) AS rlon, CAST(NULL AS DOUBLE) AS rsog, CAST(NULL AS DOUBLE) AS since, 0 AS times, false AS told, CAST(NULL AS DOUBLE) AS gap_m, false AS relocated,
    CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS DOUBLE) AS jt, CAST(NULL AS DOUBLE) AS jlat, CAST(NULL AS DOUBLE) AS jlon, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS distance_m FROM heard WHERE k = 1
  UNION ALL
  SELECT k, mmsi, ft, flat, flon, greatest(last_t, ft), nat, nalat, nalon, nasog, nbt, nblat, nblon, nbsog, nrt, nrlat, nrlon, nrsog, CASE WHEN verdict = 'strays' THEN ft ELSE since END, ntimes, told_now, gap_m, relocated,
    CASE WHEN verdict = 'returns' OR verdict = 'strays' THEN 'position_jump' WHEN told_now AND NOT told_before THEN 'identity_conflict' END,
    CASE WHEN verdict = 'returns' THEN mt ELSE ft END, CASE WHEN verdict = 'returns' THEN mlat ELSE flat END, CASE WHEN verdict = 'returns' THEN mlon ELSE flon END,
    CASE WHEN verdict = 'returns' THEN {_KNOTS("ba", "bt", "mt")} WHEN verdict = 'strays' THEN {_KNOTS("af", "mt", "ft")} ELSE af END, CASE WHEN verdict = 'returns' THEN ba WHEN verdict = 'strays' THEN af ELSE 0 END
  FROM (SELECT *, CASE WHEN verdict = 'strays' THEN false ELSE told OR (verdict = 'corroborates' AND ntimes >= 3 AND mt > since) END AS told_now, told AND verdict <> 'strays' AS told_before
        FROM (SELECT *, CASE WHEN verdict = 'strays' THEN 1 WHEN verdict = 'corroborates' AND ft > rt THEN times + 1 ELSE times END AS ntimes,
                CASE WHEN verdict = 'follows' THEN greatest(mt, ft) WHEN verdict = 'returns' THEN greatest(bt, ft) ELSE mt END AS nat, CASE WHEN verdict IN ('follows', 'returns') THEN flat ELSE mlat END AS nalat,
                CASE WHEN verdict IN ('follows', 'returns') THEN flon ELSE mlon END AS nalon, CASE WHEN verdict = 'follows' THEN coalesce(fsog, msog) WHEN verdict = 'returns' THEN coalesce(fsog, bsog) ELSE msog END AS nasog,
                {", ".join(f"CASE WHEN verdict = 'follows' AND ft > mt THEN m{c} WHEN verdict = 'returns' AND ft <= bt THEN NULL ELSE b{c} END AS nb{c}" for c in _PLACE)},
                CASE WHEN verdict = 'strays' THEN ft WHEN verdict = 'corroborates' THEN greatest(rt, ft) ELSE rt END AS nrt, CASE WHEN verdict IN ('strays', 'corroborates') THEN flat ELSE rlat END AS nrlat,
                CASE WHEN verdict IN ('strays', 'corroborates') THEN flon ELSE rlon END AS nrlon, CASE WHEN verdict = 'strays' THEN fsog WHEN verdict = 'corroborates' THEN coalesce(fsog, rsog) ELSE rsog END AS nrsog
              FROM (SELECT *, CASE WHEN af <= {_REACH("m")} THEN 'follows' WHEN rt IS NOT NULL AND {_FAR("r", "f")} <= {_REACH("r")} THEN 'corroborates'
                        WHEN bt IS NOT NULL AND bf <= {_REACH("b")} AND bf < ba / 2 THEN 'returns' ELSE 'strays' END AS verdict
                    FROM (SELECT *, {_FAR("m", "f")} AS af, {_FAR("b", "f")} AS bf, {_FAR("b", "m")} AS ba
                          FROM (SELECT k, mmsi, ft, flat, flon, fsog, last_t, since, times, told, gap_m, relocated, {", ".join(f"CASE WHEN relocated THEN r{c} ELSE m{c} END AS m{c}, CASE WHEN NOT relocated THEN b{c} END AS b{c}, CASE WHEN NOT relocated AND NOT lapsed THEN r{c} END AS r{c}" for c in _PLACE)}
                                FROM (SELECT *, lapsed IS FALSE AND rt IS NOT NULL AND ft - mt > 600 AS relocated
                                      FROM (SELECT f.k, f.mmsi, f.t AS ft, f.lat AS flat, f.lon AS flon, f.sog AS fsog, s.last_t, s.mt, s.mlat, s.mlon, s.msog, s.bt, s.blat, s.blon, s.bsog, s.rt, s.rlat, s.rlon, s.rsog, s.since, s.times, s.told,
                                              CASE WHEN f.t - s.last_t >= 600 THEN {geo.haversine_sql("s.mlat", "s.mlon", "f.lat", "f.lon")} END AS gap_m, coalesce(f.t - s.rt > 600, false) AS lapsed
                                            FROM seen s JOIN heard f ON f.mmsi = s.mmsi AND f.k = s.k + 1)))))))),
gaps AS (SELECT j.mmsi, j.t, j.value, j.judged, s.flat AS lat, s.flon AS lon, s.gap_m AS distance_m FROM judged j JOIN seen s ON s.mmsi = j.mmsi AND s.ft = j.t AND s.gap_m IS NOT NULL)"""
SEEN_WITH = f"WITH RECURSIVE {FIXES_SQL}, {JUDGED_SQL}, {SEEN_SQL}"

_M = geo.M_PER_DEG
_WRAP = "((({0}) + 540.0::DOUBLE) % 360.0::DOUBLE - 180.0::DOUBLE)"
#: tracked(...): the tracker as a recursion over each vessel's n-th fix; every level of subqueries adds what the next needs.
TRACKED_SQL = f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t, seq) AS k, sog * {geo.KNOT_MS} * sin(radians(cog)) AS ze, sog * {geo.KNOT_MS} * cos(radians(cog)) AS zn,
               sog IS NOT NULL AND cog IS NOT NULL AS moving, 225.0::DOUBLE AS r FROM fixes),
tracked AS (
  SELECT k, mmsi, seq, t AS moment, 'started' AS outcome, CAST(NULL AS DOUBLE) AS nis, lat AS lat0, lon AS lon0, 0.0::DOUBLE AS e, 0.0::DOUBLE AS n, CASE WHEN moving THEN ze ELSE 0.0::DOUBLE END AS ve,
    CASE WHEN moving THEN zn ELSE 0.0::DOUBLE END AS vn, r AS p, 0.0::DOUBLE AS c, CASE WHEN moving THEN 0.01::DOUBLE ELSE 25.0::DOUBLE END AS v, t, 0 AS rejects, 1 AS updates,
    CAST(NULL AS DOUBLE) AS plat, CAST(NULL AS DOUBLE) AS plon, CAST(NULL AS DOUBLE) AS psigma FROM numbered WHERE k = 1
  UNION ALL
  SELECT k, mmsi, seq, moment, outcome, nis,
    CASE WHEN fresh THEN flat WHEN far THEN lat0 + un / {_M} ELSE lat0 END, CASE WHEN fresh THEN flon WHEN far THEN {_WRAP.format(f"lon0 + ue / ({_M} * cos(radians(lat0)))")} ELSE lon0 END,
    CASE WHEN fresh OR far THEN 0.0::DOUBLE WHEN outcome = 'updated' THEN ue ELSE e END, CASE WHEN fresh OR far THEN 0.0::DOUBLE WHEN outcome = 'updated' THEN un ELSE n END,
    CASE WHEN fresh THEN CASE WHEN moving THEN ze ELSE 0.0::DOUBLE END WHEN outcome = 'updated' THEN uve ELSE ve END, CASE WHEN fresh THEN CASE WHEN moving THEN zn ELSE 0.0::DOUBLE END WHEN outcome = 'updated' THEN uvn ELSE vn END,
    CASE WHEN fresh THEN r WHEN outcome = 'updated' THEN a11 * a11 * p1 + 2 * a11 * a12 * c1 + a12 * a12 * v1 + k11 * k11 * r + k12 * k12 * rv ELSE p END,
    CASE WHEN fresh THEN 0.0::DOUBLE WHEN outcome = 'updated' THEN a11 * a21 * p1 + (a11 * a22 + a12 * a21) * c1 + a12 * a22 * v1 + k11 * k21 * r + k12 * k22 * rv ELSE c END,
    CASE WHEN fresh THEN CASE WHEN moving THEN 0.01::DOUBLE ELSE 25.0::DOUBLE END WHEN outcome = 'updated' THEN a21 * a21 * p1 + 2 * a21 * a22 * c1 + a22 * a22 * v1 + k21 * k21 * r + k22 * k22 * rv ELSE v END,
    CASE WHEN fresh OR outcome = 'updated' THEN moment ELSE t END, CASE WHEN fresh OR outcome = 'updated' THEN 0 WHEN outcome = 'rejected' THEN rejects + 1 ELSE rejects END,
    CASE WHEN fresh THEN 1 WHEN outcome = 'updated' THEN updates + 1 ELSE updates END, plat, plon, psigma
  FROM (SELECT *, e1 + k11 * ye + k12 * se AS ue, n1 + k11 * yn + k12 * sn AS un, ve + k21 * ye + k22 * se AS uve, vn + k21 * yn + k22 * sn AS uvn, 1 - k11 AS a11, CASE WHEN moving THEN -k12 ELSE 0 END AS a12,
          -k21 AS a21, CASE WHEN moving THEN 1 - k22 ELSE 1 END AS a22, outcome = 'updated' AND sqrt(pow(e1 + k11 * ye + k12 * se, 2) + pow(n1 + k11 * yn + k12 * sn, 2)) > 20000 AS far
        FROM (SELECT *, CASE WHEN moving THEN (p1 * d - c1 * c1) / det ELSE p1 / (p1 + r) END AS k11, CASE WHEN moving THEN (c1 * a - p1 * c1) / det ELSE 0 END AS k12,
                CASE WHEN moving THEN (c1 * d - v1 * c1) / det ELSE c1 / (p1 + r) END AS k21, CASE WHEN moving THEN (v1 * a - c1 * c1) / det ELSE 0 END AS k22,
                CASE WHEN stale THEN 'started' WHEN dt < -0.5 THEN 'out_of_order' WHEN dt < 0.5 THEN 'duplicate' WHEN y2 <= 18.42 THEN 'updated' WHEN rejects + 1 < 3 THEN 'rejected' ELSE 'restarted' END AS outcome,
                stale OR (dt >= 0.5 AND y2 > 18.42 AND rejects + 1 >= 3) AS fresh, CASE WHEN NOT stale AND dt >= 0.5 THEN y2 END AS nis
              FROM (SELECT *, (ye * ye + yn * yn) / (p1 + r) AS y2, p1 + r AS a, v1 + 0.01::DOUBLE AS d, (p1 + r) * (v1 + 0.01::DOUBLE) - c1 * c1 AS det, CASE WHEN moving THEN ze - ve ELSE 0 END AS se,
                      CASE WHEN moving THEN zn - vn ELSE 0 END AS sn, CASE WHEN moving THEN 0.01::DOUBLE ELSE 0 END AS rv, lat0 + n1 / {_M} AS plat, {_WRAP.format(f"lon0 + e1 / ({_M} * cos(radians(lat0)))")} AS plon, sqrt(p1) AS psigma
                    FROM (SELECT *, {_WRAP.format("flon - lon0")} * {_M} * cos(radians(lat0)) - e1 AS ye, (flat - lat0) * {_M} - n1 AS yn
                          FROM (SELECT *, e + ahead * ve AS e1, n + ahead * vn AS n1, p + 2 * ahead * c + ahead * ahead * v + 0.0025::DOUBLE * pow(ahead, 4) / 4 AS p1, c + ahead * v + 0.0025::DOUBLE * pow(ahead, 3) / 2 AS c1,
                                  v + 0.0025::DOUBLE * ahead * ahead AS v1
                                FROM (SELECT f.k, f.mmsi, f.seq, f.t AS moment, f.lat AS flat, f.lon AS flon, f.ze, f.zn, f.moving, f.r, s.lat0, s.lon0, s.e, s.n, s.ve, s.vn, s.p, s.c, s.v, s.t, s.rejects, s.updates,
                                        f.t - s.t AS dt, greatest(f.t - s.t, 0) AS ahead, floor(f.t / 60) * 60 - s.t > 1800 AS stale
                                      FROM tracked s JOIN numbered f ON f.mmsi = s.mmsi AND f.k = s.k + 1))))))),
placed AS (SELECT *, lat0 + n / {_M} AS lat, {_WRAP.format(f"lon0 + e / ({_M} * cos(radians(lat0)))")} AS lon, sqrt(p) AS sigma_m FROM tracked)"""
TRACKED_WITH = f"WITH RECURSIVE {FIXES_SQL}, {TRACKED_SQL}"
TRACK_MOTIONS_SQL = f"""
accepted AS (SELECT *, lead(moment) OVER (PARTITION BY mmsi ORDER BY moment, seq) AS next_t, (floor(moment / 60) + 1) * 60 AS minute FROM placed WHERE outcome IN ('started', 'updated', 'restarted')),
motions AS (SELECT minute, mmsi, lat + vn * (minute - moment) / {_M} AS lat, lon + ve * (minute - moment) / ({_M} * cos(radians(lat))) AS lon, ve AS v_east, vn AS v_north FROM accepted
            WHERE (next_t IS NULL OR next_t >= minute) AND minute - moment <= 60 AND minute <= (SELECT floor(max(t) / 60) * 60 FROM fixes))"""

_FLAGS_SQL = f"""{SEEN_WITH} SELECT kind, mmsi, t, round(lat, 6) AS lat, round(lon, 6) AS lon, round(value, 3) AS value, round(distance_m, 3) AS distance_m FROM (
        SELECT 'impossible_speed' AS kind, mmsi, t, lat, lon, sog AS value, 0::DOUBLE AS distance_m FROM fixes WHERE sog > 50
        UNION ALL SELECT kind, mmsi, jt, jlat, jlon, value, distance_m FROM seen WHERE kind IS NOT NULL
        UNION ALL SELECT 'gap', mmsi, t, lat, lon, value, distance_m FROM gaps WHERE judged = 'gap')"""

QUERIES = {
    "t5_tracked": t5_tracked, "t6_predictions": t6_predictions, "t8_tracks": t8_tracks, "t9_statistics": t9_statistics,
    "r5_track_encounters": r5_track_encounters, "a1_impossible_speeds": a1_impossible_speeds, "a2_reachable": a2_reachable,
    "k4_anomaly_json": k4_anomaly_json, "k5_encounter_json": k5_encounter_json, "n12_aircraft": n12_aircraft, "a3_flags": a3_flags, "a6_gap_candidates": a6_gap_candidates, "a7_judged_gaps": a7_judged_gaps,
    "a11_statistics": a11_statistics, "a12_implied_speeds": a12_implied_speeds, "e16_summary": e16_summary,
}
ORACLES = {
    "t5_tracked": f"{TRACKED_WITH} SELECT seq, mmsi, outcome, round(nis, 4) AS nis, round(lat, 6) AS lat, round(lon, 6) AS lon, round(sigma_m, 3) AS sigma_m, CAST(updates AS BIGINT) AS updates FROM placed",
    "t6_predictions": f"{TRACKED_WITH} SELECT seq, round(plat, 6) AS predicted_lat, round(plon, 6) AS predicted_lon, round(psigma, 3) AS predicted_sigma_m FROM placed",
    "t8_tracks": f"""{TRACKED_WITH}, last AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY k DESC) AS back FROM placed)
        SELECT mmsi, t, round(lat, 6) AS lat, round(lon, 6) AS lon, round(ve, 4) + 0 AS v_east, round(vn, 4) + 0 AS v_north, round(sigma_m, 3) AS sigma_m, CAST(updates AS BIGINT) AS updates FROM last WHERE back = 1""",
    "t9_statistics": f"""{TRACKED_WITH} SELECT 'fixes' AS counter, count(*) AS n FROM placed UNION ALL SELECT 'vessels', count(DISTINCT mmsi) FROM placed
        UNION ALL SELECT o, count(*) FILTER (WHERE outcome = o) FROM placed, (VALUES {", ".join(f"('{o}')" for o in tracker.OUTCOMES)}) w(o) GROUP BY o""",
    "r5_track_encounters": f"{TRACKED_WITH}, {TRACK_MOTIONS_SQL}, {RISKS_SQL}, {SESSIONS_SQL}",
    "a1_impossible_speeds": f"WITH {FIXES_SQL} SELECT 'impossible_speed' AS kind, mmsi, t, round(lat, 6) AS lat, round(lon, 6) AS lon, sog AS value, 0::DOUBLE AS distance_m FROM fixes WHERE sog > 50",
    "a2_reachable": f"""WITH {FIXES_SQL}, {_PREVIOUS} SELECT seq, {_STEP} <= CASE WHEN sog IS NOT NULL AND bsog IS NOT NULL THEN least(50, greatest(sog, bsog) + 15) ELSE 50 END * {geo.KNOT_MS} * abs(t - bt) + 500 AS reachable
        FROM b WHERE bt IS NOT NULL""",
    "a3_flags": _FLAGS_SQL,
    "k4_anomaly_json": _FLAGS_SQL,
    "k5_encounter_json": f"WITH {FIXES_SQL}, {MOTIONS_SQL}, {RISKS_SQL}, found AS ({SESSIONS_SQL.replace('marked AS', 'WITH marked AS', 1)}) SELECT minute AS t, mmsi_a, mmsi_b, type, role_a, role_b, range_m, tcpa_s, dcpa_m FROM found",
    "n12_aircraft": f"WITH {FIXES_SQL} SELECT seq, seq % 5 = 0 AS aircraft FROM fixes",
    "a11_statistics": f"""{SEEN_WITH}, n AS (SELECT 'fixes' AS counter, count(*) AS n FROM fixes UNION ALL SELECT 'aircraft', count(*) FROM fixes WHERE mmsi // 1000000 = 111
        UNION ALL SELECT 'vessels', count(DISTINCT mmsi) FROM heard UNION ALL SELECT 'impossible_speed', count(*) FROM fixes WHERE sog > 50 UNION ALL SELECT kind, count(*) FROM seen WHERE kind IS NOT NULL GROUP BY kind
        UNION ALL SELECT 'relocated', count(*) FROM seen WHERE relocated UNION ALL SELECT 'gap_not_regular', count(*) FROM c WHERE verdict = 'not_regular'
        UNION ALL SELECT CASE WHEN judged = 'gap' THEN 'gap' ELSE 'gap_' || judged END, count(*) FROM gaps GROUP BY 1)
      SELECT counter, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest([{", ".join(f"'{c}'" for c in anomalies.COUNTERS)}]) AS counter) LEFT JOIN n USING (counter)""",
    "a6_gap_candidates": f"WITH {FIXES_SQL}, {_CANDIDATES} SELECT mmsi, t, value, verdict FROM c",
    "a7_judged_gaps": f"WITH {FIXES_SQL}, {JUDGED_SQL} SELECT mmsi, t, value, down, others, judged FROM judged",
    "a12_implied_speeds": f"WITH {FIXES_SQL}, {_PREVIOUS}, s AS (SELECT *, {_STEP} AS d FROM b WHERE bt IS NOT NULL) SELECT seq, mmsi, round(d, 3) AS distance_m, round(d / greatest(abs(t - bt), 1) / {geo.KNOT_MS}, 3) AS implied_kn FROM s",
    "e16_summary": f"""WITH {FIXES_SQL}, {JUDGED_SQL}, flags AS (SELECT 'impossible_speed' AS kind, mmsi, t FROM fixes WHERE sog > 50 UNION ALL SELECT 'gap', mmsi, t FROM judged WHERE judged = 'gap')
        SELECT kind, count(*) AS flags, count(DISTINCT mmsi) AS vessels, min(t) AS first_t, max(t) AS last_t FROM flags GROUP BY kind""",
}
