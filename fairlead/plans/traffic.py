"""Queries of pair search and collision risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.operators import pairs, risk
from fairlead.sources.tables import FIXES_SQL, fixes

RADIUS_M = 6 * geo.NAUTICAL_MILE_M


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(*(F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns))


def rounded_up(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """As `rounded`, of values from 0 to 2^40 without decimal arithmetic, which is the most work of a short row."""
    return df.select(*((F.floor(F.col(c) * 10.0 ** digits[c] + 0.5) / 10.0 ** digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns))


def _pair_ids(df: DataFrame) -> DataFrame:
    return df.select(F.col("a.id").alias("mmsi_a"), F.col("b.id").alias("mmsi_b"))


def _pairs(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = pairs.snapshot_of_busiest(fixes(spark, sf_dir))
        return _pair_ids(pairs.within(points, RADIUS_M, method, "mmsi"))

    return query


def p1_ordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs.within(pairs.snapshot_of_busiest(fixes(spark, sf_dir)), RADIUS_M, "grid", "mmsi")
    return pairs.numbered(found).select("n", F.col("a.id").alias("mmsi_a"), F.col("b.id").alias("mmsi_b"))


def p7_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = pairs.snapshot_of_busiest(fixes(spark, sf_dir))
    each = [pairs.statistics(points, RADIUS_M, m, "mmsi") for m in ("grid", "latitude", "brute")]
    return each[0].unionByName(each[1]).unionByName(each[2])


def p8_busiest_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.busiest_minute(fixes(spark, sf_dir))


def p9_last_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.last_positions(fixes(spark, sf_dir)), {"lat": 6, "lon": 6})


def g_geodesy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance from each report to the view's centre, its offsets there, and its velocity's speed and course."""
    lat0, lon0 = F.lit(55.7), F.lit(12.6)
    ve, vn = geo.v_east(F.col("sog"), F.col("cog")), geo.v_north(F.col("sog"), F.col("cog"))
    found = fixes(spark, sf_dir).select(
        "seq",
        geo.haversine_m(F.col("lat"), F.col("lon"), lat0, lon0).alias("distance_m"),
        geo.east_m(lat0, lon0, F.col("lon")).alias("east_m"), geo.north_m(lat0, F.col("lat")).alias("north_m"),
        geo.speed_kn(ve, vn).alias("speed_kn"), F.when(F.col("sog") > 0, geo.course_deg(ve, vn)).alias("course_deg"),
    )
    return rounded(found, {"distance_m": 3, "east_m": 3, "north_m": 3, "speed_kn": 6, "course_deg": 4})


def r8_motions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.dead_reckoned(fixes(spark, sf_dir)), {"lat": 6, "lon": 6, "v_east": 5, "v_north": 5})


def r1_closest_approach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closest approaches of all pairs within range in every minute."""
    met = pairs.within(risk.dead_reckoned(fixes(spark, sf_dir)), RADIUS_M, "grid", "mmsi", ["minute"], ["v_east", "v_north"])
    found = met.withColumns(geo.closest_approach(geo.Vehicle.of("a"), geo.Vehicle.of("b")))
    found = found.select("minute", F.col("a.id").alias("mmsi_a"), F.col("b.id").alias("mmsi_b"), "range_m", "tcpa_s", "dcpa_m")
    return rounded(found, {"range_m": 3, "tcpa_s": 2, "dcpa_m": 2})


_ROUND = {"range_m": 3, "tcpa_s": 2, "dcpa_m": 2}


def r4_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.at_risk(risk.dead_reckoned(fixes(spark, sf_dir))), _ROUND)


def r6_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_up(risk.encountered(risk.dead_reckoned(fixes(spark, sf_dir))), _ROUND)


_SNAPSHOT = """busiest AS (SELECT minute, vessels FROM (SELECT CAST(floor(t / 60) AS BIGINT) AS minute, count(DISTINCT mmsi) AS vessels FROM fixes GROUP BY 1) ORDER BY vessels DESC, minute LIMIT 1),
points AS (SELECT mmsi, arg_max(lat, seq) AS lat, arg_max(lon, seq) AS lon FROM fixes, busiest WHERE CAST(floor(t / 60) AS BIGINT) = minute GROUP BY mmsi),
met AS (SELECT a.mmsi AS mmsi_a, b.mmsi AS mmsi_b FROM points a JOIN points b ON a.mmsi < b.mmsi WHERE {near})""".format(
    near=f"{geo.haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= {RADIUS_M}"
)
_PAIRS_SQL = f"WITH {FIXES_SQL}, {_SNAPSHOT} SELECT mmsi_a, mmsi_b FROM met"

#: motions(minute, mmsi, lat, lon, v_east, v_north), as risk.dead_reckoned makes them.
MOTIONS_SQL = f"""
reported AS (SELECT *, lead(t) OVER (PARTITION BY mmsi ORDER BY t, seq) AS next_t, (floor(t / 60) + 1) * 60 AS minute FROM fixes WHERE sog IS NOT NULL AND cog IS NOT NULL),
served AS (SELECT *, sog * {geo.KNOT_MS} * sin(radians(cog)) AS v_east, sog * {geo.KNOT_MS} * cos(radians(cog)) AS v_north FROM reported
           WHERE (next_t IS NULL OR next_t >= minute) AND minute - t <= 60 AND minute <= (SELECT floor(max(t) / 60) * 60 FROM fixes)),
motions AS (SELECT minute, mmsi, lat + v_north * (minute - t) / {geo.M_PER_DEG} AS lat, lon + v_east * (minute - t) / ({geo.M_PER_DEG} * cos(radians(lat))) AS lon, v_east, v_north FROM served)"""


def _relative_sql(a: str, b: str) -> str:
    true = f"degrees(atan2(({b}.lon - {a}.lon) * cos(radians({a}.lat)), {b}.lat - {a}.lat))"
    course = f"degrees(atan2({a}.v_east, {a}.v_north))"
    return f"(((({true} - {course}) % 360) + 360) % 360)"


def met_sql(source: str, moving: bool) -> str:
    """met(minute, mmsi_a, mmsi_b, range_m, tcpa_s, dcpa_m, ra, rb, between): pairs of `source` within range."""
    speed = f"WHERE sqrt(v_east * v_east + v_north * v_north) / {geo.KNOT_MS} >= 2" if moving else ""
    return f"""
way AS (SELECT * FROM {source} {speed}),
near AS (SELECT a.minute, a.mmsi AS mmsi_a, b.mmsi AS mmsi_b, (b.lon - a.lon) * {geo.M_PER_DEG} * cos(radians((a.lat + b.lat) / 2)) AS x, (b.lat - a.lat) * {geo.M_PER_DEG} AS y,
           b.v_east - a.v_east AS vx, b.v_north - a.v_north AS vy, {_relative_sql("a", "b")} AS ra, {_relative_sql("b", "a")} AS rb,
           abs(((((degrees(atan2(a.v_east, a.v_north)) - degrees(atan2(b.v_east, b.v_north)) + 180) % 360) + 360) % 360) - 180) AS between_courses
         FROM way a JOIN way b ON a.minute = b.minute AND a.mmsi < b.mmsi WHERE {geo.haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")} <= {RADIUS_M * 1.001 + 1 if moving else RADIUS_M}),
timed AS (SELECT *, sqrt(x * x + y * y) AS range_m, CASE WHEN vx * vx + vy * vy < 1e-9 THEN 0 ELSE -(x * vx + y * vy) / (vx * vx + vy * vy) END AS tcpa_s FROM near),
met AS (SELECT *, CASE WHEN tcpa_s <= 0 THEN range_m ELSE sqrt(pow(x + vx * tcpa_s, 2) + pow(y + vy * tcpa_s, 2)) END AS dcpa_m FROM timed)"""


RISKS_SQL = f"""{met_sql("motions", True)},
sided AS (SELECT *, ra > 112.5 AND ra < 247.5 AS sa, rb > 112.5 AND rb < 247.5 AS sb, ra > 0 AND ra <= 112.5 AS pa, rb > 0 AND rb <= 112.5 AS pb,
            between_courses >= 170 AND (ra <= 22.5 OR ra >= 337.5) AND (rb <= 22.5 OR rb >= 337.5) AS facing
          FROM met WHERE range_m <= {RADIUS_M} AND tcpa_s > 0 AND tcpa_s <= 1200 AND dcpa_m <= 926),
kinds AS (SELECT *, CASE WHEN sa <> sb THEN 'overtaking' WHEN sa AND sb THEN 'unclear' WHEN facing THEN 'head_on' WHEN pa <> pb THEN 'crossing' ELSE 'unclear' END AS type FROM sided),
risks AS (SELECT minute, mmsi_a, mmsi_b, type, range_m, tcpa_s, dcpa_m,
            CASE WHEN type = 'overtaking' AND sa OR type = 'crossing' AND NOT pa THEN 'stand_on' ELSE 'give_way' END AS role_a,
            CASE WHEN type = 'overtaking' AND sb OR type = 'crossing' AND NOT pb THEN 'stand_on' ELSE 'give_way' END AS role_b FROM kinds)"""
_METRES = "round(range_m, 3) AS range_m, round(tcpa_s, 2) AS tcpa_s, round(dcpa_m, 2) AS dcpa_m"

#: The encounters that risks make.
SESSIONS_SQL = """
marked AS (SELECT *, CASE WHEN minute - lag(minute) OVER w <= 90 THEN 0 ELSE 1 END AS new FROM risks WINDOW w AS (PARTITION BY mmsi_a, mmsi_b ORDER BY minute)),
sessions AS (SELECT *, sum(new) OVER (PARTITION BY mmsi_a, mmsi_b ORDER BY minute) AS n FROM marked)
SELECT min(minute) AS minute, max(minute) AS last_minute, count(*) AS minutes, mmsi_a, mmsi_b, arg_min(type, minute) AS type, arg_min(role_a, minute) AS role_a, arg_min(role_b, minute) AS role_b,
  round(arg_min(range_m, minute), 3) AS range_m, round(arg_min(tcpa_s, minute), 2) AS tcpa_s, round(arg_min(dcpa_m, minute), 2) AS dcpa_m
FROM sessions GROUP BY mmsi_a, mmsi_b, n"""

_SIDE = max(1.0, geo.chord_m(RADIUS_M))
QUERIES = {
    "p1_ordered_pairs": p1_ordered_pairs,
    "p2_pairs_brute": _pairs("brute"),
    "p3_pairs_latitude": _pairs("latitude"),
    "p4_pairs_grid": _pairs("grid"),
    "p5_pairs_tree": _pairs("tree"),
    "p7_statistics": p7_statistics,
    "p8_busiest_minute": p8_busiest_minute,
    "p9_last_positions": p9_last_positions,
    "g_geodesy": g_geodesy,
    "r8_motions": r8_motions,
    "r1_closest_approach": r1_closest_approach,
    "r4_at_risk": r4_at_risk,
    "r6_encounters": r6_encounters,
}
ORACLES = {
    "p1_ordered_pairs": f"WITH {FIXES_SQL}, {_SNAPSHOT} SELECT row_number() OVER (ORDER BY mmsi_a, mmsi_b) AS n, mmsi_a, mmsi_b FROM met",
    "p2_pairs_brute": _PAIRS_SQL,
    "p3_pairs_latitude": _PAIRS_SQL,
    "p4_pairs_grid": _PAIRS_SQL,
    "p5_pairs_tree": _PAIRS_SQL,
    "p7_statistics": f"""WITH {FIXES_SQL}, {_SNAPSHOT}, cells AS (SELECT mmsi, CAST(floor({geo.EARTH_RADIUS_M} * cos(radians(lat)) * cos(radians(lon)) / {_SIDE}) AS BIGINT) AS cx,
        CAST(floor({geo.EARTH_RADIUS_M} * cos(radians(lat)) * sin(radians(lon)) / {_SIDE}) AS BIGINT) AS cy, CAST(floor({geo.EARTH_RADIUS_M} * sin(radians(lat)) / {_SIDE}) AS BIGINT) AS cz FROM points),
        both_ AS (SELECT abs(a.cz - b.cz) <= 1 AS band, abs(a.cz - b.cz) <= 1 AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AS cube FROM cells a JOIN cells b ON a.mmsi < b.mmsi)
      SELECT method, CASE method WHEN 'brute' THEN (SELECT count(*) FROM both_) WHEN 'latitude' THEN (SELECT count(*) FROM both_ WHERE band) ELSE (SELECT count(*) FROM both_ WHERE cube) END AS checks, (SELECT count(*) FROM met) AS pairs
      FROM (VALUES ('grid'), ('latitude'), ('brute')) v(method)""",
    "p8_busiest_minute": f"WITH {FIXES_SQL}, {_SNAPSHOT} SELECT minute, vessels FROM busiest",
    "p9_last_positions": f"WITH {FIXES_SQL} SELECT mmsi, arg_max(t, seq) AS t, round(arg_max(lat, seq), 6) AS lat, round(arg_max(lon, seq), 6) AS lon FROM fixes GROUP BY mmsi",
    "g_geodesy": f"""WITH {FIXES_SQL}, v AS (SELECT *, sog * {geo.KNOT_MS} * sin(radians(cog)) AS ve, sog * {geo.KNOT_MS} * cos(radians(cog)) AS vn FROM fixes)
SELECT seq, round({geo.haversine_sql("lat", "lon", "55.7::DOUBLE", "12.6::DOUBLE")}, 3) AS distance_m, round((lon - 12.6::DOUBLE) * {geo.M_PER_DEG} * cos(radians(55.7::DOUBLE)), 3) AS east_m,
  round((lat - 55.7::DOUBLE) * {geo.M_PER_DEG}, 3) AS north_m, round(sqrt(ve * ve + vn * vn) / {geo.KNOT_MS}, 6) AS speed_kn,
  CASE WHEN sog > 0 THEN round((degrees(atan2(ve, vn)) + 360) % 360, 4) END AS course_deg FROM v""",
    "r8_motions": f"WITH {FIXES_SQL}, {MOTIONS_SQL} SELECT minute, mmsi, round(lat, 6) AS lat, round(lon, 6) AS lon, round(v_east, 5) + 0 AS v_east, round(v_north, 5) + 0 AS v_north FROM motions",
    "r1_closest_approach": f"WITH {FIXES_SQL}, {MOTIONS_SQL}, {met_sql('motions', False)} SELECT minute, mmsi_a, mmsi_b, {_METRES} FROM met",
    "r4_at_risk": f"WITH {FIXES_SQL}, {MOTIONS_SQL}, {RISKS_SQL} SELECT minute, mmsi_a, mmsi_b, type, role_a, role_b, {_METRES} FROM risks",
    "r6_encounters": f"WITH {FIXES_SQL}, {MOTIONS_SQL}, {RISKS_SQL}, {SESSIONS_SQL}",
}
