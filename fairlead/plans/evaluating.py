"""Queries of evaluation, workloads and the feed."""

from __future__ import annotations

import math
import re
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.functions.stages import durable
from fairlead.operators import anomalies, evaluate, feed, outcomes, pairs, risk, tracker, workloads
from fairlead.plans.traffic import FIXES_SQL, MOTIONS_SQL, RISKS_SQL, SESSIONS_SQL, rounded
from fairlead.plans.watching import JUDGED_SQL, SEEN_SQL, TRACK_MOTIONS_SQL, TRACKED_SQL
from fairlead.sources.tables import T0, fixes

HALF = T0 + 3240.0
#: Vessels of the view report every 98 s on average, so positions are interpolated over longer gaps than by default.
SPAN_S = 600.0


def _motions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(motions by tracks, until the last whole minute; the reports, kept; motions by dead reckoning)."""
    seen = durable(fixes(spark, sf_dir))
    accepted = tracker.track(seen).filter("outcome IN ('started', 'updated', 'restarted')")
    motions = risk.tracked(accepted).join(F.broadcast(risk.last_minute(seen)), F.col("minute") <= F.col("last_minute"))
    return motions.drop("last_minute"), seen, risk.dead_reckoned(seen)


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pairs at risk by their tracks, the truth), kept as they are read several times."""
    motions, seen, reported = _motions(spark, sf_dir)
    return durable(evaluate.at_risk_by_tracks(motions, reported)), durable(evaluate.truth(seen))


def e1_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.truth(fixes(spark, sf_dir)).select("seq", "mmsi", "t")


def e2_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vessel's position at each whole ten minutes."""
    seen = evaluate.truth(fixes(spark, sf_dir))
    asked = seen.select("mmsi").distinct().withColumn("at", F.explode(F.array(*(F.lit(float(T0 + 600 * k)) for k in range(11)))))
    return rounded(evaluate.interpolated(seen, asked, []), {"lat": 6, "lon": 6})


def _named(found: DataFrame, cases: DataFrame) -> DataFrame:
    return found.join(cases.select("case", F.col("t0").alias("minute"), "mmsi_a", "mmsi_b"), "case").drop("case")


def e3_actual_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    risks, seen = _cases(spark, sf_dir)
    cases = evaluate.cases_of(risks)
    found = _named(evaluate.actual_closest(cases, seen), cases)
    return rounded(found.select("minute", "mmsi_a", "mmsi_b", "closest_m", "covered"), {"closest_m": 3})


def e4_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    motions, seen, reported = _motions(spark, sf_dir)
    both = durable(motions.join(reported.select("minute", "mmsi"), ["minute", "mmsi"], "left_semi"))
    return rounded(outcomes.contributions(both, durable(evaluate.truth(seen)), SPAN_S), {"contribution_m": 2})


def e5_approach_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    motions, seen, reported = _motions(spark, sf_dir)
    found = outcomes.approach_errors(motions, reported, evaluate.truth(seen), SPAN_S)
    return rounded(found, {"distance_q50": 2, "distance_q90": 2, "time_q50": 2, "time_q90": 2})


def e6_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latitudes by the last digit of the vessel's number."""
    rows = fixes(spark, sf_dir).select((F.col("mmsi") % 10).alias("grp"), F.col("lat").alias("v"))
    return rounded(evaluate.quantiles(rows, ["grp"], "v", (0.0, 0.5, 0.9, 1.0)), {"q0": 6, "q50": 6, "q90": 6, "q100": 6})


def e7_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    risks, seen = _cases(spark, sf_dir)
    return rounded(evaluate.behaviour(risk.encounters(risks), seen, SPAN_S), {"contribution_q50": 2})


def e8_passed_astern(spark: SparkSession, sf_dir: str) -> DataFrame:
    risks, seen = _cases(spark, sf_dir)
    cases = evaluate.cases_of(risks)
    return _named(evaluate.passed_astern(cases, seen, SPAN_S), cases)


def e9_commercial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risks between commercial vessels, with types dealt by number."""
    names = F.array(*map(F.lit, ("Cargo", "Tanker", "Passenger", "HSC", "Fishing", "Sailing", "Tug")))
    types = fixes(spark, sf_dir).select("seq", "mmsi", F.get(names, (F.col("mmsi") % 7).cast("int")).alias("ship_type"))
    risks = risk.at_risk(risk.dead_reckoned(fixes(spark, sf_dir)))
    return evaluate.commercial(risks.select("minute", "mmsi_a", "mmsi_b"), types)


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = fixes(spark, sf_dir)
    return evaluate.next_position_errors(tracker.track(seen), seen)


def e10_hold_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.error_table(_errors(spark, sf_dir), "hold_m"), {"q50": 3, "q90": 3})


def e10_dead_reckoning_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.error_table(_errors(spark, sf_dir), "dead_reckoning_m"), {"q50": 3, "q90": 3})


def e10_track_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.error_table(_errors(spark, sf_dir), "track_m"), {"q50": 2, "q90": 2})


#: Accelerations, position and velocity uncertainties that e11 tries all combinations of.
SEARCHED = ((0.02, 0.1), (15.0, 30.0), (0.1,))


def e11_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.grid_search(fixes(spark, sf_dir), *SEARCHED)
    return rounded(found, {"score": 2, "dead_reckoning_score": 3})


def e13_gate_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate does with one per cent of outliers in noisy reports."""
    noisy = workloads.perturbed(fixes(spark, sf_dir), 5.0, 0.0, 0.01)
    return evaluate.gate_confusion(tracker.track(noisy.drop("outlier")), noisy.filter("outlier").select("seq"))


SEEDS = (1, 2)


def _planted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    seen = fixes(spark, sf_dir)
    rows, labels = workloads.planted(seen, list(SEEDS))
    # the seeds are vessels of their own: one recursion over all runs
    shift = lambda df: df.withColumn("mmsi", F.col("mmsi") + F.col("seed") * tracker.RUN).drop("seed")
    each = seen.withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS))))
    return shift(rows), shift(labels), anomalies.detect(shift(rows)), anomalies.detect(shift(each))


def e15_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, labels, flags, _ = _planted(spark, sf_dir)
    return evaluate.recall(labels, flags)


def e15_extra_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, labels, flags, baseline = _planted(spark, sf_dir)
    return evaluate.extra_flags(flags, baseline, labels).groupBy("kind").agg(F.count("*").alias("n"))


def e17_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view against itself with two kinds of damage."""
    seen = fixes(spark, sf_dir).select("seq", "mmsi", "t")
    other = seen.filter("seq % 100 <> 0").withColumn("t", F.when(F.col("seq") % 50 == 1, F.col("t") + 1).otherwise(F.col("t")))
    return evaluate.disagreements(seen, other, "seq", ["mmsi", "t"])


def p10_scaled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs among four turned copies of the last positions, and among crowded ones."""
    points = pairs.last_positions(fixes(spark, sf_dir)).select(F.col("mmsi").alias("id"), "lat", "lon")
    scaled = {"global": workloads.global_copies(points, 4), "dense": workloads.denser(points, 3)}
    found = [pairs.statistics(p, 6 * geo.NAUTICAL_MILE_M).select(F.lit(name).alias("workload"), "pairs") for name, p in scaled.items()]
    return found[0].unionByName(found[1])


def _reports(spark: SparkSession, sf_dir: str, until: float | None = None) -> DataFrame:
    """The last moving report of each vessel as its track, heard within half an hour."""
    seen = fixes(spark, sf_dir).filter("sog IS NOT NULL AND cog IS NOT NULL")
    if until is not None:
        seen = seen.filter(F.col("t") <= until)
    last = seen.groupBy("mmsi").agg(F.max_by(F.struct("t", "lat", "lon", "sog", "cog"), F.struct("t", "seq")).alias("p")).select("mmsi", "p.*")
    last = last.join(F.broadcast(seen.agg(F.max("t").alias("now")))).filter("now - t <= 1800").drop("now")
    return last.select("mmsi", "t", "lat", "lon", geo.v_east(F.col("sog"), F.col("cog")).alias("v_east"), geo.v_north(F.col("sog"), F.col("cog")).alias("v_north"))


def f1_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.changes(_reports(spark, sf_dir, HALF), _reports(spark, sf_dir))


def f2_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = anomalies.impossible_speeds(fixes(spark, sf_dir))
    risks = durable(risk.at_risk(risk.dead_reckoned(fixes(spark, sf_dir))))  # read for the last minute and for its rows
    now = risks.join(F.broadcast(risks.agg(F.max("minute").alias("minute"))), "minute", "left_semi")
    return feed.message("snapshot", HALF, _reports(spark, sf_dir), flags, now)


def f3_track_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vessel's track as sent."""
    return feed.track_rows(_reports(spark, sf_dir))


def f6_soonest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feed.soonest(risk.at_risk(risk.dead_reckoned(fixes(spark, sf_dir)))), {"range_m": 3, "tcpa_s": 2, "dcpa_m": 2})


_TRUTH = "truth AS (SELECT seq, mmsi, t, lat, lon, sog, cog FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, t ORDER BY seq) AS k FROM fixes) WHERE k = 1)"
_PAIR = "minute, mmsi_a, mmsi_b"


def _at_sql(name: str, asked: str, keep: str, span: float = 120) -> str:
    """CTE name(keep, mmsi, moment, lat, lon): the truth interpolated at asked(mmsi, moment, keep)."""
    return f"""{name}_b AS (SELECT a.*, b.t AS bt, b.lat AS blat, b.lon AS blon FROM {asked} a ASOF LEFT JOIN truth b ON a.mmsi = b.mmsi AND a.moment >= b.t),
{name}_c AS (SELECT a.*, c.t AS ct, c.lat AS clat, c.lon AS clon FROM {name}_b a ASOF LEFT JOIN truth c ON a.mmsi = c.mmsi AND a.moment < c.t),
{name} AS (SELECT {keep}, mmsi, moment, CASE WHEN bt = moment THEN blat WHEN ct - bt <= {span} THEN blat + (moment - bt) / (ct - bt) * (clat - blat) END AS lat,
  CASE WHEN bt = moment THEN blon WHEN ct - bt <= {span} THEN blon + (moment - bt) / (ct - bt) * (clon - blon) END AS lon FROM {name}_c)"""


def _cases_sql(source: str, where: str = "true", after: str = "least(2 * tcpa_s + 120, 1800)") -> str:
    return f"cases AS (SELECT {_PAIR}, type, role_a, role_b, tcpa_s, dcpa_m, minute AS t0, minute + {after} AS t1 FROM {source} WHERE {where})"


def _actual_sql(span: float) -> str:
    """CTEs up to actual(minute, mmsi_a, mmsi_b, covered, closest_m, closest_t), from cases and truth."""
    return f"""
times AS (SELECT {_PAIR}, t0 AS moment FROM cases UNION SELECT {_PAIR}, t1 FROM cases
          UNION SELECT c.minute, c.mmsi_a, c.mmsi_b, t.t FROM cases c JOIN truth t ON (t.mmsi = c.mmsi_a OR t.mmsi = c.mmsi_b) AND t.t >= c.t0 AND t.t <= c.t1),
asked_a AS (SELECT {_PAIR}, moment, mmsi_a AS mmsi FROM times), asked_b AS (SELECT {_PAIR}, moment, mmsi_b AS mmsi FROM times),
{_at_sql("at_a", "asked_a", _PAIR, span)}, {_at_sql("at_b", "asked_b", _PAIR, span)},
apart AS (SELECT {_PAIR}, moment, {geo.haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")} AS d FROM at_a a JOIN at_b b USING ({_PAIR}, moment)),
actual AS (SELECT {_PAIR}, bool_and(d IS NOT NULL) AS covered, CASE WHEN bool_and(d IS NOT NULL) THEN min(d) END AS closest_m,
             CASE WHEN bool_and(d IS NOT NULL) THEN arg_min(moment, struct_pack(d := d, m := moment)) END AS closest_t FROM apart GROUP BY ALL)"""


#: given(minute, mmsi_a, mmsi_b, mmsi, contribution_m), from cases, truth and actual.
_GIVEN = f"""
sides AS (SELECT {_PAIR}, t0, t1, mmsi_a AS mmsi, mmsi_b AS other FROM cases UNION ALL SELECT {_PAIR}, t0, t1, mmsi_b, mmsi_a FROM cases),
held AS (SELECT s.*, h.t AS ht, h.lat AS hlat, h.lon AS hlon, h.sog * {geo.KNOT_MS} * sin(radians(h.cog)) AS he, h.sog * {geo.KNOT_MS} * cos(radians(h.cog)) AS hn
         FROM sides s ASOF JOIN (SELECT * FROM truth WHERE sog IS NOT NULL AND cog IS NOT NULL) h ON h.mmsi = s.mmsi AND s.t0 >= h.t),
fresh AS (SELECT * FROM held WHERE t0 - ht <= 60),
moments AS (SELECT *, t0 AS moment FROM fresh UNION SELECT *, t1 FROM fresh UNION SELECT f.*, t.t FROM fresh f JOIN truth t ON t.mmsi = f.other AND t.t >= f.t0 AND t.t <= f.t1),
asked_h AS (SELECT {_PAIR}, mmsi AS self, hlat + hn * (moment - ht) / {geo.M_PER_DEG} AS own_lat, hlon + he * (moment - ht) / ({geo.M_PER_DEG} * cos(radians(hlat))) AS own_lon, other AS mmsi, moment FROM moments),
{_at_sql("others", "asked_h", f"{_PAIR}, self, own_lat, own_lon", SPAN_S)},
least_held AS (SELECT {_PAIR}, self, CASE WHEN bool_and(d IS NOT NULL) THEN min(d) END AS held_m FROM (SELECT *, {geo.haversine_sql("own_lat", "own_lon", "lat", "lon")} AS d FROM others) GROUP BY ALL),
given AS (SELECT l.minute, l.mmsi_a, l.mmsi_b, l.self AS mmsi, a.closest_m - l.held_m AS contribution_m FROM least_held l JOIN actual a ON a.minute = l.minute AND a.mmsi_a = l.mmsi_a AND a.mmsi_b = l.mmsi_b WHERE a.covered)"""

#: risks by tracks, of vessels with a fresh report too: dr_motions, kf_motions and motions, then as RISKS_SQL.
_RISKS_KF = f"""WITH RECURSIVE {FIXES_SQL}, {TRACKED_SQL}, {MOTIONS_SQL.replace("motions AS (", "dr_motions AS (")}, {TRACK_MOTIONS_SQL.replace("motions AS (", "kf_motions AS (")},
motions AS (SELECT * FROM kf_motions SEMI JOIN dr_motions USING (minute, mmsi)), {RISKS_SQL}, {_TRUTH}"""
_SESSION_CTES = SESSIONS_SQL[: SESSIONS_SQL.index("SELECT min(minute)")].rstrip()


def _quantile(value: str, q: float, digits: int) -> str:
    return f"round(list_sort(list({value}) FILTER (WHERE {value} IS NOT NULL))[1 + CAST(floor({q} * (count({value}) - 1)) AS INTEGER)], {digits})"


_STEPS = "CASE " + " ".join(f"WHEN dt >= {lo} AND dt < {hi} THEN {float(lo)}::DOUBLE" for lo, hi in zip(evaluate.STEPS_S, evaluate.STEPS_S[1:], strict=False)) + " END"
_ERRORS = f"""p AS (SELECT *, lag(t) OVER w AS bt, lag(lat) OVER w AS blat, lag(lon) OVER w AS blon, lag(sog) OVER w AS bsog, lag(cog) OVER w AS bcog FROM fixes WINDOW w AS (PARTITION BY mmsi ORDER BY t, seq)),
m AS (SELECT *, t - bt AS dt, coalesce(bsog >= 2, false) AS moving, CASE WHEN bsog IS NOT NULL AND bcog IS NOT NULL THEN blat + bsog * {geo.KNOT_MS} * cos(radians(bcog)) * (t - bt) / {geo.M_PER_DEG} ELSE blat END AS dlat,
        CASE WHEN bsog IS NOT NULL AND bcog IS NOT NULL THEN blon + bsog * {geo.KNOT_MS} * sin(radians(bcog)) * (t - bt) / ({geo.M_PER_DEG} * cos(radians(blat))) ELSE blon END AS dlon FROM p WHERE bt IS NOT NULL),
errors AS (SELECT {_STEPS} AS step, moving, {geo.haversine_sql("blat", "blon", "lat", "lon")} AS hold_m, {geo.haversine_sql("dlat", "dlon", "lat", "lon")} AS dead_reckoning_m FROM m)"""


def _table_sql(source: str, value: str, digits: int) -> str:
    """The error table of a relation (step, moving, value), with a row for all reports and one for those of moving vessels."""
    return f"""SELECT step, reports, count(*) AS n, {_quantile(value, 0.5, digits)} AS q50, {_quantile(value, 0.9, digits)} AS q90
      FROM (SELECT *, 'all' AS reports FROM {source} UNION ALL SELECT *, 'moving' FROM {source} WHERE moving) WHERE step IS NOT NULL AND {value} IS NOT NULL GROUP BY step, reports"""


def _error_sql(value: str) -> str:
    return f"WITH {FIXES_SQL}, {_ERRORS} {_table_sql('errors', value, 3)}"


def _renamed(sql: str, mark: str, values: dict[str, str]) -> str:
    """The tracker's recursion with other constants, under names of its own."""
    for name in ("numbered", "tracked", "placed"):
        sql = re.sub(rf"\b{name}\b", f"{name}_{mark}", sql)
    for old, new in values.items():
        sql = sql.replace(old, new)
    return sql


def _searched_sql() -> str:
    sets = list(product(*SEARCHED))
    runs = [_renamed(TRACKED_SQL, str(k), {"0.0025::DOUBLE": f"{a * a!r}::DOUBLE", "225.0::DOUBLE": f"{p * p!r}::DOUBLE"}) for k, (a, p, _) in enumerate(sets)]
    errors = " UNION ALL ".join(
        f"SELECT {k} AS run, {_STEPS} AS step, {geo.haversine_sql('k.plat', 'k.plon', 'm.lat', 'm.lon')} AS track_m, {geo.haversine_sql('m.dlat', 'm.dlon', 'm.lat', 'm.lon')} AS dr_m FROM m JOIN placed_{k} k ON k.seq = m.seq WHERE moving AND k.plat IS NOT NULL"
        for k in range(len(sets))
    )
    score = lambda value: f"SELECT run, avg(q) AS score FROM (SELECT run, step, list_sort(list({value}))[1 + CAST(floor(0.5 * (count(*) - 1)) AS INTEGER)] AS q, count(*) AS n FROM tried WHERE step IS NOT NULL GROUP BY run, step) WHERE n >= 30 GROUP BY run"
    names = ", ".join(f"({k}, {a}::DOUBLE, {p}::DOUBLE, {v}::DOUBLE)" for k, (a, p, v) in enumerate(sets))
    return f"""WITH RECURSIVE {FIXES_SQL}, {", ".join(runs)}, {_ERRORS}, tried AS ({errors}), by_track AS ({score("track_m")}), by_dr AS ({score("dr_m")})
      SELECT sigma_accel, pos_sigma_m, sigma_velocity, round(b.score, 2) AS score, round((SELECT score FROM by_dr WHERE run = 0), 3) AS dead_reckoning_score
      FROM (VALUES {names}) g(run, sigma_accel, pos_sigma_m, sigma_velocity) JOIN by_track b USING (run)"""


def _last_sql(name: str, where: str) -> str:
    return f"""{name}_r AS (SELECT * FROM fixes WHERE sog IS NOT NULL AND cog IS NOT NULL AND {where}),
{name} AS (SELECT mmsi, max(t) AS t FROM {name}_r GROUP BY mmsi HAVING (SELECT max(t) FROM {name}_r) - max(t) <= 1800)"""


_RISKS = f"WITH {FIXES_SQL}, {MOTIONS_SQL}, {RISKS_SQL}"
_EDGES = "CASE WHEN {0} >= 0 AND {0} < 120 THEN 0::DOUBLE WHEN {0} >= 120 AND {0} < 300 THEN 120 WHEN {0} >= 300 AND {0} < 600 THEN 300 WHEN {0} >= 600 AND {0} < 1200 THEN 600 END"


def _uniform_sql(seed: object, *ids: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {', '.join((str(seed), *ids))})), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def _normal_sql(seed: int, *ids: str) -> str:
    return f"(sqrt(-2 * ln(1 - {_uniform_sql(seed, *ids)})) * cos({2 * math.pi} * {_uniform_sql(seed + 1, *ids)}))"


#: fixes(...) with 5 m of noise and one per cent of outliers, and outlying(seq).
_NOISY = f"""clean AS (SELECT * FROM fixes_), marked AS (SELECT *, {_uniform_sql(142, "seq")} < 0.01 AS off, 500 + 1500 * {_uniform_sql(143, "seq")} AS far, {2 * math.pi} * {_uniform_sql(144, "seq")} AS way FROM clean),
shifted AS (SELECT *, {_normal_sql(42, "seq")} * 5 + CASE WHEN off THEN far * sin(way) ELSE 0 END AS east, {_normal_sql(52, "seq")} * 5 + CASE WHEN off THEN far * cos(way) ELSE 0 END AS north FROM marked),
fixes AS (SELECT seq, mmsi, t, lat + north / {geo.M_PER_DEG} AS lat, lon + east / ({geo.M_PER_DEG} * cos(radians(lat))) AS lon, sog, cog FROM shifted)"""
_PLAIN = FIXES_SQL.replace("fixes AS (", "fixes_ AS (", 1)


def _planted_sql(plant: bool) -> str:
    """fixes(...) of both seeds as vessels of their own, with or without what is planted, and labels."""
    u = lambda n: _uniform_sql("seed", "mmsi", str(n))
    return f"""{_PLAIN}, runs AS (SELECT unnest([{", ".join(map(str, SEEDS))}]) AS seed),
able AS (SELECT mmsi, min(t) AS first_t, max(t) AS last_t FROM fixes_ GROUP BY mmsi HAVING count(*) >= 60 AND max(t) - min(t) >= 2400),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY {_uniform_sql("seed", "mmsi")}, mmsi) - 1 AS place FROM able, runs),
chosen AS (SELECT seed, mmsi, (['impossible_speed', 'position_jump', 'gap', 'identity_conflict'])[1 + place % 4] AS kind, floor(first_t + (0.2::DOUBLE + 0.4::DOUBLE * {u(3)}) * (last_t - first_t)) AS moment FROM ranked WHERE place < 20),
labels AS (SELECT seed, kind, mmsi + seed * {tracker.RUN} AS mmsi, moment - 60 AS from_t, moment + CASE WHEN kind = 'gap' THEN 2700 ELSE 1200 END AS to_t FROM chosen),
spread AS (SELECT f.*, r.seed, c.kind, c.moment FROM fixes_ f CROSS JOIN runs r LEFT JOIN chosen c ON c.seed = r.seed AND c.mmsi = f.mmsi),
firsts AS (SELECT *, kind IS NOT NULL AND t >= moment AS after, row_number() OVER (PARTITION BY seed, mmsi, coalesce(t >= moment, false) ORDER BY t, seq) = 1 AND coalesce(t >= moment, false) AS hit FROM spread),
made AS (SELECT seq, seed, mmsi, t, lat + CASE WHEN hit AND kind = 'position_jump' THEN (5000 + 5000 * {u(1)}) ELSE 0 END / {geo.M_PER_DEG} AS lat, lon,
           CASE WHEN hit AND kind = 'impossible_speed' THEN 80 + 20 * {u(2)} ELSE sog END AS sog, cog FROM firsts WHERE NOT coalesce(kind = 'gap' AND t > moment AND t < moment + 900, false)
         UNION ALL SELECT seq + 5000000000, seed, mmsi, t + 30, lat + 20000 / {geo.M_PER_DEG}, lon, sog, cog FROM firsts WHERE kind = 'identity_conflict' AND after AND t < moment + 600),
fixes AS (SELECT seq, mmsi + seed * {tracker.RUN} AS mmsi, t, lat, lon, sog, cog FROM {"made" if plant else "spread"})"""


def _flags_sql(plant: bool) -> str:
    """A query of (kind, mmsi, t), all flags."""
    return f"""WITH RECURSIVE {_planted_sql(plant)}, {JUDGED_SQL}, {SEEN_SQL} SELECT 'impossible_speed' AS kind, mmsi, t FROM fixes WHERE sog > 50
      UNION ALL SELECT kind, mmsi, jt FROM seen WHERE kind IS NOT NULL UNION ALL SELECT 'gap', mmsi, t FROM gaps WHERE judged = 'gap'"""


def _copies_sql(copies: int) -> str:
    """The points and copies of them turned, as workloads.global_copies."""
    parts = ["SELECT mmsi AS id, lat, lon FROM points"]
    for k in range(1, copies):
        u, v, w, angle = workloads.axis_of(k)
        c, s = math.cos(angle), math.sin(angle)
        dot = f"(x * {u!r} + y * {v!r} + z * {w!r}) * {1 - c!r}"
        turned = (f"x * {c!r} + (z * {v!r} - y * {w!r}) * {s!r} + {dot} * {u!r}", f"y * {c!r} + (x * {w!r} - z * {u!r}) * {s!r} + {dot} * {v!r}", f"z * {c!r} + (y * {u!r} - x * {v!r}) * {s!r} + {dot} * {w!r}")
        parts.append(f"SELECT mmsi + {k * tracker.RUN}, degrees(asin(greatest(-1, least(1, ({turned[2]}) / {geo.EARTH_RADIUS_M})))), degrees(atan2({turned[1]}, {turned[0]})) FROM xyz")
    return " UNION ALL ".join(parts)


_POINTS = f"""points AS (SELECT mmsi, arg_max(lat, seq) AS lat, arg_max(lon, seq) AS lon FROM fixes GROUP BY mmsi),
xyz AS (SELECT mmsi, {geo.EARTH_RADIUS_M} * cos(radians(lat)) * cos(radians(lon)) AS x, {geo.EARTH_RADIUS_M} * cos(radians(lat)) * sin(radians(lon)) AS y, {geo.EARTH_RADIUS_M} * sin(radians(lat)) AS z FROM points)"""
_NEAR = f"count(*) AS pairs FROM {{0}} a JOIN {{0}} b ON a.id < b.id WHERE {geo.haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= {6 * geo.NAUTICAL_MILE_M}"
#: Half of the last digit rounds up, as decimals are written.
_FIVE = "CAST(round(CAST(CAST({0} AS VARCHAR) AS DECIMAL(20, 15)), 5) AS DECIMAL(20, 5))"
_TRACK_SQL = f"""printf('[%d,%s,%s,%.1f,%.0f,%.0f]', mmsi, CAST({_FIVE.format("lat")} AS VARCHAR), CAST({_FIVE.format("lon")} AS VARCHAR), sqrt(pow(sog * {geo.KNOT_MS} * sin(radians(cog)), 2) + pow(sog * {geo.KNOT_MS} * cos(radians(cog)), 2)) / {geo.KNOT_MS},
  ((degrees(atan2(sog * {geo.KNOT_MS} * sin(radians(cog)), sog * {geo.KNOT_MS} * cos(radians(cog)))) % 360) + 360) % 360, t)"""
_BEARING = f"""((((degrees(atan2((g.lon - h.lon) * cos(radians(h.lat)), g.lat - h.lat)) - degrees(atan2((h.lon - p.lon) * cos(radians(p.lat)), h.lat - p.lat))) % 360) + 360) % 360)"""
ORACLES = {
    "e1_truth": f"WITH {FIXES_SQL}, {_TRUTH} SELECT seq, mmsi, t FROM truth",
    "e2_interpolated": f"""WITH {FIXES_SQL}, {_TRUTH}, asked AS (SELECT mmsi, CAST({T0} + 600 * k AS DOUBLE) AS moment FROM (SELECT DISTINCT mmsi FROM truth), range(11) r(k)),
        {_at_sql("found", "asked", "1 AS one")} SELECT mmsi, moment AS "at", round(lat, 6) AS lat, round(lon, 6) AS lon FROM found""",
    "e3_actual_closest": f"{_RISKS_KF}, {_cases_sql('risks')}, {_actual_sql(120)} SELECT {_PAIR}, round(closest_m, 3) AS closest_m, covered FROM actual",
    "e4_contributions": f"{_RISKS_KF}, {_cases_sql('risks', after='(2 * tcpa_s + 120)')}, {_actual_sql(SPAN_S)}, {_GIVEN} SELECT {_PAIR}, mmsi, round(contribution_m, 2) AS contribution_m FROM given",
    "e5_approach_errors": f"""{_RISKS_KF}, {_cases_sql('risks')}, {_actual_sql(SPAN_S)},
        both_ AS (SELECT c.*, a.closest_m, a.closest_t - c.t0 AS after_s, (y.lon - x.lon) * {geo.M_PER_DEG} * cos(radians((x.lat + y.lat) / 2)) AS dx, (y.lat - x.lat) * {geo.M_PER_DEG} AS dy, y.v_east - x.v_east AS vx, y.v_north - x.v_north AS vy
                  FROM cases c JOIN actual a USING ({_PAIR}) JOIN dr_motions x ON x.minute = c.minute AND x.mmsi = c.mmsi_a JOIN dr_motions y ON y.minute = c.minute AND y.mmsi = c.mmsi_b WHERE a.covered),
        reckoned AS (SELECT *, CASE WHEN vx * vx + vy * vy < 1e-9 THEN 0 ELSE -(dx * vx + dy * vy) / (vx * vx + vy * vy) END AS rt FROM both_),
        said AS (SELECT 'track' AS predictor, {_EDGES.format("tcpa_s")} AS horizon, abs(dcpa_m - closest_m) AS distance, abs(tcpa_s - after_s) AS time FROM both_
                 UNION ALL SELECT 'dead_reckoning', {_EDGES.format("tcpa_s")}, abs(CASE WHEN rt <= 0 THEN sqrt(dx * dx + dy * dy) ELSE sqrt(pow(dx + vx * rt, 2) + pow(dy + vy * rt, 2)) END - closest_m), abs(greatest(rt, 0) - after_s) FROM reckoned)
        SELECT predictor, horizon, count(*) AS n, {_quantile("distance", 0.5, 2)} AS distance_q50, {_quantile("distance", 0.9, 2)} AS distance_q90, {_quantile("time", 0.5, 2)} AS time_q50, {_quantile("time", 0.9, 2)} AS time_q90
        FROM said WHERE horizon IS NOT NULL GROUP BY predictor, horizon""",
    "e7_behaviour": f"""{_RISKS_KF}, {_SESSION_CTES}, opened AS (SELECT min(minute) AS minute, mmsi_a, mmsi_b, arg_min(type, minute) AS type, arg_min(role_a, minute) AS role_a, arg_min(role_b, minute) AS role_b,
          arg_min(range_m, minute) AS range_m, arg_min(tcpa_s, minute) AS tcpa_s, arg_min(dcpa_m, minute) AS dcpa_m FROM sessions GROUP BY mmsi_a, mmsi_b, n),
        {_cases_sql('opened', f'range_m >= {evaluate.DEVELOPING_RANGE_M} AND tcpa_s >= {evaluate.DEVELOPING_TCPA_S}')}, {_actual_sql(SPAN_S)}, {_GIVEN},
        roles AS (SELECT c.type, CASE WHEN g.mmsi = c.mmsi_a THEN role_a ELSE role_b END AS role, contribution_m, contribution_m = max(contribution_m) OVER w AND count(*) OVER w = 2 AS first
                  FROM given g JOIN cases c USING ({_PAIR}) WHERE contribution_m IS NOT NULL WINDOW w AS (PARTITION BY g.minute, g.mmsi_a, g.mmsi_b))
        SELECT type, role, count(*) AS n, {_quantile("contribution_m", 0.5, 2)} AS contribution_q50, count(*) FILTER (WHERE contribution_m >= {evaluate.ACTED_M}) AS acted, count(*) FILTER (WHERE first) AS more FROM roles GROUP BY type, role""",
    "e8_passed_astern": f"""{_RISKS_KF}, {_cases_sql('risks')}, {_actual_sql(SPAN_S)}, met_ AS (SELECT {_PAIR}, closest_t, CASE WHEN role_a = 'give_way' THEN mmsi_a ELSE mmsi_b END AS giver, CASE WHEN role_a = 'give_way' THEN mmsi_b ELSE mmsi_a END AS holder
          FROM cases JOIN actual USING ({_PAIR}) WHERE covered AND type = 'crossing'),
        asked_g AS (SELECT {_PAIR}, giver AS mmsi, closest_t AS moment FROM met_), asked_o AS (SELECT {_PAIR}, holder AS mmsi, closest_t AS moment FROM met_), asked_p AS (SELECT {_PAIR}, holder AS mmsi, closest_t - 1 AS moment FROM met_),
        {_at_sql("at_g", "asked_g", _PAIR, SPAN_S)}, {_at_sql("at_o", "asked_o", _PAIR, SPAN_S)}, {_at_sql("at_p", "asked_p", _PAIR, SPAN_S)}
        SELECT {_PAIR}, {_BEARING} > 90 AND {_BEARING} < 270 AS astern FROM at_g g JOIN at_o h USING ({_PAIR}) JOIN at_p p USING ({_PAIR})""",
    "e6_quantiles": f"WITH {FIXES_SQL} SELECT mmsi % 10 AS grp, count(*) AS n, " + ", ".join(f"{_quantile('lat', q, 6)} AS q{round(100 * q)}" for q in (0.0, 0.5, 0.9, 1.0)) + " FROM fixes GROUP BY 1",
    "e9_commercial": f"{_RISKS} SELECT minute, mmsi_a, mmsi_b FROM risks WHERE mmsi_a % 7 < 4 AND mmsi_b % 7 < 4",
    "e10_hold_errors": _error_sql("hold_m"),
    "e10_dead_reckoning_errors": _error_sql("dead_reckoning_m"),
    "e10_track_errors": f"""WITH RECURSIVE {FIXES_SQL}, {TRACKED_SQL}, {_ERRORS}, both_ AS (SELECT {_STEPS} AS step, moving, {geo.haversine_sql("k.plat", "k.plon", "m.lat", "m.lon")} AS track_m FROM m JOIN placed k ON k.seq = m.seq)
        {_table_sql("both_", "track_m", 2)}""",
    "e11_grid_search": _searched_sql(),
    "e13_gate_confusion": f"""WITH RECURSIVE {_PLAIN}, {_NOISY}, {TRACKED_SQL} SELECT off AS outlier, count(*) AS n, count(*) FILTER (WHERE outcome IN ('rejected', 'restarted')) AS rejected
        FROM placed JOIN marked USING (seq) GROUP BY off""",
    "e15_recall": f"""WITH flags AS ({_flags_sql(True)}), labels AS (WITH {_planted_sql(True)} SELECT * FROM labels)
        SELECT kind, count(*) AS planted, count(*) FILTER (WHERE found) AS found FROM (SELECT l.kind, EXISTS (SELECT 1 FROM flags f WHERE f.kind = l.kind AND f.mmsi = l.mmsi AND f.t >= l.from_t AND f.t <= l.to_t) AS found FROM labels l) GROUP BY kind""",
    "e15_extra_flags": f"""WITH flags AS ({_flags_sql(True)}), baseline AS ({_flags_sql(False)}), labels AS (WITH {_planted_sql(True)} SELECT * FROM labels)
        SELECT kind, count(*) AS n FROM flags f WHERE NOT EXISTS (SELECT 1 FROM baseline b WHERE b.kind = f.kind AND b.mmsi = f.mmsi AND b.t = f.t)
          AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.mmsi = f.mmsi AND f.t >= l.from_t AND f.t <= l.to_t) GROUP BY kind""",
    "p10_scaled_pairs": f"""WITH {FIXES_SQL}, {_POINTS}, turned AS ({_copies_sql(4)}),
        crowd AS (SELECT mmsi + k * {tracker.RUN} AS id, lat + CASE WHEN k = 0 THEN 0 ELSE {_normal_sql(52, "mmsi", "k")} * 1000 END / {geo.M_PER_DEG} AS lat, lon + CASE WHEN k = 0 THEN 0 ELSE {_normal_sql(42, "mmsi", "k")} * 1000 END / ({geo.M_PER_DEG} * cos(radians(lat))) AS lon FROM points, range(3) r(k))
        SELECT 'global' AS workload, {_NEAR.format("turned")} UNION ALL SELECT 'dense', {_NEAR.format("crowd")}""",
    "e17_disagreements": f"WITH {FIXES_SQL} SELECT seq, CASE WHEN seq % 100 = 0 THEN 'ours' ELSE 'both' END AS side FROM fixes WHERE seq % 100 = 0 OR seq % 50 = 1",
    "f1_changes": f"""WITH {FIXES_SQL}, {_last_sql("a", f"t <= {HALF}")}, {_last_sql("b", "true")}
        SELECT coalesce(a.mmsi, b.mmsi) AS mmsi, CASE WHEN b.mmsi IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.mmsi = b.mmsi WHERE b.mmsi IS NULL OR a.mmsi IS NULL OR a.t <> b.t""",
    "f2_snapshot": f"""{_RISKS}, {_last_sql("a", "true")}, last_ AS (SELECT r.* FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t DESC, seq DESC) AS k FROM a_r) r JOIN a USING (mmsi) WHERE r.k = 1),
        newest AS (SELECT * FROM fixes WHERE sog > 50 ORDER BY t DESC, mmsi DESC LIMIT {feed.RECENT}), now_ AS (SELECT * FROM risks WHERE minute = (SELECT max(minute) FROM risks))
        SELECT printf('{{"type":"snapshot","t":%.0f,"totals":{{"tracks":%d}}', {HALF}, (SELECT count(*) FROM last_)) || ',"tracks":[' || (SELECT string_agg({_TRACK_SQL}, ',' ORDER BY mmsi) FROM last_)
          || '],"anomalies":[' || (SELECT string_agg(printf('{{"kind":"impossible_speed","mmsi":%d,"t":%.0f,"lat":%.5f,"lon":%.5f,"value":%.1f}}', mmsi, t, lat, lon, sog), ',' ORDER BY t, mmsi) FROM newest)
          || '],"encounters":[' || (SELECT string_agg(printf('{{"a":%d,"b":%d,"type":"%s","role_a":"%s","role_b":"%s","tcpa":%.0f,"dcpa":%.0f}}', mmsi_a, mmsi_b, type, role_a, role_b, tcpa_s, dcpa_m), ',' ORDER BY mmsi_a, mmsi_b) FROM now_) || ']}}' AS json""",
    "f3_track_rows": f"WITH {FIXES_SQL}, {_last_sql('a', 'true')} SELECT mmsi, {_TRACK_SQL} AS row FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t DESC, seq DESC) AS k FROM a_r) WHERE k = 1 AND mmsi IN (SELECT mmsi FROM a)",
    "f6_soonest": f"{_RISKS} SELECT minute, mmsi_a, mmsi_b, type, role_a, role_b, round(range_m, 3) AS range_m, round(tcpa_s, 2) AS tcpa_s, round(dcpa_m, 2) AS dcpa_m FROM risks ORDER BY risks.tcpa_s, mmsi_a, mmsi_b LIMIT 50",
}
QUERIES = {
    "e1_truth": e1_truth, "e2_interpolated": e2_interpolated, "e3_actual_closest": e3_actual_closest, "e4_contributions": e4_contributions,
    "e5_approach_errors": e5_approach_errors, "e6_quantiles": e6_quantiles, "e7_behaviour": e7_behaviour, "e8_passed_astern": e8_passed_astern,
    "e9_commercial": e9_commercial, "e10_hold_errors": e10_hold_errors, "e10_dead_reckoning_errors": e10_dead_reckoning_errors,
    "e10_track_errors": e10_track_errors, "e11_grid_search": e11_grid_search, "e13_gate_confusion": e13_gate_confusion,
    "e15_recall": e15_recall, "e15_extra_flags": e15_extra_flags, "e17_disagreements": e17_disagreements,
    "p10_scaled_pairs": p10_scaled_pairs, "f1_changes": f1_changes, "f2_snapshot": f2_snapshot, "f3_track_rows": f3_track_rows, "f6_soonest": f6_soonest,
}
