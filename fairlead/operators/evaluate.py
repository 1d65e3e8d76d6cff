"""Evaluation queries: recorded positions as the truth against predictions, risk and flags."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.functions.stages import durable, running
from fairlead.operators import risk, tracker

# Edges of horizons and time steps, and the ship types taken for commercial.
HORIZONS_S = (0, 120, 300, 600, 1200)
STEPS_S = (0.5, 10, 30, 60, 180, 600, 1800)
COMMERCIAL = ("Cargo", "Tanker", "Passenger", "HSC")
MAX_SPAN_S = 120.0
DEVELOPING_RANGE_M, DEVELOPING_TCPA_S = geo.NAUTICAL_MILE_M, 240.0
ACTED_M = 0.1 * geo.NAUTICAL_MILE_M


def quantiles(rows: DataFrame, by: list[str], value: str, qs: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """(by..., n, q50, q90, ...): element floor(q (n - 1)) of each group's sorted values, exactly.

    Equal values are counted, and ranks are running sums over ranges of the order of (by..., value), so a group, however
    large, is many tasks' work; groups then are one row each.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    ranked = running(counted, [*by, value], {"below": F.col("c")})
    groups = ranked.groupBy(*by).agg(F.sum("c").alias("n"), F.min("below").alias("first"))
    names = {c: f"{c}_of" for c in by}
    own = groups.withColumnsRenamed(names)
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(names[c])) for c in by))
    met = ranked.join(own, same)
    upto = F.col("below") + F.col("c") - F.col("first")
    at = lambda q: F.min(F.when(upto > F.floor(F.lit(q) * (F.col("n") - 1)), F.col(value)))
    return met.groupBy(*by).agg(F.max("n").alias("n"), *(at(q).alias(f"q{round(100 * q)}") for q in qs))


def quantiles_of_few(rows: DataFrame, by: list[str], value: str, qs: tuple[float, ...] = (0.5, 0.9), buckets: int = 4096) -> DataFrame:
    """As `quantiles`, for few groups (by, not null) of very many rows, which are read thrice and aren't shuffled: counts of
    equal steps between a group's least and greatest value tell in which step each wanted element lies, and only the
    values of these steps are ordered."""
    given = rows.filter(F.col(value).isNotNull())
    spans = durable(given.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("_low"), F.max(value).alias("_high")))
    share = F.when(F.col("_high") > F.col("_low"), (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    placed = given.join(F.broadcast(spans), by).select(*by, value, "n", F.floor(share * buckets).alias("_step"))
    steps = placed.groupBy(*by, "n", "_step").agg(F.count("*").alias("c"))
    before = Window.partitionBy(*by).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("_before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    rank = lambda q: F.floor(F.lit(q) * (F.col("n") - 1))
    wanted = durable(steps.filter(reduce(lambda x, y: x | y, ((F.col("_before") <= rank(q)) & (rank(q) < F.col("_before") + F.col("c")) for q in qs))))
    inside = placed.join(F.broadcast(wanted.select(*by, "_step")), [*by, "_step"]).groupBy(*by, "_step", value).agg(F.count("*").alias("c"))
    ranked = running(inside, [*by, "_step", value], {"below": F.col("c")})
    first = durable(ranked.groupBy(*by, "_step").agg(F.min("below").alias("first")))
    met = ranked.join(F.broadcast(first), [*by, "_step"]).join(F.broadcast(wanted.select(*by, "_step", "n", "_before")), [*by, "_step"])
    upto = F.col("_before") + F.col("below") + F.col("c") - F.col("first")
    at = lambda q: F.min(F.when(upto > rank(q), F.col(value)))
    return met.groupBy(*by).agg(F.max("n").alias("n"), *(at(q).alias(f"q{round(100 * q)}") for q in qs))


def truth(fixes: DataFrame) -> DataFrame:
    """The first report of every vessel and time."""
    first = Window.partitionBy("mmsi", "t").orderBy("seq")
    return fixes.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def interpolated(reports: DataFrame, asked: DataFrame, keep: list[str], max_span_s: float = MAX_SPAN_S) -> DataFrame:
    """Positions of vessels at asked times: `asked` has mmsi, at and the columns `keep`; adds lat and lon.

    The report at that very time, else the straight line between neighbours at most max_span_s apart, else null. One
    ordering per vessel over reports and questions; no range join.
    """
    here = F.struct(F.col("t"), F.col("lat"), F.col("lon")).alias("p")
    known = reports.select("mmsi", F.col("t").alias("at"), here, *(F.lit(None).alias(k) for k in keep), F.lit(0).alias("asked"))
    types = dict(asked.dtypes)
    known = known.select("mmsi", "at", "p", *(F.col(k).cast(types[k]).alias(k) for k in keep), "asked")
    nothing = F.lit(None).cast(known.schema["p"].dataType).alias("p")
    both = known.unionByName(asked.select("mmsi", "at", nothing, *keep, F.lit(1).alias("asked")))
    order = Window.partitionBy("mmsi").orderBy("at", "asked")
    before = F.last("p", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # the next report is the last one of the reverse order: a frame that grows is kept up, one that shrinks is read anew
    back = Window.partitionBy("mmsi").orderBy(F.desc("at"), F.desc("asked"))
    after = F.last("p", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    met = both.withColumns({"b": before, "a": after}).filter("asked = 1")
    share = (F.col("at") - F.col("b.t")) / (F.col("a.t") - F.col("b.t"))
    line = lambda c: F.col(f"b.{c}") + share * (F.col(f"a.{c}") - F.col(f"b.{c}"))
    value = lambda c: F.when(F.col("b.t") == F.col("at"), F.col(f"b.{c}")).when(F.col("a.t") - F.col("b.t") <= max_span_s, line(c))
    return met.select("mmsi", "at", *keep, value("lat").alias("lat"), value("lon").alias("lon"))


#: Vessels of a group (about), reports and cases that are looked at together.
GROUP, CASES = 4096, 8192


class Reports:
    """The reports of some vessels in order of (vessel, time), one for a time, and where these were at a time, as
    `interpolated`. Times are numbered, so a vessel and a time are one whole number, which is searched for."""

    def __init__(self, mmsi: np.ndarray, t: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> None:
        order = np.lexsort((t, mmsi))
        self.t, self.lat, self.lon = t[order], lat[order], lon[order]
        self.vessels, first = np.unique(mmsi[order], return_index=True)
        # one vessel more, which has no reports, stands for all that have none
        self.first, self.end = np.append(first, len(order)), np.append(first[1:], [len(order)] * (2 if len(first) else 1))
        self.times, self.rank = np.unique(self.t, return_inverse=True)
        self.keys = np.repeat(np.arange(len(self.first)), self.end - self.first) * (len(self.times) + 1) + self.rank

    def number(self, mmsi: np.ndarray) -> np.ndarray:
        """The place of each vessel; that of the one without reports, if it has none."""
        if not len(self.vessels):
            return np.zeros(len(mmsi), np.int64)
        at = np.minimum(np.searchsorted(self.vessels, mmsi), len(self.vessels) - 1)
        return np.where(self.vessels[at] == mmsi, at, len(self.vessels))

    def before(self, vessel: np.ndarray, passed: np.ndarray) -> np.ndarray:
        """The first index of each vessel's reports that isn't among the first `passed` times."""
        return np.searchsorted(self.keys, vessel * (len(self.times) + 1) + passed)

    def within(self, vessel: np.ndarray, t0: np.ndarray, t1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, index) of the reports at the times from t0 to t1."""
        low, high = (np.searchsorted(self.times, t, side) for t, side in ((t0, "left"), (t1, "right")))
        return _spread(self.before(vessel, low), self.before(vessel, high))

    def at(self, vessel: np.ndarray, t: np.ndarray, max_span_s: float, passed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions at the times, NaN where they aren't known; passed: how many of all times are not after t, if known."""
        if not len(self.t):
            return np.full((2, len(t)), np.nan)
        after = self.before(vessel, np.searchsorted(self.times, t, "right") if passed is None else passed)
        b, a = np.maximum(after - 1, 0), np.minimum(after, len(self.t) - 1)
        has, more = after > self.first[vessel], after < self.end[vessel]
        tb, ta = self.t[b], self.t[a]
        same = has & (tb == t)
        between = has & more & (ta - tb <= max_span_s)
        share = (t - tb) / np.where(between, ta - tb, 1.0)
        line = lambda v: np.where(same, v[b], np.where(between, v[b] + share * (v[a] - v[b]), np.nan))
        return line(self.lat), line(self.lon)


def _apart(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """geo.haversine_m of arrays."""
    half = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * np.arcsin(np.where(half > 1, 1.0, np.sqrt(np.minimum(half, 1.0))))


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, index) of all indices in ranges."""
    n = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) + np.repeat(low - (np.cumsum(n) - n), n)


def _least(d: np.ndarray, t: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of n owners, all of which have rows: the least distance, its first time, and whether all are known."""
    order = np.argsort(owner, kind="stable")
    d, t, count = d[order], t[order], np.bincount(owner, minlength=n)
    first = np.cumsum(count) - count
    least = np.minimum.reduceat(d, first)  # NaN if one is
    return least, np.minimum.reduceat(np.where(d == np.repeat(least, count), t, np.inf), first), ~np.isnan(least)


def closest_of(cases: dict[str, np.ndarray], seen: Reports, max_span_s: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """closest_m, closest_t and covered of cases (mmsi_a, mmsi_b, t0, t1): over both ends and every time in between at
    which either vessel reported."""
    n, t0, t1 = len(cases["t0"]), cases["t0"], cases["t1"]
    a, b = (seen.number(cases[c]) for c in ("mmsi_a", "mmsi_b"))
    owners, times = [np.arange(n), np.arange(n)], [t0, t1]
    places = [[np.concatenate(x) for x in zip(*(seen.at(v, t, max_span_s) for t in times), strict=True)] for v in (a, b)]
    for mine, other in ((0, 1), (1, 0)):
        owner, index = seen.within((a, b)[mine], t0, t1)
        owners.append(owner)
        times.append(seen.t[index])
        there = {mine: (seen.lat[index], seen.lon[index]), other: seen.at((a, b)[other][owner], seen.t[index], max_span_s, seen.rank[index] + 1)}
        places = [[np.concatenate((x, y)) for x, y in zip(places[k], there[k], strict=True)] for k in (0, 1)]
    return _least(_apart(*places[0], *places[1]), np.concatenate(times), np.concatenate(owners), n)


def held_of(cases: dict[str, np.ndarray], seen: Reports, max_span_s: float) -> tuple[np.ndarray, np.ndarray]:
    """held_m, and whether it is known, of cases (other, t0, t1, lat, lon, v_east, v_north, t): over both ends and every
    time in between at which the other vessel reported. A vessel that holds its course has no reports of its own."""
    n, t0, t1 = len(cases["t0"]), cases["t0"], cases["t1"]
    other = seen.number(cases["other"])
    owner, index = seen.within(other, t0, t1)
    ends = [np.concatenate(x) for x in zip(*(seen.at(other, t, max_span_s) for t in (t0, t1)), strict=True)]
    there = [np.concatenate((x, v[index])) for x, v in zip(ends, (seen.lat, seen.lon), strict=True)]
    owner, t = np.concatenate([np.arange(n), np.arange(n), owner]), np.concatenate([t0, t1, seen.t[index]])
    own = {k: v[owner] for k, v in cases.items() if k in ("lat", "lon", "v_east", "v_north", "t")}
    lat = own["lat"] + own["v_north"] * (t - own["t"]) / geo.M_PER_DEG
    lon = own["lon"] + own["v_east"] * (t - own["t"]) / (geo.M_PER_DEG * np.cos(np.radians(own["lat"])))
    lon = np.where(lon > 180, lon - 360, np.where(lon < -180, lon + 360, lon))
    least, _, known = _least(_apart(lat, lon, *there), t, owner, n)
    return least, known


def beside(cases: DataFrame, vessels: list[str], keep: dict[str, str], reports: DataFrame, work: Callable[[dict[str, np.ndarray], Reports], list], schema: str) -> DataFrame:
    """work(cases, reports) -> columns, for blocks of cases (columns `keep`, of longs and doubles without nulls) with the
    reports of the vessels that they name.

    Vessels fall into groups by hash, of about GROUP; a task gets all cases of one combination of groups and the reports
    of these groups, each once, so reports are sent as often as there are groups, and cases once. Groups are at most as
    many as make the reports' copies no more than the cases.
    """
    n_cases, n_reports, n_vessels = cases.count(), max(1, reports.count()), reports.select("mmsi").distinct().count()
    spark = cases.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if len(vessels) == 1:
        k = max(parts, -(-n_vessels // GROUP))
    else:
        k = max(1, min(-(-n_vessels // GROUP) + int((2 * parts) ** 0.5), 1 + n_cases // n_reports))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(k))
    names = [*keep, "t_", "lat_", "lon_"]
    pair = F.least(*(group(c) for c in vessels)) * k + F.greatest(*(group(c) for c in vessels)) if len(vessels) > 1 else group(vessels[0])
    nothing = {n: F.lit(None).cast(t) for n, t in keep.items()} | {n: F.lit(None).cast("double") for n in ("t_", "lat_", "lon_")}
    asked = cases.select(pair.alias("met"), F.lit(1).alias("kind"), *(F.col(c).cast(t).alias(c) if c in keep else nothing[c].alias(c) for c, t in [*keep.items(), *((n, "double") for n in names[-3:])]))
    mine = group("mmsi")
    if len(vessels) > 1:
        mets = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")), lambda o: F.least(o, mine) * k + F.greatest(o, mine))
    else:
        mets = F.array(mine)
    first = vessels[0]
    given = reports.select(F.explode(mets).alias("met"), F.lit(0).alias("kind"), *(
        F.col("mmsi").cast("long").alias(first) if c == first else F.col(c[:-1]).alias(c) if c in names[-3:] else nothing[c].alias(c) for c in names
    ))
    dealt = given.unionByName(asked).repartition("met").sortWithinPartitions("met", "kind")
    out = [part.strip().split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, seen = None, [], None
        for batch in batches:
            met = batch.column("met").to_numpy() * 2 + batch.column("kind").to_numpy()
            bounds = [0, *(np.flatnonzero(met[1:] != met[:-1]) + 1).tolist(), len(met)]
            for start, end in zip(bounds, bounds[1:], strict=False):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if met[start] // 2 != now:
                    now, held, seen = met[start] // 2, [], None
                if met[start] % 2 == 0:
                    held.append([part.column(c).to_numpy() for c in (first, *names[-3:])])
                    continue
                if seen is None:
                    empty = [np.zeros(0, np.int64), *np.zeros((3, 0))]
                    seen, held = Reports(*(np.concatenate(c) for c in zip(empty, *held, strict=True))), []
                for i in range(0, part.num_rows, CASES):
                    some = part.slice(i, CASES)
                    found = work({c: some.column(c).to_numpy() for c in keep}, seen)
                    yield pa.RecordBatch.from_arrays(found, out)

    return dealt.mapInArrow(run, schema)


def actual_closest(cases: DataFrame, reports: DataFrame, max_span_s: float = MAX_SPAN_S) -> DataFrame:
    """(case, closest_m, closest_t, covered) for cases (case, mmsi_a, mmsi_b, t0, t1).

    The least distance over both ends and every time in between at which either vessel reported; closest_m is null
    unless both positions are known at all of them. Cases are looked at beside the reports of their vessels.
    """

    def work(some: dict[str, np.ndarray], seen: Reports) -> list:
        least, at, covered = closest_of(some, seen, max_span_s)
        return [pa.array(some["case"]), pa.array(least, mask=~covered), pa.array(at, mask=~covered), pa.array(covered)]

    keep = {"case": "long", "mmsi_a": "long", "mmsi_b": "long", "t0": "double", "t1": "double"}
    return beside(cases, ["mmsi_a", "mmsi_b"], keep, reports, work, "case long, closest_m double, closest_t double, covered boolean")


def courses_at(asked: DataFrame, reports: DataFrame, fresh_s: float = 60.0) -> DataFrame:
    """(case, mmsi, at, lat, lon, v_east, v_north, t): the vessel's last report with speed and course at or before the time
    asked for (case, mmsi, at), if fresh."""
    known = reports.filter("sog IS NOT NULL AND cog IS NOT NULL")
    rows = known.select("mmsi", F.col("t").alias("at"), F.struct("t", "lat", "lon", "sog", "cog").alias("p"), F.lit(None).cast("long").alias("case"))
    both = rows.unionByName(asked.select("mmsi", "at", F.lit(None).cast(rows.schema["p"].dataType).alias("p"), F.col("case").cast("long").alias("case")))
    order = Window.partitionBy("mmsi").orderBy("at", F.col("case").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("b", F.last("p", ignorenulls=True).over(order)).filter("case IS NOT NULL AND at - b.t <= %s" % fresh_s)
    return met.select(
        "case", "mmsi", "at", "b.t", "b.lat", "b.lon", geo.v_east(F.col("b.sog"), F.col("b.cog")).alias("v_east"), geo.v_north(F.col("b.sog"), F.col("b.cog")).alias("v_north")
    )


def held_course(cases: DataFrame, reports: DataFrame, fresh_s: float = 60.0) -> DataFrame:
    """(case, mmsi, lat, lon, v_east, v_north, t): each side's last report with speed and course at or before t0, if fresh."""
    sides = cases.select("case", F.col("t0").alias("at"), F.explode(F.array("mmsi_a", "mmsi_b")).alias("mmsi"))
    return courses_at(sides, reports, fresh_s).drop("at")


def contributions(cases: DataFrame, reports: DataFrame, max_span_s: float = MAX_SPAN_S) -> DataFrame:
    """(case, mmsi, contribution_m): how much the vessel's own manoeuvre opened the closest approach: the actual least
    distance (`closest_of`) less the least distance had it held its course (`held_of`)."""
    actual = actual_closest(cases, reports, max_span_s).filter("covered")
    held = held_course(cases, reports)
    sides = cases.select("case", "mmsi_a", "mmsi_b", "t0", "t1").join(held, "case")
    sides = durable(sides.withColumn("other", F.when(F.col("mmsi") == F.col("mmsi_a"), F.col("mmsi_b")).otherwise(F.col("mmsi_a"))))

    def work(some: dict[str, np.ndarray], seen: Reports) -> list:
        least, known = held_of(some, seen, max_span_s)
        return [pa.array(some["case"]), pa.array(some["mmsi"]), pa.array(least, mask=~known)]

    keep = {"other": "long", "case": "long", "mmsi": "long"} | {c: "double" for c in ("t0", "t1", "lat", "lon", "v_east", "v_north", "t")}
    least = beside(sides, ["other"], keep, reports, work, "case long, mmsi long, held_m double")
    return least.join(actual, "case").select("case", "mmsi", (F.col("closest_m") - F.col("held_m")).alias("contribution_m"))


def horizon(tcpa: Column, edges: tuple[float, ...] = HORIZONS_S) -> Column:
    """The lower edge of the bin that a time falls into, null outside."""
    found = F.lit(None).cast("double")
    for low, high in zip(edges, edges[1:], strict=False):
        found = F.when((tcpa >= low) & (tcpa < high), float(low)).otherwise(found)
    return found


def cases_of(risks: DataFrame, max_tcpa_s: float = 1200.0) -> DataFrame:
    """Assessments at risk as cases to be checked against what happened: until well past the expected time."""
    end = F.col("minute") + F.least(2 * F.col("tcpa_s") + 120, F.lit(max_tcpa_s + 600))
    number = F.xxhash64("minute", "mmsi_a", "mmsi_b")
    return risks.select(number.alias("case"), "mmsi_a", "mmsi_b", F.col("minute").alias("t0"), end.alias("t1"), "tcpa_s", "dcpa_m", "range_m", "type", "role_a", "role_b")


def at_risk_by_tracks(tracks: DataFrame, reported: DataFrame) -> DataFrame:
    """Pairs at risk by their tracks, of the vessels that have both a track and a report in a minute (motions)."""
    return risk.at_risk(tracks.join(reported.select("minute", "mmsi"), ["minute", "mmsi"], "left_semi"))


def behaviour(encounters: DataFrame, reports: DataFrame, max_span_s: float = MAX_SPAN_S) -> DataFrame:
    """(type, role, n, contribution_q50, acted, more): what each role did in encounters that were still developing.

    acted counts contributions of ACTED_M or more; more counts encounters where this side contributed more.
    """
    developing = encounters.filter((F.col("range_m") >= DEVELOPING_RANGE_M) & (F.col("tcpa_s") >= DEVELOPING_TCPA_S))
    cases = durable(cases_of(developing))
    given = contributions(cases, reports, max_span_s).filter("contribution_m IS NOT NULL")
    rows = given.join(cases, "case").withColumn("role", F.when(F.col("mmsi") == F.col("mmsi_a"), F.col("role_a")).otherwise(F.col("role_b")))
    pair = Window.partitionBy("case")  # at most two rows
    more = (F.col("contribution_m") == F.max("contribution_m").over(pair)) & (F.count("*").over(pair) == 2)
    rows = durable(rows.select("type", "role", "contribution_m", more.alias("more")))
    counts = rows.groupBy("type", "role").agg(F.count_if(F.col("contribution_m") >= ACTED_M).alias("acted"), F.count_if("more").alias("more"))
    spread = quantiles(rows, ["type", "role"], "contribution_m", (0.5,)).withColumnRenamed("q50", "contribution_q50")
    return spread.join(counts, ["type", "role"])


def passed_astern(cases: DataFrame, reports: DataFrame, max_span_s: float = MAX_SPAN_S) -> DataFrame:
    """(case, astern): whether in a crossing the vessel that gives way was abaft the other's beam at the real closest
    approach, by the other's course between its positions a second apart; null where a position isn't known."""
    crossing = cases.filter("type = 'crossing'").withColumns(
        {"giver": F.when(F.col("role_a") == "give_way", F.col("mmsi_a")).otherwise(F.col("mmsi_b")), "holder": F.when(F.col("role_a") == "give_way", F.col("mmsi_b")).otherwise(F.col("mmsi_a"))}
    )
    names = [f"{w}_{c}" for w in ("g", "h", "h0") for c in ("lat", "lon")]

    def work(some: dict[str, np.ndarray], seen: Reports) -> list:
        _, at, covered = closest_of(some, seen, max_span_s)
        some, at = {c: v[covered] for c, v in some.items()}, at[covered]
        asked = ((some["giver"], at), (some["holder"], at), (some["holder"], at - 1))
        places = [x for mmsi, t in asked for x in seen.at(seen.number(mmsi), t, max_span_s)]
        return [pa.array(some["case"]), *(pa.array(x, mask=np.isnan(x)) for x in places)]

    keep = {"case": "long", "mmsi_a": "long", "mmsi_b": "long", "t0": "double", "t1": "double", "giver": "long", "holder": "long"}
    wide = beside(crossing, ["mmsi_a", "mmsi_b"], keep, reports, work, "case long, " + ", ".join(f"{n} double" for n in names))
    east = geo.east_m(F.col("h0_lat"), F.col("h0_lon"), F.col("h_lon"))
    north = geo.north_m(F.col("h0_lat"), F.col("h_lat"))
    holder = geo.Vehicle(F.col("h_lat"), F.col("h_lon"), east, north)
    giver = geo.Vehicle(F.col("g_lat"), F.col("g_lon"), F.lit(0.0), F.lit(0.0))
    bearing = geo.relative_bearing(holder, giver)
    return wide.select("case", ((bearing > 90) & (bearing < 270)).alias("astern"))


def commercial(rows: DataFrame, ship_types: DataFrame, keys: tuple[str, ...] = ("mmsi_a", "mmsi_b")) -> DataFrame:
    """The rows whose vessels' last known types are all commercial. ship_types: (seq, mmsi, ship_type)."""
    last = ship_types.filter("ship_type IS NOT NULL").groupBy("mmsi").agg(F.max_by("ship_type", "seq").alias("ship_type"))
    wanted = durable(last.filter(F.col("ship_type").isin(*COMMERCIAL)).select("mmsi"))  # its size is known then, so a short one is sent
    for key in keys:
        rows = rows.join(wanted.withColumnRenamed("mmsi", key), key, "left_semi")
    return rows


def time_step(dt: Column) -> Column:
    """The lower edge of the bin that a time step falls into, null outside."""
    return horizon(dt, STEPS_S)


def next_position_errors(tracked: DataFrame, fixes: DataFrame) -> DataFrame:
    """(seq, step, moving, hold_m, dead_reckoning_m, track_m): how far each predictor was from the next report.

    hold: the report before; dead reckoning: it moved on at its speed and course; track: what the track expected.
    """
    order = Window.partitionBy("mmsi").orderBy("t", "seq")
    names = ("t", "lat", "lon", "sog", "cog")
    rows = fixes.withColumn("b", F.lag(F.struct(*names)).over(order)).filter("b IS NOT NULL")
    b = {n: F.col(f"b.{n}") for n in names}
    known = b["sog"].isNotNull() & b["cog"].isNotNull()
    lat, lon = geo.moved(b["lat"], b["lon"], geo.v_east(b["sog"], b["cog"]), geo.v_north(b["sog"], b["cog"]), F.col("t") - b["t"])
    here = (F.col("lat"), F.col("lon"))
    errors = rows.select(
        "seq", time_step(F.col("t") - b["t"]).alias("step"), F.coalesce(b["sog"] >= 2, F.lit(False)).alias("moving"),
        geo.haversine_m(b["lat"], b["lon"], *here).alias("hold_m"),
        F.when(known, geo.haversine_m(lat, lon, *here)).otherwise(geo.haversine_m(b["lat"], b["lon"], *here)).alias("dead_reckoning_m"),
        F.col("lat").alias("_lat"), F.col("lon").alias("_lon"),
    ).filter("step IS NOT NULL")
    own = [c for c in ("run",) if c in tracked.columns]
    expected = tracked.filter("predicted_lat IS NOT NULL").select(F.col("seq"), *own, "predicted_lat", "predicted_lon")
    met = errors.join(expected, "seq", "left")
    return met.withColumn("track_m", geo.haversine_m(F.col("predicted_lat"), F.col("predicted_lon"), F.col("_lat"), F.col("_lon"))).drop("_lat", "_lon", "predicted_lat", "predicted_lon")


def error_table(errors: DataFrame, value: str) -> DataFrame:
    """(step, reports, n, q50, q90) of one predictor, of `all` reports and of those of `moving` vessels."""
    both = F.when(F.col("moving"), F.array(F.lit("all"), F.lit("moving"))).otherwise(F.array(F.lit("all")))
    return quantiles(errors.select("step", F.explode(both).alias("reports"), value), ["step", "reports"], value)


def score(table: DataFrame, by: list[str], least: int = 30) -> DataFrame:
    """(by..., score): the mean over well-filled steps of the moving vessels' median error."""
    return table.filter((F.col("n") >= least) & (F.col("reports") == "moving")).groupBy(*by).agg(F.avg("q50").alias("score"))


def grid_search(fixes: DataFrame, accelerations: tuple[float, ...], positions: tuple[float, ...], velocities: tuple[float, ...]) -> DataFrame:
    """(sigma_accel, pos_sigma_m, sigma_velocity, score, dead_reckoning_score) for the product of three lists of noise
    levels; dead reckoning has none, so its score is the same. One job for all: runs are keys."""
    sets = list(product(accelerations, positions, velocities))
    grid = [(tracker.Params(sigma_accel=a, sigma_velocity=v), p) for a, p, v in sets]
    errors = durable(next_position_errors(tracker.track_each(fixes, grid), fixes).filter("moving AND run IS NOT NULL"))
    moving = errors.select("run", "step", F.lit("moving").alias("reports"), "track_m", "dead_reckoning_m")
    found = score(quantiles(moving, ["run", "step", "reports"], "track_m", (0.5,)), ["run"])
    once = moving.filter("run = 0")
    other = score(quantiles(once, ["step", "reports"], "dead_reckoning_m", (0.5,)), ["reports"]).select(F.col("score").alias("dead_reckoning_score"))
    names = fixes.sparkSession.createDataFrame([(k, *map(float, s)) for k, s in enumerate(sets)], "run long, sigma_accel double, pos_sigma_m double, sigma_velocity double")
    return F.broadcast(names).join(found, "run").join(F.broadcast(other)).drop("run")


def gate_confusion(tracked: DataFrame, outliers: DataFrame) -> DataFrame:
    """(outlier, n, rejected): what the gate did with planted outliers (seq) and with genuine reports."""
    marked = tracked.join(outliers.select("seq").withColumn("outlier", F.lit(True)), "seq", "left")
    gone = F.col("outcome").isin("rejected", "restarted").cast("long")
    return marked.groupBy(F.coalesce("outlier", F.lit(False)).alias("outlier")).agg(F.count("*").alias("n"), F.sum(gone).alias("rejected"))


def matched(labels: DataFrame, flags: DataFrame, slack_s: float = 0.0) -> DataFrame:
    """Labels (kind, mmsi, from_t, to_t, ...) with `found`: a flag of the kind and vessel within the times."""
    met = labels.join(flags.select("kind", "mmsi", "t"), ["kind", "mmsi"], "left")
    hit = (F.col("t") >= F.col("from_t") - slack_s) & (F.col("t") <= F.col("to_t") + slack_s)
    return met.groupBy(*labels.columns).agg(F.coalesce(F.max(hit), F.lit(False)).alias("found"))


def recall(labels: DataFrame, flags: DataFrame) -> DataFrame:
    """(kind, planted, found)."""
    return matched(labels, flags).groupBy("kind").agg(F.count("*").alias("planted"), F.sum(F.col("found").cast("long")).alias("found"))


def extra_flags(flags: DataFrame, baseline: DataFrame, labels: DataFrame) -> DataFrame:
    """Flags that the recording alone doesn't raise and no label explains."""
    new = flags.join(baseline.select("kind", "mmsi", "t"), ["kind", "mmsi", "t"], "left_anti")
    explained = labels.select(F.col("mmsi").alias("_m"), "from_t", "to_t")
    return new.join(explained, (F.col("mmsi") == F.col("_m")) & (F.col("t") >= F.col("from_t")) & (F.col("t") <= F.col("to_t")), "left_anti")


def disagreements(ours: DataFrame, theirs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, side): rows that only one of two decoders has (`ours`, `theirs`) or that differ in a column (`both`)."""
    a, b = ours.select(key, F.struct(*columns).alias("a")), theirs.select(key, F.struct(*columns).alias("b"))
    side = F.when(F.col("b").isNull(), "ours").when(F.col("a").isNull(), "theirs").when(~F.col("a").eqNullSafe(F.col("b")), "both")
    return a.join(b, key, "full_outer").select(key, side.alias("side")).filter("side IS NOT NULL")
