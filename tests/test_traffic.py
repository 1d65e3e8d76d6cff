import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlead.functions import geo, stages
from fairlead.operators import anomalies, evaluate, feed, pairs, places, risk, tracker, workloads
from fairlead.sources.tables import fixes


def motion(n, e, course, speed, mmsi):
    """A vessel so many metres north and east of 55 N 12 E."""
    lat = 55 + n / geo.M_PER_DEG
    lon = 12 + e / (geo.M_PER_DEG * math.cos(math.radians(55)))
    v = speed * geo.KNOT_MS
    return (60.0, mmsi, lat, lon, v * math.sin(math.radians(course)), v * math.cos(math.radians(course)))


MOTIONS = "minute double, mmsi long, lat double, lon double, v_east double, v_north double"


@pytest.mark.parametrize(
    ("a", "b", "kind", "role_a", "role_b"),
    [
        ((0, 0, 0, 10), (3000, 0, 180, 10), "head_on", "give_way", "give_way"),
        ((0, 0, 0, 10), (2000, 2000, 270, 10), "crossing", "give_way", "stand_on"),
        ((0, 0, 0, 10), (2000, -2000, 90, 10), "crossing", "stand_on", "give_way"),
        ((0, 0, 0, 15), (1000, 0, 0, 5), "overtaking", "give_way", "stand_on"),
        ((1000, 0, 0, 5), (0, 0, 0, 15), "overtaking", "stand_on", "give_way"),
    ],
)
def test_roles(spark, a, b, kind, role_a, role_b):
    found = risk.at_risk(spark.createDataFrame([motion(*a, 1), motion(*b, 2)], MOTIONS)).collect()
    assert [(r.type, r.role_a, r.role_b) for r in found] == [(kind, role_a, role_b)]


@pytest.mark.parametrize("b", [(3000, 0, 0, 12), (3000, 0, 180, 1), (12_000, 0, 180, 10), (3000, 2500, 180, 10), (0, 0, 0, 10)])
def test_not_at_risk(spark, b):
    assert risk.at_risk(spark.createDataFrame([motion(0, 0, 0, 10, 1), motion(*b, 2)], MOTIONS)).count() == 0


def test_a_pair_across_the_date_line(spark):
    rows = [(60.0, 1, 0.0, 179.99, 5.0, 0.0), (60.0, 2, 0.0, -179.99, -5.0, 0.0)]
    df = spark.createDataFrame(rows, MOTIONS)
    assert [r.type for r in risk.at_risk(df).collect()] == ["head_on"]
    assert risk.at_risk(df, across_dateline=False).count() == 0


def test_roles_are_symmetric(spark):
    rng = random.Random(3)
    rows, other = [], []
    for k in range(300):
        pair = [motion(rng.uniform(-4000, 4000), rng.uniform(-4000, 4000), rng.uniform(0, 360), rng.uniform(2, 25), m) for m in (1, 2)]
        rows += [(float(k), *m[1:]) for m in pair]
        other += [(float(k), 3 - m[1], *m[2:]) for m in pair]
    one = {r.minute: (r.type, r.role_a, r.role_b) for r in risk.at_risk(spark.createDataFrame(rows, MOTIONS)).collect()}
    two = {r.minute: (r.type, r.role_b, r.role_a) for r in risk.at_risk(spark.createDataFrame(other, MOTIONS)).collect()}
    assert one == two and len(one) > 20


def crowd(n, minutes=2):
    """Motions in four places, one of them on the date line and one at the pole, some of them alike."""
    rng = np.random.default_rng(8)
    centres = [(55, 12), (0, 179.99), (89.95, 30), (-33, -70)]
    rows = []
    for k in range(n):
        (lat, lon), (north, east), velocity = centres[k % 4], rng.normal(0, 0.05, 2), rng.uniform(-12, 12, 2).round(k % 3)
        rows.append((60.0 * (k % minutes), k, float(np.clip(lat + north, -90, 90)), float((lon + east + 180) % 360 - 180), *map(float, velocity)))
    return [*rows, *((m, k + n, *rest) for m, k, *rest in rows[:20])]


def test_the_grid_finds_the_pairs_at_risk_of_all_pairs(spark):
    df = spark.createDataFrame(crowd(600), MOTIONS)
    found, expected = (sorted(map(tuple, risk.at_risk(df, method=m).collect())) for m in ("grid", "brute"))
    assert found == expected and len(found) > 200


def test_cells_that_are_dealt_lose_and_repeat_no_pair(spark):
    df = spark.createDataFrame(crowd(400), MOTIONS)
    one, many = (sorted(map(tuple, pairs.approaching(df, 11_112.0, 926.0, 1200.0, cell_rows=n).collect())) for n in (10_000, 7))
    assert one == many and len({(r[0], r[1], r[6]) for r in one}) == len(one) > 100
    assert len(one) < pairs.within(df, 11_112.0, "grid", "mmsi", ["minute"], ["v_east", "v_north"]).count() / 2  # few leave the comparison


def test_closest_approaches_beside_reports_are_those_of_a_plain_loop(spark, monkeypatch):
    """Also with many groups of vessels, small blocks of cases, vessels without reports and times between and beside them."""
    monkeypatch.setattr(evaluate, "GROUP", 2)
    monkeypatch.setattr(evaluate, "CASES", 3)
    rng = np.random.default_rng(4)
    seen = {m: sorted((float(t), 55 + float(a), 12 + float(b)) for t, a, b in zip(rng.integers(0, 900, 20), *rng.normal(0, 0.02, (2, 20)), strict=True)) for m in range(9)}
    seen = {m: list({r[0]: r for r in rows}.values()) for m, rows in seen.items()}
    cases = [(k, k % 9, k % 9 + 1 + k % 2, float(s), float(s + 60 * (k % 5))) for k, s in enumerate(rng.integers(50, 800, 120))]

    def at(m, t):
        rows = seen.get(m, [])
        b, a = max((r for r in rows if r[0] <= t), default=None), min((r for r in rows if r[0] > t), default=None)
        if b and b[0] == t:
            return b[1:]
        return tuple(b[i] + (t - b[0]) / (a[0] - b[0]) * (a[i] - b[i]) for i in (1, 2)) if b and a and a[0] - b[0] <= 120 else None

    expected = {}
    for k, a, b, t0, t1 in cases:
        times = {t0, t1, *(r[0] for m in (a, b) for r in seen.get(m, []) if t0 <= r[0] <= t1)}
        places = [(t, at(a, t), at(b, t)) for t in times]
        known = all(x and y for _, x, y in places)
        haversine = lambda x, y: 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(math.sin(math.radians(y[0] - x[0]) / 2) ** 2 + math.cos(math.radians(x[0])) * math.cos(math.radians(y[0])) * math.sin(math.radians(y[1] - x[1]) / 2) ** 2))
        expected[k] = (*min((haversine(x, y), t) for t, x, y in places), True) if known else (None, None, False)
    reports = spark.createDataFrame([(m, *r) for m, rows in seen.items() for r in rows], "mmsi long, t double, lat double, lon double")
    found = evaluate.actual_closest(spark.createDataFrame(cases, "case long, mmsi_a long, mmsi_b long, t0 double, t1 double"), reports).collect()
    assert len(found) == len(cases) and 5 < sum(r.covered for r in found) < 115
    for r in found:
        d, t, covered = expected[r.case]
        assert (r.covered, r.closest_t) == (covered, t) and (d is None) == (r.closest_m is None) and (d is None or abs(d - r.closest_m) < 1e-6)


def test_sessions(spark):
    rows = [(m * 60.0, 1, 2, "crossing", "give_way", "stand_on", 100.0 + m, 5.0, 1.0) for m in (1, 2, 3, 6, 8)]
    df = spark.createDataFrame(rows, "minute double, mmsi_a long, mmsi_b long, type string, role_a string, role_b string, range_m double, tcpa_s double, dcpa_m double")
    found = sorted((r.minute, r.last_minute, r.minutes, r.range_m) for r in risk.encounters(df).collect())
    assert found == [(60.0, 180.0, 3, 101.0), (360.0, 360.0, 1, 106.0), (480.0, 480.0, 1, 108.0)]


POINTS = "id long, lat double, lon double"


def ids(df):
    return sorted((r.a.id, r.b.id) for r in df.collect())


def test_all_methods_find_the_same_pairs(spark):
    rng = np.random.default_rng(5)
    centres = [(55, 12), (0, 179.95), (89.9, 30), (-33, -70)]
    rows = [(k, float(np.clip(c[0] + a, -90, 90)), float((c[1] + b + 180) % 360 - 180)) for k, (c, a, b) in enumerate((centres[i % 4], *rng.normal(0, 0.08, 2)) for i in range(240))]
    df = spark.createDataFrame(rows, POINTS)
    expected = ids(pairs.within(df, 11_112.0, "brute"))
    assert expected and all(ids(pairs.within(df, 11_112.0, m)) == expected for m in ("grid", "latitude", "tree"))
    distance = geo.haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    met = df.alias("a").join(df.alias("b"), F.col("a.id") < F.col("b.id")).filter(distance <= 11_112.0)
    assert expected == sorted((r[0], r[1]) for r in met.select("a.id", "b.id").collect())


@pytest.mark.parametrize("method", ["grid", "tree"])
def test_special_places(spark, method):
    at = lambda rows, radius: len(ids(pairs.within(spark.createDataFrame(rows, POINTS), radius, method)))
    assert at([(1, 0.0, 179.99), (2, 0.0, -179.99)], 5000.0) == 1
    assert at([(k, 89.99, 90.0 * k) for k in range(4)], 5000.0) == 6
    assert at([(k, 55.0, 12.0) for k in range(50)], 0.0) == 1225
    assert at([(1, 0.0, 0.0), (2, 0.0, 180.0), (3, 90.0, 0.0)], 2.1e7) == 3


FIXES = "seq long, mmsi long, t double, lat double, lon double, sog double, cog double, pos_sigma_m double"


def eastbound(n, step=10.0, start=0.0, lat=55.6, seq=0, sog=10.0):
    rate = sog * geo.KNOT_MS / (geo.M_PER_DEG * math.cos(math.radians(lat)))
    return [(seq + k, 1, start + step * k, lat, 12.0 + rate * (start + step * k), sog, 90.0, 10.0) for k in range(n)]


def outcomes(spark, rows):
    return [r.outcome for r in tracker.track(spark.createDataFrame(rows, FIXES)).orderBy("seq").collect()]


def test_a_track_follows_and_gates(spark):
    rows = eastbound(31)
    assert outcomes(spark, rows) == ["started"] + ["updated"] * 30
    off = lambda r: (*r[:3], r[3] + 0.05, *r[4:])
    assert outcomes(spark, [*rows[:20], off(rows[20]), rows[21]])[-2:] == ["rejected", "updated"]
    assert outcomes(spark, [*rows[:20], *map(off, rows[20:23])])[-3:] == ["rejected", "rejected", "restarted"]
    assert outcomes(spark, [*rows[:2], (90, *rows[1][1:2], 10.2, *rows[1][3:])])[-1] == "duplicate"


def test_tracks_move_their_frame_and_expire(spark):
    rows = tracker.track(spark.createDataFrame(eastbound(900), FIXES)).orderBy("seq").collect()
    assert abs(rows[-1].lon - eastbound(900)[-1][4]) < 1e-3 and rows[-1].outcome == "updated"
    late = [*eastbound(5), *eastbound(3, start=4000.0, seq=10)]
    assert outcomes(spark, late) == ["started", *["updated"] * 4, "started", "updated", "updated"]


def test_the_covariance_is_that_of_the_whole_filter():
    """Against the same model with a 4 x 4 covariance."""
    rng = np.random.default_rng(1)
    p = tracker.Params(gate=1e18)
    track = tracker.Track(p)
    x = cov = None
    t = 0.0
    for k in range(400):
        t += float(rng.uniform(2, 300))
        known = bool(rng.random() < 0.6)
        fix = {"t": t, "lat": 55 + rng.normal(0, 1e-3), "lon": 12 + rng.normal(0, 1e-3), "sog": 5.0 if known else None, "cog": float(rng.uniform(0, 360)) if known else None, "pos_sigma_m": 12.0}
        before = track.t
        track.add(fix)
        z = np.array(track.local(fix["lat"], fix["lon"]))
        v = tracker.velocity(fix)
        if x is None:
            x, cov = np.array([0, 0, *(v or (0, 0))], float), np.diag([144.0] * 2 + [(0.1 if known else 5.0) ** 2] * 2)
            continue
        dt = t - before
        f = np.eye(4)
        f[0, 2] = f[1, 3] = dt
        g = np.array([[dt * dt / 2, 0], [0, dt * dt / 2], [dt, 0], [0, dt]])
        x, cov = f @ x, f @ cov @ f.T + g @ g.T * p.sigma_accel**2
        h = np.eye(4) if known else np.eye(4)[:2]
        r = np.diag([144.0] * 2 + [0.01] * 2) if known else np.diag([144.0] * 2)
        m = np.array([*z, *v]) if known else z
        gain = cov @ h.T @ np.linalg.inv(h @ cov @ h.T + r)
        x, cov = x + gain @ (m - h @ x), (np.eye(4) - gain @ h) @ cov
        assert np.allclose([*track.pos, *track.vel], x, rtol=1e-6, atol=1e-6)
        assert np.allclose([track.p, track.c, track.v], [cov[0, 0], cov[0, 2], cov[2, 2]], rtol=1e-6)


T0 = 1.7e9


def steaming(n, every=30.0, kn=12.0, mmsi=1, seq=0, north_m=0.0, start=0.0):
    v = kn * geo.KNOT_MS
    return [(seq + k, mmsi, T0 + start + every * k, 55 + (north_m + v * (start + every * k)) / geo.M_PER_DEG, 12.0, kn, 0.0, 15.0) for k in range(n)]


def moored(minutes, vessels=20, skip=()):
    return [(100_000 + 100 * m + v, 1000 + v, T0 + 60.0 * m + v % 5, 55.0 + v * 0.01, 12.8, 0.0, 0.0, 15.0) for m in range(minutes) for v in range(vessels) if m not in skip]


def flags(spark, rows):
    found = anomalies.detect(spark.createDataFrame(rows, FIXES)).collect()
    return sorted((r.kind, r.mmsi, round(r.t - T0), round(r.value)) for r in found)


def test_speeds_and_jumps(spark):
    rows = steaming(60)
    assert flags(spark, rows) == []
    fast = [(*rows[30][:5], 64.0, *rows[30][6:])]
    assert flags(spark, rows[:30] + fast + rows[31:]) == [("impossible_speed", 1, 900, 64)]
    far = [(*rows[30][:3], rows[30][3] + 5000 / geo.M_PER_DEG, *rows[30][4:])]
    assert [f[:3] for f in flags(spark, rows[:30] + far + rows[31:])] == [("position_jump", 1, 900)]
    assert [f[:3] for f in flags(spark, rows[:30] + far * 3 + rows[31:])] == [("position_jump", 1, 900)]
    aircraft = [(r[0], 111_000_001, *r[2:5], 120.0, *r[6:]) for r in rows]
    assert flags(spark, aircraft) == []


def test_two_transmitters(spark):
    other = [(5000 + r[0], *r[1:2], r[2] + 10, r[3] + 20_000 / geo.M_PER_DEG, *r[4:]) for r in steaming(60)[20:40]]
    found = flags(spark, steaming(60) + other)
    assert [f[0] for f in found] == ["identity_conflict", "position_jump"] and abs(found[0][3] - 20_000) < 200


def test_silences(spark):
    quiet = [*steaming(40), *steaming(20, seq=200, start=40 * 30.0 + 880)]
    assert flags(spark, moored(60) + quiet) == [("gap", 1, 2080, 910)]
    outage = range(21, 29)
    assert flags(spark, moored(60, skip=outage) + [*steaming(40), *steaming(20, seq=200, start=40 * 30.0 + 700)]) == []
    slow = [(*r[:5], 0.5, *r[6:]) for r in quiet]
    assert flags(spark, moored(60) + slow) == []
    five = [(r[0] + 1000 * m, m, *r[2:4], 12.0 + m, *r[5:]) for m in range(1, 6) for r in quiet]
    assert flags(spark, moored(60) + five) == []
    counters = {r.counter: r.n for r in anomalies.statistics(spark.createDataFrame(moored(60) + five, FIXES)).collect()}
    assert counters["gap_coverage_returned"] == 5


def test_windows_and_recursion_see_the_same_silences(spark):
    rng = random.Random(4)
    rows, seq = [], 0
    for m in range(1, 40):
        t = 0.0
        while t < 9000:
            t += rng.choice((30, 30, 30, 60, 700, 1200))
            rows.append((seq, m, T0 + t, 55.0, 12.0 + m, rng.choice((None, 0.0, 8.0, 8.0)), 0.0, 15.0))
            seq += 1
    df = spark.createDataFrame(rows, FIXES)
    native = sorted((r.mmsi, r.t) for r in anomalies.gap_candidates(df).filter("verdict = 'candidate'").collect())
    assert native and native == sorted((r.mmsi, r.t) for r in anomalies.per_vessel(df).filter("kind = 'gap_candidate'").collect())


def test_runs_of_reports_may_be_cut_anywhere():
    """Going on to the next break of a run gives what taking reports one by one gives."""
    rng, kinds = random.Random(7), set()
    for case in range(400):
        p, t, rows = anomalies.Params(forget_s=rng.choice((10_800.0, 1200.0)), listening_since=rng.choice((float("-inf"), T0 + 900))), T0, []
        for _ in range(rng.randrange(2, 80)):
            t += rng.choice((0, 5, 10, 10, 30, 30, 60, 200, 700, 1500))
            base = rng.choice(((55.0, 12.0),) * 5 + ((55.1, 12.0), (55.0, 12.3)))
            late = rng.choice((0,) * 9 + (40,))
            rows.append((t - late, base[0] + rng.gauss(0, 1e-3), base[1] + rng.gauss(0, 1e-3), rng.choice((math.nan, 0.0, 3.0, 14.0))))
        columns = [np.array(c) for c in zip(*rows, strict=True)]
        once, each = places.Sightings(p), places.Sightings(p)
        whole = once.feed(1, *columns)
        single = [x for k in range(len(rows)) for x in each.feed(1, *(c[k : k + 1] for c in columns))]
        assert [w[:3] for w in whole] == [x[:3] for x in single], case
        assert not whole or np.allclose([w[3:7] for w in whole], [x[3:7] for x in single])
        kinds |= {w[0] for w in whole}
    assert kinds == {"vessel", "expired", "position_jump", "identity_conflict", "relocated", "gap_candidate", "gap_not_regular", "gap_before_listening"}


def test_long_histories_are_interpolated_in_linear_time(spark):
    reports = spark.range(60_000).selectExpr("1L AS mmsi", "cast(id * 10 AS double) AS t", "55.0 + id * 1e-6 AS lat", "12.0D AS lon", "id AS seq")
    asked = spark.range(60_000).selectExpr("1L AS mmsi", "cast(id * 10 + 5 AS double) AS at")
    began = time.perf_counter()
    found = evaluate.interpolated(reports, asked, []).agg(F.count("lat"), F.sum("lat")).first()
    assert found[0] == 59_999 and time.perf_counter() - began < 60


def test_running_sums(spark):
    rows = [(k * 7919 % 1000, k % 5) for k in range(1000)]
    df = spark.createDataFrame(rows, "v long, w long").repartition(6)
    found = stages.running(df, ["v"], {"place": F.lit(1).cast("long"), "below": F.col("w")}).collect()
    order = sorted(rows)
    assert {(r.v, r.place, r.below) for r in found} == {(v, k, sum(w for _, w in order[:k])) for k, (v, _) in enumerate(order)}
    assert stages.running(df.filter("false"), ["v"], {"place": F.lit(1)}).count() == 0


def test_kept_tables_are_deleted(spark):
    kept, other = stages.durable(spark.range(5)), stages.durable(spark.range(7))
    assert kept.count() == 5
    stages.discard(kept)
    assert other.count() == 7 and stages.forget(spark) >= 1 and stages.forget(spark) == 0


def test_exact_quantiles(spark):
    rng = random.Random(1)
    rows = [(k % 3, float(rng.randrange(20))) for k in range(101)] + [(9, 1.0), (9, 2.0)]
    df = spark.createDataFrame(rows, "g long, v double")
    found = {r.g: (r.n, r.q50, r.q90) for r in evaluate.quantiles(df, ["g"], "v").collect()}
    for g in (0, 1, 2, 9):
        v = sorted(x for k, x in rows if k == g)
        assert found[g] == (len(v), v[int(0.5 * (len(v) - 1))], v[int(0.9 * (len(v) - 1))])


def test_interpolation_gives_null_without_neighbours(spark):
    reports = spark.createDataFrame([(1, 0.0, 10.0, 0.0), (1, 100.0, 11.0, 1.0), (1, 400.0, 12.0, 2.0)], "mmsi long, t double, lat double, lon double")
    asked = spark.createDataFrame([(1, a) for a in (-5.0, 0.0, 50.0, 250.0, 500.0)], "mmsi long, at double")
    assert [(r.at, r.lat) for r in evaluate.interpolated(reports, asked, []).orderBy("at").collect()] == [(-5.0, None), (0.0, 10.0), (50.0, 10.5), (250.0, None), (500.0, None)]
    none = spark.range(1).select(geo.haversine_m(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("d")).first().d
    assert none is None


def test_planted_anomalies_are_found(spark):
    rows = [r for m in range(1, 41) for r in steaming(120, mmsi=m, seq=10_000 * m, north_m=3000.0 * m)]
    rows += [(5_000_000 + k, *r[1:]) for k, r in enumerate(moored(59))]
    planted, labels = workloads.planted(spark.createDataFrame(rows, FIXES), [1], 5)
    found = evaluate.recall(labels.drop("seed"), anomalies.detect(planted.drop("seed"))).collect()
    assert {r.kind: r.found for r in found} == {k: 5 for k in workloads.KINDS}


def test_the_gate_rejects_outliers(spark):
    rows = [r for m in range(1, 21) for r in [(x[0] + 1000 * m, m, *x[2:]) for x in eastbound(200)]]
    noisy = workloads.perturbed(spark.createDataFrame(rows, FIXES), 5.0, 0.0, 0.02)
    found = {r.outlier: (r.n, r.rejected) for r in evaluate.gate_confusion(tracker.track(noisy.drop("outlier")), noisy.filter("outlier")).collect()}
    assert found[True][1] >= 0.8 * found[True][0] and found[False][1] <= 0.05 * found[False][0]


def test_feed(spark):
    before = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 10.0)], "mmsi long, t double")
    now = spark.createDataFrame([(1, 10.0), (2, 20.0), (4, 20.0)], "mmsi long, t double")
    assert {(r.mmsi, r.change) for r in feed.changes(before, now).collect()} == {(2, "changed"), (3, "removed"), (4, "changed")}
    row = spark.createDataFrame([(5, 100.4, 55.123456, 12.0, 0.0, 5.144444)], "mmsi long, t double, lat double, lon double, v_east double, v_north double")
    assert feed.track_rows(row).first().row == "[5,55.12346,12.00000,10.0,0,100]"


def test_encounters_go_on_over_batches_and_are_sorted_once(spark):
    """Rows of any number in a batch; one exchange and one sort, where a window and an aggregation sorted twice."""
    minutes = {(1, 2): (60, 120, 180, 300, 360, 600), (1, 3): (60,), (2, 1): (60, 180), (5, 9): tuple(range(60, 1260, 60))}
    rows = [(float(m), a, b, a * 1000.0 + m) for (a, b), of in minutes.items() for m in of]
    df = spark.createDataFrame(rows[::-1], "minute double, mmsi_a long, mmsi_b long, range_m double").repartition(3)
    wanted = sorted(
        [(60.0, 180.0, 3, 1, 2, 1060.0), (300.0, 360.0, 2, 1, 2, 1300.0), (600.0, 600.0, 1, 1, 2, 1600.0), (60.0, 60.0, 1, 1, 3, 1060.0)]
        + [(60.0, 60.0, 1, 2, 1, 2060.0), (180.0, 180.0, 1, 2, 1, 2180.0), (60.0, 1200.0, 20, 5, 9, 5060.0)]
    )
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for size in ("1", "3", "10000"):
            spark.conf.set(name, size)
            assert sorted(tuple(r) for r in risk.encounters(df).collect()) == wanted
    finally:
        spark.conf.set(name, before)
    plan = risk.encounters(df)._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and plan.count("Sort [") == 1


def test_encounters_by_numbers_of_meetings_are_those_of_named_risks(spark):
    seen = fixes(spark, "/root/testdata/sf0.001")
    taken = tracker.track(seen).filter(F.col("outcome").isin(*tracker.ACCEPTED)).select("seq", "mmsi", "t", "lat", "lon", "v_east", "v_north")
    accepted = tracker.accepted(seen)
    assert sorted(map(tuple, accepted.collect())) == sorted(map(tuple, taken.collect()))
    motions = risk.tracked(accepted)
    named, numbered = risk.encounters(risk.at_risk(motions)), risk.encountered(motions)
    assert named.columns == numbered.columns and sorted(map(tuple, named.collect())) == sorted(map(tuple, numbered.collect()))
