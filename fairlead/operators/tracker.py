"""A gated constant-velocity track for every vessel.

North and east share one 2 x 2 covariance (position p, cross c, velocity v), because the model, the noise and both
kinds of measurement treat them alike. A fix is predicted, gated on its normalised innovation, and either rejected or
merged; the third rejection in a row starts the track anew at the fix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.operators.folds import fold

#: Vessels of several runs are told apart by multiples of this number.
RUN = 10_000_000_000
OUTCOMES = ("started", "updated", "duplicate", "out_of_order", "rejected", "restarted")
#: Outcomes of a fix that a track takes.
ACCEPTED = ("started", "updated", "restarted")


@dataclass(frozen=True)
class Params:
    """Noise, gate and times."""

    sigma_accel: float = 0.05
    sigma_velocity: float = 0.1
    sigma_velocity_unknown: float = 5.0
    gate: float = 18.42
    max_rejects: int = 3
    min_dt_s: float = 0.5
    reanchor_m: float = 20_000.0
    stale_s: float = 1800.0
    sweep_s: float = 60.0


@dataclass
class Track:
    """State of one vessel: a local frame, east and north position and velocity, the shared covariance."""

    params: Params = field(default_factory=Params)
    live: bool = False
    lat0: float = 0.0
    lon0: float = 0.0
    pos: list[float] = field(default_factory=lambda: [0.0, 0.0])
    vel: list[float] = field(default_factory=lambda: [0.0, 0.0])
    p: float = 0.0
    c: float = 0.0
    v: float = 0.0
    t: float = 0.0
    rejects: int = 0
    updates: int = 0

    def start(self, fix: dict) -> None:
        self.live, self.lat0, self.lon0, self.t = True, fix["lat"], fix["lon"], fix["t"]
        self.pos, vel = [0.0, 0.0], velocity(fix)
        self.vel = list(vel or (0.0, 0.0))
        unsure = self.params.sigma_velocity if vel else self.params.sigma_velocity_unknown
        self.p, self.c, self.v = fix["pos_sigma_m"] ** 2, 0.0, unsure**2
        self.rejects, self.updates = 0, 1

    def ahead(self, t: float) -> tuple[list[float], float, float, float]:
        """Position, p, c and v after the time until t."""
        dt = max(0.0, t - self.t)
        q = self.params.sigma_accel**2
        pos = [x + dt * u for x, u in zip(self.pos, self.vel, strict=True)]
        p = self.p + 2 * dt * self.c + dt * dt * self.v + q * dt**4 / 4
        return pos, p, self.c + dt * self.v + q * dt**3 / 2, self.v + q * dt * dt

    def local(self, lat: float, lon: float) -> tuple[float, float]:
        dlon = (lon - self.lon0 + 540.0) % 360.0 - 180.0
        return dlon * geo.M_PER_DEG * math.cos(math.radians(self.lat0)), (lat - self.lat0) * geo.M_PER_DEG

    def place(self, pos: list[float]) -> tuple[float, float]:
        lon = self.lon0 + pos[0] / (geo.M_PER_DEG * math.cos(math.radians(self.lat0)))
        return self.lat0 + pos[1] / geo.M_PER_DEG, (lon + 540.0) % 360.0 - 180.0

    def predicted(self, t: float) -> tuple[float, float, float]:
        """Latitude, longitude and standard deviation expected at t."""
        pos, p, _, _ = self.ahead(t)
        return (*self.place(pos), math.sqrt(p))

    def add(self, fix: dict) -> tuple[str, float | None]:
        """Outcome and the innovation that was gated."""
        if self.live and math.floor(fix["t"] / self.params.sweep_s) * self.params.sweep_s - self.t > self.params.stale_s:
            self.live = False
        if not self.live:
            self.start(fix)
            return "started", None
        dt = fix["t"] - self.t
        if dt < self.params.min_dt_s:
            return ("out_of_order" if dt < -self.params.min_dt_s else "duplicate"), None
        pos, p, c, v = self.ahead(fix["t"])
        r = fix["pos_sigma_m"] ** 2
        miss = [z - x for z, x in zip(self.local(fix["lat"], fix["lon"]), pos, strict=True)]
        nis = (miss[0] ** 2 + miss[1] ** 2) / (p + r)
        if nis > self.params.gate:
            self.rejects += 1
            if self.rejects < self.params.max_rejects:
                return "rejected", nis
            self.start(fix)
            return "restarted", nis
        self._merge(pos, p, c, v, miss, r, velocity(fix))
        self.t, self.rejects, self.updates = fix["t"], 0, self.updates + 1
        if math.hypot(*self.pos) > self.params.reanchor_m:
            self.lat0, self.lon0 = self.place(self.pos)
            self.pos = [0.0, 0.0]
        return "updated", nis

    def _merge(self, pos, p, c, v, miss, r, measured) -> None:
        if measured is None:
            gains = ((p / (p + r), 0.0), (c / (p + r), 0.0))
            slip, rv = (0.0, 0.0), 0.0
        else:
            rv = self.params.sigma_velocity**2
            a, d = p + r, v + rv
            det = a * d - c * c
            gains = (((p * d - c * c) / det, (c * a - p * c) / det), ((c * d - v * c) / det, (v * a - c * c) / det))
            slip = [m - u for m, u in zip(measured, self.vel, strict=True)]
        (k11, k12), (k21, k22) = gains
        self.pos = [x + k11 * y + k12 * w for x, y, w in zip(pos, miss, slip, strict=True)]
        self.vel = [u + k21 * y + k22 * w for u, y, w in zip(self.vel, miss, slip, strict=True)]
        # (I - K) M (I - K)' + K R K', which stays positive whatever the rounding
        a11, a12, a21, a22 = 1 - k11, -k12, -k21, 1 - k22
        if measured is None:
            a12, a22 = 0.0, 1.0
        self.p = a11 * a11 * p + 2 * a11 * a12 * c + a12 * a12 * v + k11 * k11 * r + k12 * k12 * rv
        self.c = a11 * a21 * p + (a11 * a22 + a12 * a21) * c + a12 * a22 * v + k11 * k21 * r + k12 * k22 * rv
        self.v = a21 * a21 * p + 2 * a21 * a22 * c + a22 * a22 * v + k21 * k21 * r + k22 * k22 * rv


def velocity(fix: dict) -> tuple[float, float] | None:
    """East and north, where the fix has both speed and course."""
    if fix["sog"] is None or fix["cog"] is None:
        return None
    speed, course = fix["sog"] * geo.KNOT_MS, math.radians(fix["cog"])
    return speed * math.sin(course), speed * math.cos(course)


SCHEMA = (
    "seq long, mmsi long, t double, outcome string, nis double, predicted_lat double, predicted_lon double, predicted_sigma_m double, "
    "lat double, lon double, v_east double, v_north double, sigma_m double, track_t double, updates long"
)


def step(track: Track, fix: dict) -> list[tuple]:
    """One output row for a fix: what was expected of it, what became of it, and the track after it."""
    expected = track.predicted(fix["t"]) if track.live else (None, None, None)
    outcome, nis = track.add(fix)
    return [
        (fix["seq"], fix["mmsi"], fix["t"], outcome, nis, *expected, *track.place(track.pos), *track.vel, math.sqrt(track.p), track.t, track.updates)
    ]


def accepting_step(track: Track, fix: dict) -> list[tuple]:
    """The track after a fix that it took; no row for any other."""
    if track.add(fix)[0] not in ACCEPTED:
        return []
    return [(fix["seq"], fix["mmsi"], fix["t"], *track.place(track.pos), *track.vel)]


def with_sigma(fixes: DataFrame, sigma_m: float = 15.0) -> DataFrame:
    """Fixes with a position uncertainty, the given one where they have none."""
    if "pos_sigma_m" in fixes.columns:
        return fixes
    return fixes.withColumn("pos_sigma_m", F.lit(sigma_m))


def track(fixes: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per fix, in the order (t, seq) of each vessel. A track that was silent for stale_s at the last whole
    sweep_s is dropped before the fix."""
    rows = with_sigma(fixes).select("seq", "mmsi", "t", "lat", "lon", "sog", "cog", "pos_sigma_m")
    return fold(rows, "mmsi", ["t", "seq"], lambda: Track(params), step, SCHEMA)


def accepted(fixes: DataFrame, params: Params = Params()) -> DataFrame:
    """(seq, mmsi, t, lat, lon, v_east, v_north): the rows of `track` for reports that their track took, and nothing but these columns."""
    rows = with_sigma(fixes).select("seq", "mmsi", "t", "lat", "lon", "sog", "cog", "pos_sigma_m")
    schema = "seq long, mmsi long, t double, lat double, lon double, v_east double, v_north double"
    return fold(rows, "mmsi", ["t", "seq"], lambda: Track(params), accepting_step, schema)


def track_each(fixes: DataFrame, grid: list[tuple[Params, float]]) -> DataFrame:
    """The rows of `track` with a column `run`, for each of several (parameters, position uncertainty), in one pass:
    each run's vessels are keys of their own."""
    spark = fixes.sparkSession
    runs = spark.createDataFrame([(k, float(sigma)) for k, (_, sigma) in enumerate(grid)], "run long, pos_sigma_m double")
    base = fixes.select("seq", "mmsi", "t", "lat", "lon", "sog", "cog").join(F.broadcast(runs))
    rows = base.withColumn("mmsi", F.col("run") * RUN + F.col("mmsi"))

    def first_step(state: list[Track], fix: dict) -> list[tuple]:
        if not state:
            state.append(Track(grid[fix["run"]][0]))
        return step(state[0], fix)

    found = fold(rows, "mmsi", ["t", "seq"], list, first_step, SCHEMA)
    return found.withColumns({"run": F.floor(F.col("mmsi") / RUN), "mmsi": F.col("mmsi") % RUN})


def tracks(tracked: DataFrame) -> DataFrame:
    """The current track of every vessel: its last row."""
    last = F.max_by(F.struct("track_t", "lat", "lon", "v_east", "v_north", "sigma_m", "updates"), F.struct("t", "seq"))
    return tracked.groupBy("mmsi").agg(last.alias("s")).select("mmsi", F.col("s.track_t").alias("t"), *(F.col(f"s.{c}").alias(c) for c in ("lat", "lon", "v_east", "v_north", "sigma_m", "updates")))


def statistics(tracked: DataFrame) -> DataFrame:
    """(outcome, n) with a row for each outcome, and vessels and fixes."""
    counts = [F.sum((F.col("outcome") == o).cast("long")).alias(o) for o in OUTCOMES]
    wide = tracked.agg(F.count("*").alias("fixes"), F.countDistinct("mmsi").alias("vessels"), *counts)
    names = ["fixes", "vessels", *OUTCOMES]
    pairs = F.array(*(F.struct(F.lit(n).alias("counter"), F.coalesce(F.col(n), F.lit(0)).alias("n")) for n in names))
    return wide.select(F.inline(pairs))
