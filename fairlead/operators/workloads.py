"""Larger and damaged versions of a recording: scale-up, perturbation, planted anomalies.

Choices come from hashes of ids and a seed, so a workload is the same on every run and however it is partitioned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.functions import geo

# A vessel can be chosen if it reports so often over so long.
LEAST_REPORTS, LEAST_SPAN_S = 60, 2400.0
KINDS = ("impossible_speed", "position_jump", "gap", "identity_conflict")


def uniform(seed: Column | int, *ids: Column | str) -> Column:
    """[0, 1) from the first 52 bits of MD5 over a seed and ids."""
    parts = [F.lit(seed) if isinstance(seed, int) else seed, *(F.col(i) if isinstance(i, str) else i for i in ids)]
    digest = F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))
    return F.conv(F.substr(digest, F.lit(1), F.lit(13)), 16, 10).cast("double") / float(1 << 52)


def normal(seed: int, *ids: Column | str) -> Column:
    """Standard normal, by Box and Muller."""
    u, v = uniform(seed, *ids), uniform(seed + 1, *ids)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def global_copies(points: DataFrame, copies: int) -> DataFrame:
    """(id, lat, lon): the points and copies of them turned about different axes of the sphere."""
    out = points.select("id", "lat", "lon")
    for k in range(1, copies):
        *axis, angle = axis_of(k)
        lat, lon = geo.lat_lon(*geo.rotated(*geo.ecef(F.col("lat"), F.col("lon")), tuple(axis), angle))
        out = out.unionByName(points.select((F.col("id") + k * 10_000_000_000).alias("id"), lat.alias("lat"), lon.alias("lon")))
    return out


def axis_of(k: int) -> tuple[float, float, float, float]:
    """A unit axis and an angle for the k-th copy, spread by irrational steps."""
    z, way = 2 * ((k * 0.618034) % 1) - 1, 2 * math.pi * ((k * 0.754878) % 1)
    r = math.sqrt(1 - z * z)
    return r * math.cos(way), r * math.sin(way), z, 2 * math.pi * ((k * 0.569840) % 1)


def denser(points: DataFrame, copies: int, spread_m: float = 1000.0, seed: int = 42) -> DataFrame:
    """(id, lat, lon): the points and jittered copies around each, as in a crowded port."""
    each = points.select("id", "lat", "lon", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("k"))
    shift = lambda s: F.when(F.col("k") == 0, 0.0).otherwise(normal(seed + s, "id", "k") * spread_m)
    lat, lon = geo.moved(F.col("lat"), F.col("lon"), shift(0), shift(10), F.lit(1.0))
    return each.select((F.col("id") + F.col("k").cast("long") * 10_000_000_000).alias("id"), lat.alias("lat"), lon.alias("lon"))


def perturbed(fixes: DataFrame, sigma_m: float = 15.0, dropout: float = 0.3, outliers: float = 0.0, seed: int = 42) -> DataFrame:
    """Fixes with noise, some without speed and course, some 500 to 2000 m off; adds `outlier`."""
    off = uniform(seed + 100, "seq") < outliers
    far, way = 500 + 1500 * uniform(seed + 101, "seq"), 2 * math.pi * uniform(seed + 102, "seq")
    east = normal(seed, "seq") * sigma_m + F.when(off, far * F.sin(way)).otherwise(0.0)
    north = normal(seed + 10, "seq") * sigma_m + F.when(off, far * F.cos(way)).otherwise(0.0)
    lat, lon = geo.moved(F.col("lat"), F.col("lon"), east, north, F.lit(1.0))
    silent = uniform(seed + 103, "seq") < dropout
    changed = {"lat": lat, "lon": lon, "sog": F.when(~silent, F.col("sog")), "cog": F.when(~silent, F.col("cog"))}
    return fixes.select(*(changed.get(c, F.col(c)).alias(c) for c in fixes.columns), off.alias("outlier"))


def eligible(fixes: DataFrame) -> DataFrame:
    """(mmsi, first_t, last_t) of vessels that report often enough for long enough."""
    found = fixes.groupBy("mmsi").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    return found.filter((F.col("n") >= LEAST_REPORTS) & (F.col("last_t") - F.col("first_t") >= LEAST_SPAN_S)).drop("n")


def planted(fixes: DataFrame, seeds: list[int], each: int = 5, gap_s: float = 900.0) -> tuple[DataFrame, DataFrame]:
    """(fixes with a column seed, labels (seed, kind, mmsi, from_t, to_t)): `each` anomalies of every kind for each seed.

    A chosen vessel gets, somewhere before its last third: one report of 80 to 100 kn; one report 5 to 10 km off; no reports for gap_s; or a
    second transmitter 20 km away that repeats its reports half a minute later. All seeds are one frame.
    """
    spark = fixes.sparkSession
    runs = spark.createDataFrame([(s,) for s in seeds], "seed int")
    rank = eligible(fixes).crossJoin(F.broadcast(runs)).withColumn("u", uniform(F.col("seed"), "mmsi"))
    place = F.row_number().over(Window.partitionBy("seed").orderBy("u", "mmsi")) - 1
    chosen = rank.withColumn("place", place).filter(F.col("place") < each * len(KINDS))
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("place") % len(KINDS)).cast("int"))
    # at different times, or silences that end together would pass for lost coverage
    share = 0.2 + 0.4 * uniform(F.col("seed"), "mmsi", F.lit(3))
    middle = F.floor(F.col("first_t") + share * (F.col("last_t") - F.col("first_t")))
    chosen = chosen.select("seed", "mmsi", kind.alias("kind"), middle.alias("at"))
    rows = fixes.crossJoin(F.broadcast(runs)).join(F.broadcast(chosen), ["seed", "mmsi"], "left")
    after = (F.col("kind").isNotNull()) & (F.col("t") >= F.col("at"))
    first = F.min(F.when(after, F.struct("t", "seq"))).over(Window.partitionBy("seed", "mmsi"))
    rows = rows.withColumn("hit", F.struct("t", "seq").eqNullSafe(first))
    fast = F.col("hit") & (F.col("kind") == "impossible_speed")
    jump = F.col("hit") & (F.col("kind") == "position_jump")
    north = F.when(jump, 5000 + 5000 * uniform(F.col("seed"), "mmsi", F.lit(1))).otherwise(0.0)
    lat = F.col("lat") + north / geo.M_PER_DEG
    sog = F.when(fast, 80 + 20 * uniform(F.col("seed"), "mmsi", F.lit(2))).otherwise(F.col("sog"))
    gone = (F.col("kind") == "gap") & (F.col("t") > F.col("at")) & (F.col("t") < F.col("at") + gap_s)
    kept = rows.filter(~F.coalesce(gone, F.lit(False)))
    base = kept.select("seed", *(lat.alias(c) if c == "lat" else sog.alias(c) if c == "sog" else F.col(c) for c in fixes.columns))
    twin = rows.filter("kind = 'identity_conflict'").filter(after & (F.col("t") < F.col("at") + 600))
    other = {"lat": F.col("lat") + 20_000 / geo.M_PER_DEG, "t": F.col("t") + 30, "seq": F.col("seq") + 5_000_000_000}
    second = twin.select("seed", *(other.get(c, F.col(c)).alias(c) for c in fixes.columns))
    labels = chosen.select("seed", "kind", "mmsi", (F.col("at") - 60).alias("from_t"), (F.col("at") + F.when(F.col("kind") == "gap", gap_s + 1800).otherwise(1200)).alias("to_t"))
    return base.unionByName(second), labels
