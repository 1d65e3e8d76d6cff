"""An AIS-shaped view of the driver's `events` table: the central table of fixes.

Thirty days become 108 minutes, a user a vessel. Positions follow straight lines by integer and multiply-add
arithmetic only, so both engines compute the same doubles. Every 97th report jumps, every 211th reports 64 knots, one
kind of event lacks speed and course.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

T0 = 1_700_000_000

_BODY = """
SELECT event_id AS seq, mmsi, CAST(t AS DOUBLE) AS t,
  CAST(55.3 AS DOUBLE) + (u % 30) * CAST(0.03 AS DOUBLE) + dn * v * (t - {t0}) * CAST(0.0000046 AS DOUBLE)
    + CASE WHEN event_id % 97 = 0 THEN CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS lat,
  CAST(12.3 AS DOUBLE) + ((u * 7) % 30) * CAST(0.03 AS DOUBLE) + de * v * (t - {t0}) * CAST(0.000008 AS DOUBLE) AS lon,
  CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 211 = 0 THEN CAST(64 AS DOUBLE)
       WHEN de = 0 AND dn = 0 THEN CAST(0 AS DOUBLE) ELSE v END AS sog,
  CAST(CASE WHEN event_type = 'error' THEN NULL WHEN de = 0 AND dn = 0 THEN 0
       WHEN de = 0 THEN 90 - 90 * dn WHEN dn = 0 THEN 180 - 90 * de
       WHEN dn > 0 THEN CASE WHEN de > 0 THEN 45 ELSE 315 END
       ELSE CASE WHEN de > 0 THEN 135 ELSE 225 END END AS DOUBLE) AS cog
FROM (SELECT *, CAST(4 + (u % 20) AS DOUBLE) AS v, (u % 3) - 1 AS de, ((u {div} 3) % 3) - 1 AS dn
      FROM (SELECT event_id, user_id AS u, 219000000 + user_id AS mmsi, event_type, {t0} + ({micros}) {div} 400000000 AS t FROM {table}))
"""

#: CTE for DuckDB: fixes(seq, mmsi, t, lat, lon, sog, cog).
FIXES_SQL = "fixes AS (" + _BODY.format(
    t0=T0, div="//", micros="epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')", table="events"
) + ")"


def spread(rows: DataFrame) -> DataFrame:
    """The rows over at least as many partitions as the session has cores: a file of one row group is read by one task,
    and all that follows without a shuffle would be done by it too. Tables of many files are left as they are."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, mmsi, t, lat, lon, sog, cog)."""
    micros = "unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(TIMESTAMP '2024-01-01 00:00:00')"
    return spark.sql(
        _BODY.format(t0=T0, div="div", micros=micros, table="{events}"),
        events=spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")),
    )
