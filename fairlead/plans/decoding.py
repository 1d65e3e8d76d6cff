"""Queries of decoding: wire forms are made from the fixes view and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions import times
from fairlead.operators import fixes as fix_readers
from fairlead.operators import messages, nmea, reassembly
from fairlead.plans.traffic import rounded
from fairlead.sources import encode, readers, recorder, replay
from fairlead.sources.tables import FIXES_SQL, T0, fixes


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nmea.parse(encode.report_lines(fixes(spark, sf_dir)))


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.decode(reassembly.sentences(encode.report_lines(fixes(spark, sf_dir))))


def n1_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of the events' kinds with their numbers."""
    body = F.concat("event_type", F.lit(","), F.col("event_id").cast("string"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", nmea.checksum(body).alias("sum"), nmea.hex_checksum(body).alias("hex"))


def n2_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("seq", "source", "unix_time", "channel")


def n3_parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines damaged in ten ways, counted by the error found first."""
    lines = encode.report_lines(fixes(spark, sf_dir))
    line, k = F.col("line"), F.col("seq") % 12
    bare = F.regexp_replace(line, r"^\\[^\\]*\\", "")
    body = F.regexp_extract(bare, r"^!(.*)\*..$", 1)
    again = lambda b: F.concat(F.lit("!"), b, F.lit("*"), nmea.hex_checksum(b))
    damaged = (
        F.when(k == 0, F.lit("  \r\n"))
        .when(k == 1, F.concat(F.lit("$"), F.substr(bare, F.lit(2))))
        .when(k == 2, F.regexp_replace(bare, r"\*..$", ""))
        .when(k == 3, F.regexp_replace(bare, ",0\\*", ",1*"))
        .when(k == 4, F.regexp_replace(line, r"^\\s:", "\\\\s;"))
        .when(k == 5, again(F.concat(body, F.lit(",1"))))
        .when(k == 6, again(F.regexp_replace(body, "VDM", "VDX")))
        .when(k == 7, again(F.regexp_replace(body, "^AIVDM,1,1", "AIVDM,1,2")))
        .when(k == 8, again(F.regexp_replace(body, ",0$", ",6")))
        .when(k == 9, again(F.regexp_replace(body, ",0$", "[,0")))
        .otherwise(F.concat(line, F.lit("\r\n")))
    )
    parsed = nmea.parse(lines.select("seq", damaged.alias("line")))
    return parsed.groupBy(F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


def d6_position_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _decoded(spark, sf_dir).select("seq", "type", "mmsi", "lat", "lon", "sog", "cog", "heading", "utc_second", "accuracy")
    return rounded(found, {"lat": 6, "lon": 6})


def d6_other_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class A reports with a rate of turn (3), class B reports with static data (19), parts A and B of static data (24)."""
    parsed = nmea.parse(encode.other_lines(fixes(spark, sf_dir)))
    found = messages.decode(reassembly.reassemble(parsed))
    names = ("seq", "type", "mmsi", "rot", "lat", "lon", "sog", "cog", "name", "ship_type", "callsign", "part")
    sizes = (F.col(f"dims.{n}").alias(n) for n in ("to_bow", "to_stern", "to_port", "to_starboard"))
    return rounded(found.select(*names, *sizes), {"rot": 6, "lat": 6, "lon": 6})


def d7_voyage_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = messages.decode(reassembly.sentences(encode.voyage_lines(fixes(spark, sf_dir))))
    return found.select(
        "seq", "mmsi", "imo", "callsign", "name", "ship_type", F.col("dims.to_bow").alias("to_bow"), "draught_m", "destination"
    )


def d7_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reassembly.dropped(nmea.parse(encode.voyage_lines(fixes(spark, sf_dir))))


def k1_message_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.as_json(_decoded(spark, sf_dir))


def k2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.statistics(_parsed(spark, sf_dir), _decoded(spark, sf_dir))


def k3_fix_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fix as JSON, read back; and whether a missing speed is written as null."""
    made = recorder.fix_json(fixes(spark, sf_dir))
    back = F.from_json("json", "mmsi long, t double, lat double, lon double, sog double, cog double")
    found = made.select("seq", back.alias("r"), F.col("json").contains('"sog":null').alias("null_written")).select("seq", "r.*", "null_written")
    return rounded(found, {"lat": 6, "lon": 6})


def s9_tag_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time in each line's tag block, without parsing the sentence."""
    return encode.report_lines(fixes(spark, sf_dir)).select("seq", nmea.tag_time(F.col("line")).alias("t"))


def s11_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of one hour in a box."""
    return readers.slice_of_area(fixes(spark, sf_dir), T0 + 600.0, 55.4, 12.4, 55.9, 12.9).select("seq", "mmsi", "t")


def k6_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly file of each report and its line's tag block."""
    received = F.col("t").cast("long")
    line = recorder.stamped(F.lit("!X"), received)
    return fixes(spark, sf_dir).select("seq", recorder.file_name(received).alias("file"), line.alias("line"))


def n7_csv_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fix_readers.from_csv(encode.csv_lines(fixes(spark, sf_dir))).select("seq", "mmsi", "t", "lat", "lon", "sog", "cog", "reject")


def n9_json_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fix_readers.from_json(encode.json_lines(fixes(spark, sf_dir))).select("seq", "mmsi", "t", "lat", "lon", "sog", "cog", "reject")


def n11_message_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fix_readers.from_messages(_decoded(spark, sf_dir)), {"lat": 6, "lon": 6})


def s8_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vessel's reports as a recording of its own, at ten times the speed, gaps cut to 120 s."""
    found = replay.schedule(fixes(spark, sf_dir).select("mmsi", "seq", "t"), 10.0, 120.0, ["mmsi"])
    return rounded(found, {"offset_s": 3})


def s6_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents' texts as chunks, of at most 200 characters."""
    chunks = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("seq"), F.col("text").alias("chunk"))
    return readers.framed(chunks, 200)


def s10_json_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.json_lines(fixes(spark, sf_dir)).select("seq", fix_readers.json_time(F.col("line")).alias("t"))


def n6_civil_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day numbers of the orders' years and months with a day that may be past the month's end."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    day = F.col("o_orderkey") % 31 + 1
    return orders.select("o_orderkey", times.civil_days(F.year("d"), F.month("d"), day.cast("int")).cast("long").alias("days"))


_XOR = "list_reduce(list_transform(string_split({0}, ''), lambda c: ascii(c)), lambda a, b: xor(a, b))"
_CSV = "CASE WHEN sog IS NOT NULL THEN {0} END"
ORACLES = {
    "n1_checksums": f"WITH b AS (SELECT event_id, event_type || ',' || event_id AS s FROM events) SELECT event_id, {_XOR.format('s')} AS sum, upper(lpad(to_hex({_XOR.format('s')}), 2, '0')) AS hex FROM b",
    "n2_tags": f"WITH {FIXES_SQL} SELECT seq, CAST(seq % 7 AS VARCHAR) AS source, CAST(t AS BIGINT) AS unix_time, CASE WHEN seq % 2 = 0 THEN 'A' ELSE 'B' END AS channel FROM fixes",
    "n3_parse_errors": f"WITH {FIXES_SQL} SELECT (['empty', 'missing_start', 'missing_checksum', 'bad_checksum', 'bad_tag_block', 'wrong_field_count', 'unsupported_sentence', 'bad_fragment_fields', 'bad_fill_bits', 'bad_payload_char', 'ok', 'ok'])[1 + seq % 12] AS outcome, count(*) AS n FROM fixes GROUP BY 1",
    "d6_position_reports": f"""WITH {FIXES_SQL} SELECT seq, CASE WHEN seq % 2 = 0 THEN 1 ELSE 18 END AS type, mmsi, round(round(lat * 600000) / 600000, 6) AS lat, round(round(lon * 600000) / 600000, 6) AS lon,
        round(sog * 10) / 10 AS sog, round(cog * 10) / 10 AS cog, CAST(floor(cog) AS INTEGER) AS heading, CAST(CAST(t AS BIGINT) % 60 AS INTEGER) AS utc_second, true AS accuracy FROM fixes""",
    "d6_other_reports": f"""WITH {FIXES_SQL}, m AS (SELECT *, seq % 4 AS k, mmsi - 219000000 AS u, seq % 11 <> 0 AS placed, seq % 256 - 128 AS turn FROM fixes)
      SELECT seq, CAST((ARRAY[3, 19, 24, 24])[1 + k] AS INTEGER) AS type, mmsi, CASE WHEN k = 0 AND turn <> -128 AND abs(turn) <> 127 THEN round(sign(turn) * pow(turn / 4.733::DOUBLE, 2), 6) END AS rot,
        CASE WHEN k < 2 AND placed THEN round(round(lat * 600000) / 600000, 6) END AS lat, CASE WHEN k < 2 AND placed THEN round(round(lon * 600000) / 600000, 6) END AS lon,
        CASE WHEN k < 2 THEN round(sog * 10) / 10 END AS sog, CASE WHEN k < 2 THEN round(cog * 10) / 10 END AS cog, CASE k WHEN 0 THEN NULL WHEN 3 THEN '' ELSE 'SHIP ' || u END AS name,
        CAST(CASE k WHEN 0 THEN NULL WHEN 2 THEN 0 ELSE u % 100 END AS INTEGER) AS ship_type, CASE k WHEN 2 THEN '' WHEN 3 THEN 'K' || u END AS callsign, CAST(CASE WHEN k > 1 THEN k - 2 END AS INTEGER) AS part,
        CAST(CASE WHEN k IN (1, 3) THEN u % 500 END AS INTEGER) AS to_bow, CAST(CASE WHEN k IN (1, 3) THEN 3 END AS INTEGER) AS to_stern, CAST(CASE WHEN k IN (1, 3) THEN 1 END AS INTEGER) AS to_port, CAST(CASE WHEN k IN (1, 3) THEN 2 END AS INTEGER) AS to_starboard FROM m""",
    "d7_voyage_reports": f"""WITH {FIXES_SQL}, v AS (SELECT DISTINCT mmsi, mmsi - 219000000 AS u FROM fixes) SELECT u * 2 + 2 AS seq, mmsi, u + 9000000 AS imo, 'C' || u AS callsign, 'VESSEL ' || u AS name,
        CAST(70 + u % 10 AS INTEGER) AS ship_type, CAST(u % 400 AS INTEGER) AS to_bow, (u % 200 + 1) / 10.0::DOUBLE AS draught_m, 'PORT ' || (u % 50) AS destination FROM v WHERE u % 10 <> 9""",
    "d7_dropped": f"WITH {FIXES_SQL} SELECT count(DISTINCT mmsi) FILTER (WHERE (mmsi - 219000000) % 10 = 9) AS fragments_dropped FROM fixes",
    "k1_message_json": f"""WITH {FIXES_SQL}, m AS (SELECT *, format('{{:.10g}}', round(lat * 600000) / 600000) AS la, format('{{:.10g}}', round(lon * 600000) / 600000) AS lo,
        coalesce(format('{{:.10g}}', sog), 'null') AS s, coalesce(format('{{:.10g}}', cog), 'null') AS c, coalesce(CAST(CAST(floor(cog) AS INTEGER) AS VARCHAR), 'null') AS h FROM fixes)
      SELECT seq, '{{"type":' || CASE WHEN seq % 2 = 0 THEN 1 ELSE 18 END || ',"mmsi":' || mmsi || ',"t":' || CAST(t AS BIGINT) || CASE WHEN seq % 2 = 0 THEN ',"nav_status":0' ELSE '' END
        || ',"lat":' || la || ',"lon":' || lo || ',"sog":' || s || ',"cog":' || c || ',"heading":' || h || CASE WHEN seq % 2 = 0 THEN ',"rot":null' ELSE '' END || '}}' AS json FROM m""",
    "k2_statistics": f"""WITH {FIXES_SQL} SELECT 'lines' AS counter, count(*) AS n FROM fixes UNION ALL SELECT 'sentences_ok', count(*) FROM fixes UNION ALL SELECT 'messages', count(*) FROM fixes
        UNION ALL SELECT 'vessels', count(DISTINCT mmsi) FROM fixes UNION ALL SELECT 'type_' || CASE WHEN seq % 2 = 0 THEN 1 ELSE 18 END, count(*) FROM fixes GROUP BY 1""",
    "k3_fix_json": f"WITH {FIXES_SQL} SELECT seq, mmsi, t, round(lat, 6) AS lat, round(lon, 6) AS lon, sog, cog, sog IS NULL AS null_written FROM fixes",
    "s9_tag_times": f"WITH {FIXES_SQL} SELECT seq, CAST(t AS BIGINT) AS t FROM fixes",
    "s11_slice": f"WITH {FIXES_SQL} SELECT seq, mmsi, t FROM fixes WHERE t >= {T0 + 600.0} AND t < {T0 + 4200.0} AND lat BETWEEN 55.4 AND 55.9 AND lon BETWEEN 12.4 AND 12.9",
    "k6_recorded": f"""WITH {FIXES_SQL}, b AS (SELECT seq, t, 'c:' || CAST(t AS BIGINT) AS s FROM fixes) SELECT seq, 'ais-' || strftime(make_timestamp(CAST(t AS BIGINT) * 1000000), '%Y%m%d-%H') || '.nmea' AS file,
        chr(92) || s || '*' || upper(lpad(to_hex({_XOR.format("s")}), 2, '0')) || chr(92) || '!X' AS line FROM b""",
    "n7_csv_fixes": f"""WITH {FIXES_SQL} SELECT seq, mmsi, CASE WHEN seq % 50 <> 49 THEN t END AS t, CAST(printf('%.6f', lat) AS DOUBLE) AS lat, CAST(printf('%.6f', lon) AS DOUBLE) AS lon,
        sog, cog, CASE WHEN seq % 50 = 49 THEN 'invalid' END AS reject FROM fixes""",
    "n9_json_fixes": f"""WITH {FIXES_SQL} SELECT seq, CASE WHEN seq % 50 <> 49 THEN mmsi END AS mmsi, t, CAST(printf('%.6f', lat) AS DOUBLE) AS lat, CAST(printf('%.6f', lon) AS DOUBLE) AS lon,
        sog, cog, CASE WHEN seq % 50 = 49 THEN 'invalid' END AS reject FROM fixes""",
    "n11_message_fixes": f"""WITH {FIXES_SQL} SELECT seq, mmsi, t, round(round(lat * 600000) / 600000, 6) AS lat, round(round(lon * 600000) / 600000, 6) AS lon, round(sog * 10) / 10 AS sog, round(cog * 10) / 10 AS cog,
        10::DOUBLE AS pos_sigma_m FROM fixes""",
    "s8_replay": f"""WITH {FIXES_SQL}, r AS (SELECT mmsi, seq, t, max(t) OVER w AS latest, first_value(t) OVER w AS first FROM fixes WINDOW w AS (PARTITION BY mmsi ORDER BY seq ROWS UNBOUNDED PRECEDING)),
        b AS (SELECT *, lag(latest) OVER (PARTITION BY mmsi ORDER BY seq) AS before FROM r),
        s AS (SELECT *, sum(greatest(coalesce(latest - before, 0) - 120, 0)) OVER (PARTITION BY mmsi ORDER BY seq ROWS UNBOUNDED PRECEDING) AS skipped_s FROM b)
      SELECT mmsi, seq, t, round((latest - first - skipped_s) / 10, 3) AS offset_s, coalesce(t < before, false) AS backwards, skipped_s FROM s""",
    "s6_framed": r"""WITH p AS (SELECT doc_id AS seq, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents)
      SELECT seq, CAST(place AS INTEGER) AS place, regexp_replace(raw, '\r$', '') AS line FROM p WHERE length(raw) <= 200 AND regexp_replace(raw, '\r$', '') <> ''""",
    "s10_json_times": f"WITH {FIXES_SQL} SELECT seq, CAST(t AS BIGINT) AS t FROM fixes",
    "n6_civil_days": "SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE)) + o_orderkey % 31 AS BIGINT) AS days FROM orders",
}
QUERIES = {
    "n1_checksums": n1_checksums, "n2_tags": n2_tags, "n3_parse_errors": n3_parse_errors, "n6_civil_days": n6_civil_days,
    "n7_csv_fixes": n7_csv_fixes, "n9_json_fixes": n9_json_fixes, "n11_message_fixes": n11_message_fixes,
    "d6_position_reports": d6_position_reports, "d6_other_reports": d6_other_reports, "d7_voyage_reports": d7_voyage_reports, "d7_dropped": d7_dropped,
    "k1_message_json": k1_message_json, "k2_statistics": k2_statistics, "k3_fix_json": k3_fix_json, "k6_recorded": k6_recorded, "s9_tag_times": s9_tag_times, "s11_slice": s11_slice,
    "s6_framed": s6_framed, "s8_replay": s8_replay, "s10_json_times": s10_json_times,
}
