"""Wire forms of the fixes view, for round trips: sentences, CSV rows and JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions import bits
from fairlead.functions.stages import computed
from fairlead.operators import nmea


Fields = list[tuple[Column, int]]


def position_fields(kind: int, mmsi: Column, sog: Column, cog: Column, lat: Column, lon: Column, utc_second: Column, rot: Column | None = None) -> Fields:
    """A class A (1, 2, 3) or class B (18) position report."""
    head = [(F.lit(kind), 6), (F.lit(0), 2), (mmsi, 30)]
    head += [(F.lit(0), 4), (F.lit(-128) if rot is None else F.coalesce(rot, F.lit(-128)), 8)] if kind < 4 else [(F.lit(0), 8)]
    used = [
        (F.coalesce(F.round(sog * 10), F.lit(1023.0)), 10), (F.lit(1), 1), (F.round(lon * 600000), 28), (F.round(lat * 600000), 27),
        (F.coalesce(F.round(cog * 10), F.lit(3600.0)), 12), (F.coalesce(F.floor(cog), F.lit(511)), 9), (utc_second, 6),
    ]
    return filled(head + used, 168)


def extended_fields(mmsi: Column, sog: Column, cog: Column, lat: Column, lon: Column, utc_second: Column, name: Column, ship_type: Column, bow: Column) -> Fields:
    """A class B report with static data (19)."""
    start = position_fields(18, mmsi, sog, cog, lat, lon, utc_second)
    start = [(F.lit(19), 6), *start[1:-1], (F.lit(0), 4)]
    return filled([*start, *bits.text_fields(name, 20), (ship_type, 8), (bow, 9), (F.lit(3), 9), (F.lit(1), 6), (F.lit(2), 6)], 312)


def static_fields(part: int, mmsi: Column, name: Column, ship_type: Column, callsign: Column, bow: Column) -> Fields:
    """Part A or B of a static data report (24)."""
    head = [(F.lit(24), 6), (F.lit(0), 2), (mmsi, 30), (F.lit(part), 2)]
    if part == 0:
        return filled([*head, *bits.text_fields(name, 20)], 160)
    return filled([*head, (ship_type, 8), (F.lit(0), 42), *bits.text_fields(callsign, 7), (bow, 9), (F.lit(3), 9), (F.lit(1), 6), (F.lit(2), 6)], 168)


def voyage_fields(mmsi: Column, imo: Column, callsign: Column, name: Column, ship_type: Column, bow: Column, draught_dm: Column, destination: Column) -> Fields:
    """A static and voyage report (5)."""
    t = bits.text_fields
    return [
        (F.lit(5), 6), (F.lit(0), 2), (mmsi, 30), (F.lit(0), 2), (imo, 30), *t(callsign, 7), *t(name, 20), (ship_type, 8),
        (bow, 9), (F.lit(20), 9), (F.lit(8), 6), (F.lit(7), 6), (F.lit(1), 4), (F.lit(0), 20), (draught_dm, 8), *t(destination, 20), (F.lit(0), 2),
    ]


def filled(fields: Fields, n_bits: int) -> Fields:
    """With zeros up to a number of bits."""
    rest = n_bits - sum(n for _, n in fields)
    return [*fields, *((F.lit(0), min(bits.WORD, rest - at)) for at in range(0, rest, bits.WORD))]


def with_payload(rows: DataFrame, kinds: list[tuple[Column, Fields]], name: str = "payload") -> DataFrame:
    """The rows with the payload of the first kind whose condition holds; all kinds are of the same number of bits."""
    made = [(fits, *bits.packed(fields)) for fits, fields in kinds]
    n_bits = made[0][2]
    words = {}
    for k in range(len(made[0][1])):
        word = F.lit(None).cast("long")
        for fits, own, _ in reversed(made):
            word = F.when(fits, own[k]).otherwise(word)
        words[f"_e{k}"] = word
    step = computed(rows, words)
    step = computed(step, {name: bits.payload_of([F.col(w) for w in words], n_bits)})
    return step.drop(*words)


def report_lines(fixes: DataFrame) -> DataFrame:
    """(seq, line): each fix as a tagged sentence, class A for even seq, class B for odd ones."""
    args = [F.col("mmsi"), F.col("sog"), F.col("cog"), F.col("lat"), F.col("lon"), F.col("t").cast("long") % 60]
    even = F.col("seq") % 2 == 0
    step = with_payload(fixes, [(even, position_fields(1, *args)), (~even, position_fields(18, *args))]).select("seq", "t", "payload")
    sent = nmea.sentence(F.col("payload"), F.lit(0), channel=F.when(even, "A").otherwise("B"))
    step, line = computed(step, {"sent": sent}), F.col("sent")
    time = F.col("t").cast("long").cast("string")
    return step.select("seq", nmea.with_tag(line, F.concat(F.lit("s:"), (F.col("seq") % 7).cast("string"), F.lit(",c:"), time)).alias("line"))


def other_lines(fixes: DataFrame) -> DataFrame:
    """(seq, line): every fix as class A (3) with a rate of turn, as class B with static data (19), or as part A or B of
    static data (24), by its number; every eleventh without a place, at 181 E 91 N."""
    u, turn = F.col("mmsi") - 219000000, F.col("seq") % 256 - 128
    nowhere = F.col("seq") % 11 == 0
    lat, lon = F.when(nowhere, 91.0).otherwise(F.col("lat")), F.when(nowhere, 181.0).otherwise(F.col("lon"))
    args = [F.col("mmsi"), F.col("sog"), F.col("cog"), lat, lon, F.col("t").cast("long") % 60]
    name, callsign, bow = F.concat(F.lit("SHIP "), u.cast("string")), F.concat(F.lit("K"), u.cast("string")), u % 500
    kinds = [
        position_fields(3, *args, rot=turn), extended_fields(*args, name, u % 100, bow),
        static_fields(0, F.col("mmsi"), name, u % 100, callsign, bow), static_fields(1, F.col("mmsi"), name, u % 100, callsign, bow),
    ]
    payload, fill = F.lit(None).cast("string"), F.lit(None).cast("int")
    step = fixes
    for k, fields in enumerate(kinds):
        n_bits = sum(n for _, n in fields)
        step = with_payload(step, [(F.col("seq") % 4 == k, fields)], f"_p{k}")
        payload, fill = F.when(F.col("seq") % 4 == k, F.col(f"_p{k}")).otherwise(payload), F.when(F.col("seq") % 4 == k, -n_bits % 6).otherwise(fill)
    step = computed(step.select("seq", payload.alias("payload"), fill.alias("fill")), {"sent": nmea.sentence(F.col("payload"), F.col("fill"))})
    return step.select("seq", F.col("sent").alias("line"))


def voyage_lines(fixes: DataFrame) -> DataFrame:
    """(seq, line): a two-part voyage report for every vessel, with the first part missing for every tenth."""
    u = F.col("mmsi") - 219000000
    vessels = fixes.select("mmsi").distinct().select("mmsi", u.alias("u"))
    own = voyage_fields(
        F.col("mmsi"), F.col("u") + 9000000, F.concat(F.lit("C"), F.col("u").cast("string")), F.concat(F.lit("VESSEL "), F.col("u").cast("string")),
        F.col("u") % 10 + 70, F.col("u") % 400, F.col("u") % 200 + 1, F.concat(F.lit("PORT "), (F.col("u") % 50).cast("string")),
    )
    parts = with_payload(vessels, [(F.lit(True), own)], "p").select("u", "p").withColumn("number", F.explode(F.array(F.lit(1), F.lit(2))))
    piece = F.when(F.col("number") == 1, F.substr("p", F.lit(1), F.lit(60))).otherwise(F.substr("p", F.lit(61)))
    line = nmea.sentence(piece, F.when(F.col("number") == 1, 0).otherwise(2), count=2, number=F.col("number"), seq=F.col("u") % 10)
    source = F.concat(F.lit("s:"), F.floor(F.col("u") / 10).cast("string"))
    kept = parts.filter("NOT (u % 10 = 9 AND number = 1)")
    return kept.select((F.col("u") * 2 + F.col("number")).alias("seq"), nmea.with_tag(line, source).alias("line"))


def csv_lines(fixes: DataFrame) -> DataFrame:
    """(seq, line) in the historical layout; every fiftieth row lacks its time's last digit."""
    time = F.date_format(F.timestamp_seconds(F.col("t").cast("long")), "dd/MM/yyyy HH:mm:ss")
    time = F.when(F.col("seq") % 50 == 49, F.substr(time, F.lit(1), F.lit(18))).otherwise(time)
    number = lambda c, n: F.when(F.col(c).isNull(), "").otherwise(F.format_string(f"%.{n}f", F.col(c)))
    return fixes.select(
        "seq",
        F.concat_ws(",", time, F.lit("Class A"), F.col("mmsi").cast("string"), number("lat", 6), number("lon", 6), number("sog", 1), number("cog", 1), F.lit("77"), F.lit("Cargo")).alias("line"),
    )


def json_lines(fixes: DataFrame) -> DataFrame:
    """(seq, line) as API records; every fiftieth has its number in quotes, some a `data:` before them."""
    time = F.concat(F.date_format(F.timestamp_seconds(F.col("t").cast("long")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    mmsi = F.col("mmsi").cast("string")
    shown = F.when(F.col("seq") % 50 == 49, F.concat(F.lit('"'), mmsi, F.lit('"'))).otherwise(mmsi)
    number = lambda c, n: F.when(F.col(c).isNull(), "null").otherwise(F.format_string(f"%.{n}f", F.col(c)))
    body = F.concat(
        F.lit('{"mmsi":'), shown, F.lit(',"msgtime":"'), time, F.lit('","latitude":'), number("lat", 6), F.lit(',"longitude":'), number("lon", 6),
        F.lit(',"speedOverGround":'), number("sog", 1), F.lit(',"courseOverGround":'), number("cog", 1), F.lit("}"),
    )
    return fixes.select("seq", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("data: "), body)).otherwise(body).alias("line"))
