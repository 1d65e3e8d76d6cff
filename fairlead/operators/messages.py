"""AIS messages: payload bits to one wide row, by a table of field layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions import bits
from fairlead.functions.stages import computed

# Least number of bits of each type that is decoded (24: by part), and where its fields lie.
NEEDED = {1: 143, 2: 143, 3: 143, 5: 302, 18: 139, 19: 301, 24: 40}
NEEDED_PART = {0: 160, 1: 162}
POSITION_A = {"sog": 50, "accuracy": 60, "lon": 61, "lat": 89, "cog": 116, "heading": 128, "utc_second": 137}
POSITION_B = {"sog": 46, "accuracy": 56, "lon": 57, "lat": 85, "cog": 112, "heading": 124, "utc_second": 133}
CLASS_A, CLASS_B = (1, 2, 3), (18, 19)
DIMS = "struct<to_bow:int,to_stern:int,to_port:int,to_starboard:int>"

FIELDS = (
    "type", "mmsi", "nav_status", "rot", "sog", "accuracy", "lat", "lon", "cog", "heading", "utc_second", "imo", "callsign",
    "name", "ship_type", "dims", "draught_m", "destination", "part",
)


def speed(raw: Column) -> Column:
    return F.when(raw != 1023, raw / 10.0)


def course(raw: Column) -> Column:
    return F.when(raw < 3600, raw / 10.0)


def heading(raw: Column) -> Column:
    return F.when(raw <= 359, raw.cast("int"))


def rate_of_turn(raw: Column) -> Column:
    """Degrees a minute; the three values that stand for none or for an unknown rate are null."""
    return F.when((raw != -128) & (F.abs(raw) != 127), F.signum(raw.cast("double")) * F.pow(raw / 4.733, F.lit(2.0)))


def place(lat_raw: Column, lon_raw: Column) -> tuple[Column, Column]:
    """Both or neither."""
    lat, lon = lat_raw / 600000.0, lon_raw / 600000.0
    inside = (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return F.when(inside, lat), F.when(inside, lon)


def dimensions(b: bits.Bits, at: int) -> Column:
    sizes = zip(("to_bow", "to_stern", "to_port", "to_starboard"), (at, at + 9, at + 18, at + 24), (9, 9, 6, 6), strict=True)
    return F.struct(*(b.unsigned(start, n).cast("int").alias(name) for name, start, n in sizes))


def _report(b: bits.Bits, layout: dict[str, int]) -> dict[str, Column]:
    lat, lon = place(b.signed(layout["lat"], 27), b.signed(layout["lon"], 28))
    return {
        "sog": speed(b.unsigned(layout["sog"], 10)),
        "accuracy": b.unsigned(layout["accuracy"], 1) == 1,
        "lat": lat,
        "lon": lon,
        "cog": course(b.unsigned(layout["cog"], 12)),
        "heading": heading(b.unsigned(layout["heading"], 9)),
        "utc_second": b.unsigned(layout["utc_second"], 6).cast("int"),
    }


#: Words that hold the longest message that is decoded.
N_WORDS = 8


def decode(sentences: DataFrame) -> DataFrame:
    """Whole sentences (payload, fill_bits) -> decode_error (`invalid`, `too_short`, `unknown_type`) or the fields."""
    step = computed(sentences, {"_n": F.length("payload") * 6 - F.col("fill_bits")})
    n = F.col("_n")
    step = computed(step, {f"_w{k}": w for k, w in enumerate(bits.words_of(F.col("payload"), n, N_WORDS))})
    b = bits.Bits(tuple(F.col(f"_w{k}") for k in range(N_WORDS)), n)
    step = computed(step, {"_type": b.checked(0, 6).cast("int"), "_part": b.checked(38, 2).cast("int")})
    kind, part = F.col("_type"), F.col("_part")
    needed = F.lit(38)
    for t, least in NEEDED.items():
        needed = F.when(kind == t, least).otherwise(needed)
    for p, least in NEEDED_PART.items():
        needed = F.when((kind == 24) & (part == p), least).otherwise(needed)
    error = (
        F.when(F.col("payload").isNull() | F.coalesce(n < 0, F.lit(True)), "invalid").when(n < 38, "too_short")
        .when((kind == 0) | (kind > 27), "unknown_type").when(n < needed, "too_short")
    )
    step = computed(step, {"decode_error": error})
    is_a, is_b = kind.isin(*CLASS_A), kind.isin(*CLASS_B)
    a, c = _report(b, POSITION_A), _report(b, POSITION_B)
    out = {name: F.when(is_a, a[name]).when(is_b, c[name]) for name in a}
    part_a, part_b = (kind == 24) & (part == 0), (kind == 24) & (part == 1)
    nothing = F.when((kind == 24), F.lit(""))  # parts 2 and 3 are empty records
    out |= {
        "type": kind,
        "mmsi": b.checked(8, 30),
        "nav_status": F.when(is_a, b.unsigned(38, 4).cast("int")),
        "rot": F.when(is_a, rate_of_turn(b.signed(42, 8))),
        "imo": F.when(kind == 5, F.nullif(b.unsigned(40, 30), F.lit(0).cast("long"))),
        "callsign": F.when(kind == 5, b.text(70, 7)).when(part_b, b.text(90, 7)).otherwise(nothing),
        "name": F.when(kind == 5, b.text(112, 20)).when(kind == 19, b.text(143, 20)).when(part_a, b.text(40, 20)).otherwise(nothing),
        "ship_type": F.when(kind == 5, b.unsigned(232, 8)).when(kind == 19, b.unsigned(263, 8)).when(part_b, b.unsigned(40, 8)).when(kind == 24, 0).cast("int"),
        "dims": F.when(kind == 5, dimensions(b, 240)).when(kind == 19, dimensions(b, 271)).when(part_b, dimensions(b, 132)),
        "draught_m": F.when(kind == 5, F.nullif(b.unsigned(294, 8), F.lit(0).cast("long")) / 10.0),
        "destination": F.when(kind == 5, b.text(302, 20, F.floor((n - 302) / 6))),
        "part": F.when(kind == 24, part),
    }
    good = F.col("decode_error").isNull()
    step = computed(step, {name: F.when(good, out[name]) for name in FIELDS})
    return step.select(*sentences.columns, "decode_error", *FIELDS)


def as_json(messages: DataFrame) -> DataFrame:
    """(seq, json): each decoded message as one JSON object with the fields of its type, nulls written out."""

    def number(c: Column) -> Column:
        """Ten significant digits at most, without trailing zeros."""
        size, shown = F.abs(c), F.format_string("%.9e", c)
        for k in range(-4, 10):
            shown = F.when(size >= 10.0**k, F.format_string(f"%.{9 - k}f", c)).otherwise(shown)
        bare = F.regexp_replace(shown, r"\.?0+(?=$|e)", "")
        return F.when(c.isNull(), "null").when(c == 0, "0").otherwise(bare)

    def member(name: str, value: Column) -> Column:
        return F.concat(F.lit(f',"{name}":'), value)

    def plain(name: str) -> Column:
        return member(name, F.coalesce(F.col(name).cast("string"), F.lit("null")))

    def quoted(name: str) -> Column:
        return member(name, F.substring_index(F.substr(F.to_json(F.struct(F.coalesce(F.col(name), F.lit("")).alias("v"))), F.lit(6)), "}", 1))

    position = [member("lat", number(F.col("lat"))), member("lon", number(F.col("lon"))), member("sog", number(F.col("sog"))), member("cog", number(F.col("cog"))), plain("heading")]
    size = F.when(F.col("dims").isNull(), F.lit(',"length_m":null,"beam_m":null')).otherwise(
        F.concat(F.lit(',"length_m":'), (F.col("dims.to_bow") + F.col("dims.to_stern")).cast("string"), F.lit(',"beam_m":'), (F.col("dims.to_port") + F.col("dims.to_starboard")).cast("string"))
    )
    head = F.concat(F.lit('{"type":'), F.col("type").cast("string"), F.lit(',"mmsi":'), F.col("mmsi").cast("string"), member("t", F.coalesce(F.col("unix_time").cast("string"), F.lit("null"))))
    kind = F.col("type")
    body = (
        F.when(kind.isin(*CLASS_A), F.concat(plain("nav_status"), *position, member("rot", number(F.col("rot")))))
        .when(kind == 18, F.concat(*position))
        .when(kind == 19, F.concat(*position, quoted("name"), plain("ship_type"), size))
        .when(kind == 5, F.concat(plain("imo"), quoted("callsign"), quoted("name"), plain("ship_type"), size, member("draught_m", number(F.col("draught_m"))), quoted("destination")))
        .when((kind == 24) & (F.col("part") == 0), F.concat(F.lit(',"part":"A"'), quoted("name")))
        .when(kind == 24, F.concat(F.lit(',"part":"B"'), plain("ship_type"), quoted("callsign"), size))
        .otherwise("")
    )
    return messages.filter("type IS NOT NULL").select("seq", F.concat(head, body, F.lit("}")).alias("json"))


def statistics(parsed: DataFrame, decoded: DataFrame) -> DataFrame:
    """(counter, n): lines, sentences_ok, messages, vessels, and one counter per error and per type that occurs.

    Lines, and the whole sentences that reassembly lets through (`decoded`), are each read once and aggregated before
    they are shuffled; vessels are counted as the groups of an aggregation by vessel.
    """
    by_error = parsed.groupBy("error").agg(F.count("*").alias("n"))
    named = F.when(F.col("error").isNull(), "sentences_ok").otherwise(F.concat(F.lit("parse_error_"), F.col("error")))
    lines = by_error.select(F.inline(_counts(F.lit("lines"), named)))
    seen = decoded.groupBy("mmsi", "type", "decode_error").agg(F.count("*").alias("n"))
    by_vessel = seen.groupBy("mmsi").agg(F.collect_list(F.struct("type", "decode_error", "n")).alias("kinds"))
    failed, kind = F.col("decode_error"), F.concat(F.lit("type_"), F.col("type").cast("string"))
    counters = _counts(F.when(failed.isNull(), "messages"), F.when(failed.isNull(), kind).otherwise(F.concat(F.lit("decode_"), failed)))
    each = by_vessel.select("mmsi", F.inline("kinds")).select(F.inline(counters))
    vessels = by_vessel.filter("mmsi IS NOT NULL").select(F.lit("vessels").alias("counter"), F.lit(1).cast("long").alias("n"))
    every = lines.unionByName(each).unionByName(vessels).filter("counter IS NOT NULL")
    none = decoded.sparkSession.createDataFrame([(c, 0) for c in ("lines", "sentences_ok", "messages", "vessels")], "counter string, n long")
    return every.unionByName(none).groupBy("counter").agg(F.sum("n").alias("n"))


def _counts(*counters: Column) -> Column:
    return F.array(*(F.struct(c.alias("counter"), F.col("n").alias("n")) for c in counters))
