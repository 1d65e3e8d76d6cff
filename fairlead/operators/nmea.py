"""NMEA 0183 sentences: lines to validated fields, or to the first error that a line has.

The checks stand in one CASE chain in a fixed order, so a line is counted under exactly one error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions import bits, times
from fairlead.functions.stages import computed

# Names of parse errors.
ERRORS = (
    "empty", "missing_start", "missing_checksum", "bad_checksum", "bad_tag_block", "wrong_field_count",
    "unsupported_sentence", "bad_fragment_fields", "bad_fill_bits", "bad_payload_char",
)


def checksum(body: Column) -> Column:
    """Exclusive or of all bytes."""
    characters = F.array_remove(F.split(body, ""), "")
    return F.aggregate(characters, F.lit(0), lambda acc, c: acc.bitwiseXOR(F.ascii(c)))


def hex_checksum(body: Column) -> Column:
    return F.lpad(F.hex(checksum(body)), 2, "0")


SUMMED = r"(?s)^(.*)\*([0-9A-Fa-f]{2})$"


def _split_sum(text: Column) -> tuple[Column, Column]:
    """(is there a checksum at the end, the body if it is right)."""
    body = F.regexp_extract(text, SUMMED, 1)
    right = checksum(body) == F.conv(F.regexp_extract(text, SUMMED, 2), 16, 10).cast("int")
    has = text.rlike(SUMMED)
    return has, F.when(has & right, body)


def tag_fields(body: Column) -> tuple[Column, Column]:
    """(source, unix_time) of a tag block's body: the last well-formed field of each kind wins."""
    parts = F.split(body, ",")

    def last(key: str, wanted: str) -> Column:
        own = F.filter(parts, lambda p: p.rlike(wanted))
        return F.substr(F.try_element_at(own, F.lit(-1)), F.lit(len(key) + 1))

    time = times.strict_int(last("c:", r"^c:-?[0-9]{1,18}$"))
    return last("s:", "^s:"), F.when(time > 100_000_000_000, F.floor(time / 1000)).otherwise(time)


def tag_time(line: Column) -> Column:
    """The time in a line's tag block, without parsing its sentence."""
    _, body = _split_sum(F.regexp_extract(F.trim(line), r"^\\([^\\]*)\\", 1))
    return tag_fields(body)[1]


def parse(lines: DataFrame) -> DataFrame:
    """Lines (with a column `line`) and their fields: error, or talker, own_ship, fragment_count, fragment_number,
    sequence_id, channel, payload, fill_bits, source, unix_time."""
    trimmed = F.regexp_replace(F.regexp_replace(F.col("line"), r"[\r\n \t]+$", ""), r"^[ \t]+", "")
    step = computed(lines, {"_line": trimmed})
    tagged = F.col("_line").startswith("\\")
    tag_body = F.when(tagged, F.regexp_extract("_line", r"^\\([^\\]*)\\", 1))
    closed = F.col("_line").rlike(r"^\\[^\\]*\\")
    rest = F.when(tagged, F.regexp_replace("_line", r"^\\[^\\]*\\", "")).otherwise(F.col("_line"))
    step = computed(step, {"_tag": tag_body, "_closed": ~tagged | closed, "_rest": rest})
    has, body = _split_sum(F.substr("_rest", F.lit(2)))
    step = computed(step, {"_tag": F.when(F.col("_closed"), _split_sum(F.col("_tag"))[1]), "_sum": has, "_body": body})
    step = computed(step, {"_tag_ok": ~tagged | F.col("_tag").isNotNull(), "_f": F.split("_body", ",", -1)})
    part = lambda i: F.get("_f", F.lit(i))
    step = computed(step, {"_count": times.strict_int(part(1)), "_number": times.strict_int(part(2)), "_seq": times.strict_int(part(3)), "_fill": times.strict_int(part(6))})
    wrong = lambda c: ~F.coalesce(c, F.lit(False))
    bad_fragment = (
        wrong(F.col("_count").between(1, 9)) | wrong(F.col("_number").between(1, 9)) | wrong(F.col("_number") <= F.col("_count"))
        | ((part(3) != "") & wrong(F.col("_seq").between(0, 9))) | (F.length(part(4)) > 1)
    )
    error = (
        F.when(F.col("_line") == "", "empty")
        .when(~F.col("_tag_ok"), "bad_tag_block")
        .when(~F.col("_rest").startswith("!"), "missing_start")
        .when(~F.col("_sum"), "missing_checksum")
        .when(F.col("_body").isNull(), "bad_checksum")
        .when(F.size("_f") != 7, "wrong_field_count")
        .when(~part(0).rlike("^.{2}VD[MO]$"), "unsupported_sentence")
        .when(bad_fragment, "bad_fragment_fields")
        .when(~part(5).rlike(f"^{bits.ARMOUR}*$"), "bad_payload_char")
        .when(wrong(F.col("_fill").between(0, 5)), "bad_fill_bits")
    )
    step = computed(step, {"error": error})
    good = lambda c: F.when(F.col("error").isNull(), c)
    source, unix_time = tag_fields(F.col("_tag"))
    return step.select(
        *lines.columns, "error",
        good(F.substr(part(0), F.lit(1), F.lit(2))).alias("talker"), good(part(0).endswith("VDO")).alias("own_ship"),
        good(F.col("_count")).cast("int").alias("fragment_count"), good(F.col("_number")).cast("int").alias("fragment_number"),
        good(F.col("_seq")).cast("int").alias("sequence_id"), good(F.nullif(part(4), F.lit(""))).alias("channel"),
        good(part(5)).alias("payload"), good(F.col("_fill")).cast("int").alias("fill_bits"),
        good(source).alias("source"), good(unix_time).alias("unix_time"),
    )


def sentence(payload: Column, fill: Column, talker: str = "AI", own: bool = False, count: Column | int = 1, number: Column | int = 1, seq: Column | str = "", channel: Column | str = "A") -> Column:
    """A line with a right checksum."""
    as_text = lambda c: (F.lit(c) if not isinstance(c, Column) else c).cast("string")
    body = F.concat_ws(",", F.lit(talker + ("VDO" if own else "VDM")), as_text(count), as_text(number), F.coalesce(as_text(seq), F.lit("")), F.coalesce(as_text(channel), F.lit("")), payload, fill.cast("string"))
    return F.concat(F.lit("!"), body, F.lit("*"), hex_checksum(body))


def with_tag(line: Column, body: Column) -> Column:
    """A line behind a tag block, unless it has one."""
    tagged = F.concat(F.lit("\\"), body, F.lit("*"), hex_checksum(body), F.lit("\\"), line)
    return F.when(line.startswith("\\"), line).otherwise(tagged)
