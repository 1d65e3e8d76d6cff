import pytest
from pyspark.sql import functions as F

from fairlead.functions import bits, times
from fairlead.operators import fixes, messages, nmea, reassembly
from fairlead.sources import encode, readers, recorder, replay


def body(text, start="!"):
    total = 0
    for c in text:
        total ^= ord(c)
    return f"{start}{text}*{total:02X}"


def tagged(tag, line):
    return body(tag, "\\") + "\\" + line


def parsed(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, line string")
    return {r.seq: r for r in nmea.parse(df).collect()}


def test_first_error_wins(spark):
    good = "AIVDM,1,1,,A,16:H`P0P00OvQ4lPT5D00?w20000,0"
    line = tagged("s:7001,n:12,c:1580000000", body("BSVDM,1,1,,B,402<?P1v,0"))
    cases = {
        body(good): None, body(good) + "\r\n": None, "\t " + body(good): None, body("ABVDO,1,1,,A,16:H,0"): None, line: None, body(good)[:-2] + "g1": "missing_checksum",
        "": "empty", "\r\n \t": "empty", "$GPZDA,0": "missing_start", "!" + good: "missing_checksum", body(good)[:-1] + "~": "missing_checksum", body(good + ",9"): "wrong_field_count",
        body("AIVDQ,1,1,,A,16:H,0"): "unsupported_sentence", body("AIVDM,3,4,,A,16:H,0"): "bad_fragment_fields", body("AIVDM,1,0,,A,16:H,0"): "bad_fragment_fields", body("AIVDM,1, 1,,A,16:H,0"): "bad_fragment_fields",
        body("AIVDM,1,1,10,A,16:H,0"): "bad_fragment_fields", body("AIVDM,1,1,,AB,16:H,0"): "bad_fragment_fields", body("AIVDM,1,1,,A,16x~,0"): "bad_payload_char", body("AIVDM,1,1,,A,16:H,7"): "bad_fill_bits",
        body("AIVDM,1,1,,A,1_,9"): "bad_payload_char", "\\s:7*01\\!": "bad_tag_block", "\\s:7" + body(good): "bad_tag_block", "!" + good + "*" + ("00" if body(good)[-2:] != "00" else "01"): "bad_checksum",
    }
    found = parsed(spark, list(cases))
    assert {text: found[k].error for k, text in enumerate(cases)} == cases
    row = found[list(cases).index(line)]
    assert (row.source, row.unix_time, row.talker, row.channel, row.own_ship) == ("7001", 1580000000, "BS", "B", False)
    assert found[3].own_ship and found[3].talker == "AB"


def test_tag_times_in_milliseconds(spark):
    df = spark.createDataFrame([("c:1580000000987",), ("c:15,s:q,c:16",), ("c:later,s:",), ("g:2",)], "b string")
    rows = df.select(nmea.tag_fields(F.col("b"))[1].alias("t"), nmea.tag_fields(F.col("b"))[0].alias("s")).collect()
    assert [(r.t, r.s) for r in rows] == [(1580000000, None), (16, "q"), (None, ""), (None, None)]
    lines = spark.createDataFrame([(tagged("c:1580000000", "!anything"),), ("!none",), ("\\c:5*00\\!wrong",)], "line string")
    assert [r[0] for r in lines.select(nmea.tag_time(F.col("line"))).collect()] == [1580000000, None, None]


def value_of(text, start, length):
    return int(text[start : start + length].ljust(length, "0"), 2)


def test_fields_are_where_they_were_put(spark):
    """Against strings of bits: fields over the edges of words, signs, texts, bits past the end."""
    layout = [(5, 6), (-3, 9), (2**40 + 7, 50), (1, 1), (-(2**27), 28), (63, 6), (12345, 30), (-1, 8)]
    words, n = bits.packed([(F.lit(v), k) for v, k in layout] + bits.text_fields(F.lit("A [B]9?"), 7) + bits.text_fields(F.lit("LONG NAME OF TWENTY+"), 20))
    payload = spark.range(1).select(bits.payload_of(words, n)).first()[0]
    text = "".join(f"{bits.armour_characters().index(c):06b}" for c in payload)
    assert len(payload) == -(-n // 6) and set(text[n:]) <= {"0"}
    at = 0
    for v, k in layout:
        assert value_of(text, at, k) == v % (1 << k)
        at += k
    for cut in (n, n - 1, 61, 60, 59, 8):
        kept = -(-cut // 6)
        df = spark.createDataFrame([(payload[:kept], cut)], "p string, n int").withColumns({f"w{k}": w for k, w in enumerate(bits.words_of(F.col("p"), F.col("n"), 8))})
        b, shown = bits.Bits(tuple(F.col(f"w{k}") for k in range(8)), F.col("n")), text[:cut]
        asked = [(0, 6), (3, 30), (58, 4), (59, 1), (60, 28), (55, 50), (119, 2), (130, 30), (400, 8)]
        unsigned = df.select(*(b.unsigned(*x) for x in asked)).first()
        assert [*unsigned] == [value_of(shown, *x) for x in asked]
        signed = df.select(*(b.signed(*x) for x in asked)).first()
        assert [*signed] == [value_of(shown, s, k) - (1 << k) * (value_of(shown, s, k) >> (k - 1)) for s, k in asked]
        assert [*df.select(*(b.checked(*x) for x in asked)).first()] == [value_of(shown, *x) if sum(x) <= cut else None for x in asked]
    whole = spark.createDataFrame([(payload, n)], "p string, n int").withColumns({f"w{k}": w for k, w in enumerate(bits.words_of(F.col("p"), F.col("n"), 8))})
    b = bits.Bits(tuple(F.col(f"w{k}") for k in range(8)), F.col("n"))
    assert [*whole.select(b.text(at, 7), b.text(at + 42, 20), b.text(at + 42, 20, F.lit(4))).first()] == ["A [B]9?", "LONG NAME OF TWENTY+", "LONG"]


def made(df, fields, cut=0, k=0):
    """(seq, payload, fill_bits) of messages that lack their last bits."""
    words, n = bits.packed(fields)
    n -= cut
    short = F.substr(bits.payload_of(words, n + cut), F.lit(1), F.lit(-(-n // 6)))
    return df.select((F.col("seq") + k).alias("seq"), short.alias("payload"), F.lit(-n % 6).alias("fill_bits"))


def args():
    return [F.col(c) for c in ("mmsi", "sog", "cog", "lat", "lon", "s")]


@pytest.fixture(scope="module")
def reports(spark):
    rows = [(1, 230900001, 7.4, 211.3, 60.25, 24.75, 17), (2, 503900002, None, None, -41.5, -174.125, 59), (3, 366900003, 0.0, 0.0, 91.0, 181.0, 60)]
    return spark.createDataFrame(rows, "seq long, mmsi long, sog double, cog double, lat double, lon double, s long")


@pytest.mark.parametrize(("kind", "need"), [(1, 143), (2, 143), (3, 143), (18, 139)])
def test_reports(reports, kind, need):
    fields = encode.position_fields(kind, *args())
    rows = messages.decode(made(reports, fields).unionByName(made(reports, fields, 168 - need, 10)).unionByName(made(reports, fields, 169 - need, 20))).collect()
    found = {r.seq: r for r in rows}
    assert [found[k].decode_error for k in (21, 22, 23)] == ["too_short"] * 3
    for k in (1, 11):
        r = found[k]
        assert (r.mmsi, r.sog, r.cog, r.lat, r.lon, r.heading, r.type) == (230900001, 7.4, 211.3, 60.25, 24.75, 211, kind)
    assert (found[2].sog, found[2].cog, found[2].heading, found[2].lat, found[2].lon) == (None, None, None, -41.5, -174.125)
    assert (found[3].lat, found[3].lon, found[3].sog, found[1].utc_second, found[2].utc_second) == (None, None, 0.0, 17, 59)


def test_rates_of_turn(spark):
    df = spark.createDataFrame([(k, r) for k, r in enumerate((0, 9, -9, 126, 127, -127, -128))], "seq long, r long")
    places = [F.lit(x) for x in (219900001, 5.0, 10.0, 1.0, 2.0, 3)]
    found = {r.seq: r.rot for r in messages.decode(made(df, encode.position_fields(1, *places, rot=F.col("r")))).collect()}
    expected = [0.0, (9 / 4.733) ** 2, -((9 / 4.733) ** 2), (126 / 4.733) ** 2, None, None, None]
    assert [None if found[k] is None else round(found[k], 9) for k in range(7)] == [None if x is None else round(x, 9) for x in expected]


def test_static_data_of_class_b(reports):
    name, kind, callsign, bow = F.lit("TIDE & FOAM"), F.lit(36), F.lit("OJ4711"), F.lit(9)
    extended = {r.seq: r for r in messages.decode(made(reports, encode.extended_fields(*args(), name, kind, bow))).collect()}
    assert (extended[1].type, extended[1].name, extended[1].ship_type, extended[1].lat, extended[1].sog) == (19, "TIDE & FOAM", 36, 60.25, 7.4)
    assert tuple(extended[1].dims) == (9, 3, 1, 2) and extended[3].lat is None
    part_a = messages.decode(made(reports, encode.static_fields(0, F.col("mmsi"), name, kind, callsign, bow))).collect()[0]
    part_b = messages.decode(made(reports, encode.static_fields(1, F.col("mmsi"), name, kind, callsign, bow))).collect()[0]
    assert (part_a.part, part_a.name, part_a.callsign, part_a.dims) == (0, "TIDE & FOAM", "", None)
    assert (part_b.part, part_b.name, part_b.ship_type, part_b.callsign, tuple(part_b.dims)) == (1, "", 36, "OJ4711", (9, 3, 1, 2))


def test_other_types(spark):
    df = spark.createDataFrame([(0,)], "seq long")
    cases = [(0, 168), (28, 168), (4, 168), (24, 38), (24, 159), (24, 160), (5, 301), (9, 37), (27, 38)]
    found = []
    for k, (t, n) in enumerate(cases):
        found.append(made(df, encode.filled([(F.lit(t), 6), (F.lit(0), 2), (F.lit(219900001), 30)], max(n, 38)), max(n, 38) - n, k))
    rows = {r.seq: r for part in found for r in messages.decode(part).collect()}
    assert [rows[k].decode_error for k in range(9)] == ["unknown_type", "unknown_type", None, "too_short", "too_short", None, "too_short", "too_short", None]
    assert rows[2].mmsi == 219900001 and rows[2].lat is None
    bad = spark.createDataFrame([(1, "0", 7), (2, "", 0)], "seq long, payload string, fill_bits int")
    assert [r.decode_error for r in messages.decode(bad).orderBy("seq").collect()] == ["invalid", "too_short"]


def voyage(spark, order):
    """Fragments in an order: (key, number) of two-part voyage reports with their first 60 characters in part one."""
    fields = encode.voyage_fields(F.lit(230900001), F.lit(8100123), F.lit("OJXY7"), F.lit("NORTH BUOY"), F.lit(84), F.lit(211), F.lit(73), F.lit("PORT OF HAMINA 7"))
    payload = spark.range(1).select(bits.payload_of(*bits.packed(fields))).first()[0]
    lines = [body(f"AIVDM,2,{n},{k},A,{payload[:60] if n == 1 else payload[60:]},{0 if n == 1 else 2}") for k, n in order]
    return nmea.parse(spark.createDataFrame(list(enumerate(lines)), "seq long, line string"))


@pytest.mark.parametrize(
    ("order", "complete", "lost"),
    [([(1, 1), (1, 2)], 1, 0), ([(1, 2)], 0, 1), ([(1, 1), (2, 1), (1, 2), (2, 2)], 2, 0), ([(1, 1), (1, 1), (1, 2)], 1, 1), ([(1, 1), (1, 2), (1, 2)], 1, 1)],
)
def test_fragments(spark, order, complete, lost):
    p = voyage(spark, order)
    found = messages.decode(reassembly.reassemble(p)).collect()
    assert len(found) == complete and reassembly.dropped(p).first()[0] == lost
    assert len(reassembly.reassemble_bounded(p).collect()) == complete
    assert sorted(reassembly.sentences(p.select("seq", "line")).collect()) == sorted(reassembly.reassemble(p).collect())
    for r in found:
        assert (r.imo, r.callsign, r.name, r.ship_type, r.dims.to_bow, r.draught_m, r.destination) == (8100123, "OJXY7", "NORTH BUOY", 84, 211, 7.3, "PORT OF HAMINA 7")


def test_the_oldest_pending_gives_way(spark):
    p = voyage(spark, [(1, 1), (2, 1), (3, 1), (1, 2), (2, 2), (3, 2)])
    assert reassembly.reassemble_bounded(p, 2).count() == 2 and reassembly.reassemble(p).count() == 3


NOON = 1_710_504_000.0  # 2024-03-15 12:00 UTC


def test_times(spark):
    iso = {"2024-03-15T12:00:00Z": NOON, "2024-03-15 12:00:00+00:00": NOON, "2024-03-15T17:30:00+05:30": NOON, "2024-03-15T08:15:00-03:45": NOON,
           "2024-03-15T12:00:00.125Z": NOON + 0.125, "2024-03-15T12:00:00.1234567891+00:00": NOON + 0.123456789, "2024-03-15T12:00:60Z": NOON + 60, "2024-02-30T12:00:00Z": NOON - 14 * 86400,
           "2024-03-15T12:00:00": None, "2024-00-15T12:00:00Z": None, "2024-03-15T12:00:00.Z": None, "2024-03-15T12:00:00+0530": None, "15-03-2024T12:00:00Z": None,
           "2024-03-15T24:00:00Z": None, "2024-03-15T12:00:00+24:00": None, "": None, "2024-03-15T12:00:00Z ": None}
    df = spark.createDataFrame([(k,) for k in iso], "s string")
    assert {r.s: r.t for r in df.select("s", times.iso_time(F.col("s")).alias("t")).collect()} == iso
    csv = {"15/03/2024 12:00:00": NOON, "30/02/2024 12:00:00": NOON - 14 * 86400, "15/13/2024 12:00:00": None, "15/03/2024 25:00:00": None, "5/03/2024 12:00:00": None, "15/03/2024T12:00:00": None}
    df = spark.createDataFrame([(k,) for k in csv], "s string")
    assert {r.s: r.t for r in df.select("s", times.csv_time(F.col("s")).alias("t")).collect()} == csv


def test_csv_rows(spark):
    good = "15/03/2024 12:00:00,Class B,230900001,60.250000,24.750000,7.4,211.3,210,Sailing"
    rows = [good, good.replace("7.4", "200.0"), good.replace("7.4", ""), "time,class,number", good.replace("230900001", "no number"), good.replace("60.25", "-90.5"), "", good.replace("60.250000", "NaN"), good.replace("230900001", "-5")]
    found = {r.seq: r for r in fixes.from_csv(spark.createDataFrame(list(enumerate(rows)), "seq long, line string")).collect()}
    assert (found[0].t, found[0].sog, found[0].cog, found[0].ship_type, found[0].reject) == (NOON, 7.4, 211.3, "Sailing", None)
    assert [(found[k].sog, found[k].cog, found[k].reject) for k in (1, 2)] == [(None, None, None)] * 2
    assert all(found[k].reject == "invalid" for k in range(3, 9))


def test_json_rows(spark):
    good = '{"mmsi":230900001,"name":"X","msgtime":"2024-03-15T12:00:00Z","latitude":60.25,"longitude":24.75,"speedOverGround":7.4,"courseOverGround":211}'
    rows = [good, "data:   " + good, good.replace('"longitude":24.75,', ""), good.replace("7.4", "102.4"), good + "}", '["a"]', good.replace("230900001", '"230900001"'),
            good.replace("230900001", "230900001.25"), good.replace("60.25", "-95"), good.replace("2024-03-15T12:00:00Z", "soon"), "", "{", good.replace("60.25", '"60.25"'), good.replace("211", "null"), good + "," + good, good + good]
    found = {r.seq: r for r in fixes.from_json(spark.createDataFrame(list(enumerate(rows)), "seq long, line string")).collect()}
    assert [found[k].reject for k in range(16)] == [None, None, "no_position", None, *["invalid"] * 8, "no_position", None, "invalid", "invalid"]
    assert (found[0].t, found[0].sog, found[0].cog, found[3].sog, found[3].cog, found[13].sog) == (NOON, 7.4, 211.0, None, None, None)


def test_framing_and_replay(spark):
    chunks = spark.createDataFrame([(1, "ab\r\n\n\r\ncd\n" + "x" * 30 + "\nlast")], "seq long, chunk string")
    assert [r.line for r in readers.framed(chunks, 20).orderBy("place").collect()] == ["ab", "cd", "last"]

    def due(ts, speed, gap):
        df = spark.createDataFrame(list(enumerate(ts)), "seq long, t double")
        return [r.offset_s for r in replay.schedule(df, speed, gap).orderBy("seq").collect()]

    assert due([40.0, 44.0, 60.0], 4, 60) == [0.0, 1.0, 5.0]
    assert due([7.0, 907.0, 910.0, 1000.0], 1, 30) == [0.0, 30.0, 33.0, 63.0]
    assert due([50.0, 57.0, 53.0, None, 58.0], 1, 60) == [0.0, 7.0, 7.0, 7.0, 8.0]
    assert due([50.0, 57.0], 0, 60) == [0.0, 0.0]


def test_recording(spark, tmp_path):
    df = spark.createDataFrame([("!A", 86400), (r"\c:1*xx\!B", 1710511199)], "line string, received_unix long")
    names = [r[0] for r in df.select(recorder.file_name(F.col("received_unix"))).collect()]
    assert names == ["ais-19700102-00.nmea", "ais-20240315-13.nmea"]
    recorder.record(df, str(tmp_path))
    lines = {r.value for r in spark.read.text(str(tmp_path)).collect()}
    assert lines == {tagged("c:86400", "!A"), r"\c:1*xx\!B"}
    assert readers.read_lines(spark, str(tmp_path)).count() == 2 == readers.read_lines(spark, str(tmp_path), keep_bytes=True).count()


def test_tables_for_a_console(spark):
    report = spark.createDataFrame([("gap", 1200, 3.25, None), ("jump", 7, None, True)], "kind string, n long, hours double, late boolean")
    assert recorder.markdown(report).split("\n") == ["| kind | n | hours | late |", "| --- | ---: | ---: | --- |", "| gap | 1,200 | 3.2 | - |", "| jump | 7 | - | True |"]
    assert recorder.markdown(report, 1).count("\n") == 2
