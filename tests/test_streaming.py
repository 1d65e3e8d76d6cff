import json
import math
import os
import random
import socket
import threading
import time

from pyspark.sql import functions as F
from test_traffic import FIXES, moored, steaming

from fairlead.functions import geo
from fairlead.operators import anomalies, risk, tracker
from fairlead.sources import tcp
from fairlead.sources.tcp import Framer, next_pause
from fairlead.streaming import live


def test_a_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = steaming(60) + steaming(60, mmsi=2, seq=500, north_m=40_000) + moored(30, vessels=3)
    rows.sort(key=lambda r: r[2])
    for k in range(3):
        part = rows[len(rows) * k // 3 : len(rows) * (k + 1) // 3]
        spark.createDataFrame(part, FIXES).coalesce(1).write.parquet(f"{tmp_path}/in-{k}")
    source = f"{tmp_path}/in-*"
    batch = spark.createDataFrame(rows, FIXES)
    live.run_to_end(live.track(live.read_fixes(spark, source)), f"{tmp_path}/tracks", f"{tmp_path}/c1")
    names = ["seq", "outcome", "updates", "sigma_m"]
    order = lambda df: sorted(map(tuple, df.select(*names).collect()))
    assert order(spark.read.parquet(f"{tmp_path}/tracks")) == order(tracker.track(batch))
    live.run_to_end(live.watch(live.read_fixes(spark, source)), f"{tmp_path}/flags", f"{tmp_path}/c2")
    kinds = lambda df: sorted((r.kind, r.mmsi, r.t) for r in df.collect())
    assert kinds(spark.read.parquet(f"{tmp_path}/flags")) == kinds(anomalies.per_vessel(batch))


def convoy(minutes=14):
    """Vessels on crossing and opposite courses, a report every 20 s, one of them silent for some minutes."""
    rows = []
    for m, (n, e, course) in enumerate([(0, 0, 0.0), (3000, 3000, 270.0), (9000, 0, 180.0), (2000, -4000, 90.0), (0, 300, 5.0)], 1):
        for k in range(3 * minutes):
            t, v = 1.7e9 + 20 * k + m, 10 * geo.KNOT_MS
            if m == 2 and 400 < 20 * k < 700:
                continue
            north, east = n + v * 20 * k * math.cos(math.radians(course)), e + v * 20 * k * math.sin(math.radians(course))
            rows.append((100 * m + k, m, t, 55 + north / geo.M_PER_DEG, 12 + east / (geo.M_PER_DEG * math.cos(math.radians(55))), 10.0, course, 10.0))
    return sorted(rows, key=lambda r: r[2])


def rows_of(df, *names, digits=6):
    return sorted(tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect())


def test_risk_by_minute_is_the_same_however_reports_come_in_batches(spark, tmp_path):
    rows = convoy()
    tracked = tracker.track(spark.createDataFrame(rows, FIXES)).cache()
    accepted = tracked.filter("outcome IN ('started', 'updated', 'restarted')")
    last = max(r[2] for r in rows) // 60 * 60
    whole = risk.at_risk(risk.tracked(accepted).filter(F.col("minute") <= last))
    expected, names = rows_of(whole, "minute", "mmsi_a", "mmsi_b", "type", "range_m", digits=3), ("minute", "mmsi_a", "mmsi_b", "type", "range_m")
    first = rows_of(risk.encounters(whole), "minute", "mmsi_a", "mmsi_b", "type")
    assert len(expected) > 10 and len(first) > 2
    # uneven batches, some of them empty; reports up to 40 s late come with a later batch
    rng, arrival = random.Random(2), {}
    for r in rows:
        arrival[r[0]] = r[2] + rng.choice((0, 0, 0, 40))
    edges = sorted(rng.uniform(rows[0][2], rows[-1][2]) for _ in range(5))
    deal = spark.createDataFrame([(seq, sum(t > e for e in edges)) for seq, t in arrival.items()], "seq long, deal int")
    batches = [tracked.join(deal.filter(F.col("deal") == k), "seq", "left_semi") for k in (0, 1, 2)] + [tracked.filter("false")] + [tracked.join(deal.filter(F.col("deal") == k), "seq", "left_semi") for k in (3, 4, 5)]
    sink = live.Live(f"{tmp_path}/live")
    for number, batch in enumerate(batches):
        sink(batch, number)
        if number in (1, 4):
            sink(batch, number)  # done again, as after a failure
    sink.close(spark, len(batches) - 1)
    found = spark.read.parquet(f"{tmp_path}/live/risks")
    assert rows_of(found, *names, digits=3) == expected
    new = spark.read.json(f"{tmp_path}/live/encounters")
    assert rows_of(new, "t", "mmsi_a", "mmsi_b", "type") == first
    messages = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/live/feed").collect()]
    assert messages and all(m["type"] == "update" for m in messages)
    assert {t[0] for m in messages for t in m["tracks"]} == {1, 2, 3, 4, 5} and all(m["totals"]["tracks"] <= 5 for m in messages)


def test_a_stream_drives_the_live_sink(spark, tmp_path):
    rows = convoy(8)
    for k in range(4):
        part = rows[len(rows) * k // 4 : len(rows) * (k + 1) // 4]
        spark.createDataFrame(part, FIXES).coalesce(1).write.parquet(f"{tmp_path}/in-{k}")
    sink, numbers = live.Live(f"{tmp_path}/live"), []

    def each(batch, number):
        numbers.append(number)
        sink(batch, number)

    stream = live.track(live.read_fixes(spark, f"{tmp_path}/in-*"))
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    sink.close(spark, max(numbers))
    accepted = tracker.track(spark.createDataFrame(rows, FIXES)).filter("outcome IN ('started', 'updated', 'restarted')")
    whole = risk.at_risk(risk.tracked(accepted).filter(F.col("minute") <= max(r[2] for r in rows) // 60 * 60))
    assert len(numbers) >= 4
    assert rows_of(spark.read.parquet(f"{tmp_path}/live/risks"), "minute", "mmsi_a", "mmsi_b") == rows_of(whole, "minute", "mmsi_a", "mmsi_b")


def test_flags_of_a_stream(spark, tmp_path):
    """Impossible speeds are a filter of the stream itself."""
    spark.createDataFrame([(1, 1, 5.0, 55.0, 12.0, 60.0, 1.0, 1.0), (2, 1, 6.0, 55.0, 12.0, 5.0, 1.0, 1.0)], FIXES).write.parquet(f"{tmp_path}/in")
    live.run_to_end(anomalies.impossible_speeds(live.read_fixes(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/c")
    assert [r.t for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [5.0]


def test_framer():
    f = Framer(10)
    assert f.feed(b"ab\r\ncd") == ["ab"] and f.feed(b"e\n\n\r\n") == ["cde"]
    assert f.feed(b"x" * 20) == [] and f.feed(b"yy\nok\n") == ["ok"] and f.too_long == 1


def test_pauses_grow_within_bounds():
    pause, rng = 0.5, random.Random(1)
    for _ in range(12):
        wait, after = next_pause(pause, rng)
        assert pause / 2 <= wait <= pause and after <= 30
        pause = after
    assert pause == 30


def wait_for(condition):
    for _ in range(200):
        if condition():
            return
        time.sleep(0.05)
    raise AssertionError("not in time")


def served(texts):
    """A port that sends one text for each connection."""
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        for text in texts:
            link, _ = server.accept()
            link.sendall(text)
            link.close()

    threading.Thread(target=serve, daemon=True).start()
    return server.getsockname()[1]


def test_a_receiver_reconnects_and_drops_the_oldest():
    r = tcp.SocketReceiver("127.0.0.1", served((b"one\ntwo\n", b"three\r\nfour\n")), 100, most=3)
    r.start()
    wait_for(lambda: r.held.next == 4)
    r.stop()
    assert [x[1] for x in r.held.between(0, 99)] == ["two", "three", "four"] and r.held.dropped == 1 and r.opened >= 2
    r.held.commit(3)
    assert [x[0] for x in r.held.between(0, 99)] == [3]
    assert tcp.TcpLines.name() == "tcp_lines" and tcp.PipeLines.name() == "pipe_lines"


def test_a_full_queue_makes_the_reader_wait(tmp_path):
    os.mkfifo(f"{tmp_path}/pipe")
    r = tcp.PipeReceiver(f"{tmp_path}/pipe", 100, most=2)
    r.start()
    with open(f"{tmp_path}/pipe", "wb") as pipe:
        pipe.write(b"a\nb\nc\nd\n")
    wait_for(lambda: r.held.next == 2)
    time.sleep(0.2)
    assert [x[1] for x in r.held.between(0, 99)] == ["a", "b"]
    r.held.commit(2)
    wait_for(lambda: r.held.next == 4)
    r.stop()
    assert [x[1] for x in r.held.between(0, 99)] == ["c", "d"] and r.held.dropped == 0


def test_offsets_of_a_restarted_receiver_lose_no_line():
    port = served((b"".join(b"old %d\n" % k for k in range(40)), b"".join(b"new %d\n" % k for k in range(50))))
    own = (tcp.SocketReceiver, "127.0.0.1", port, 100)
    reader = tcp.LineReader(*own)
    first = tcp.receiver(*own)
    wait_for(lambda: first.held.next >= 40)
    rows, offset = reader.read(reader.initialOffset())
    assert len(list(rows)) == 40 and offset["next"] == 40
    reader.commit(offset)
    first.stop()
    tcp._RECEIVERS.clear()  # the process began anew; Spark still has the offset of the old one
    port2 = served((b"".join(b"new %d\n" % k for k in range(50)),))
    own = (tcp.SocketReceiver, "127.0.0.1", port2, 100)
    reader, second = tcp.LineReader(*own), tcp.receiver(*own)
    wait_for(lambda: second.held.next >= 50)
    assert list(reader.readBetweenOffsets({"epoch": "", "next": 0}, offset)) == []
    rows, now = reader.read(offset)
    assert [r[1] for r in rows] == [f"new {k}" for k in range(50)] and now["next"] == 50
    assert len(list(reader.readBetweenOffsets(offset, now))) == 50
    reader.commit(now)
    second.stop()
    assert second.held.between(0, 99) == []
