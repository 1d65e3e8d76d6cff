"""Reassembly of messages that span several sentences.

Fragments of a message share (source, sequence id, channel, count). Within such a key a first fragment starts a new
island, and later fragments are taken in order of arrival as long as each carries the next number; others are dropped
without disturbing what is pending. A complete message takes fill bits, time and channel from its last fragment.

`reassemble` works on all keys in parallel and lets a pending message live until its key starts anew.
`reassemble_bounded` adds a limit to the messages pending at once, which makes the whole stream one sequence: it is for
one receiver's stream, not for an archive of many.
"""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.operators import nmea

KEY = ["key_source", "key_seq", "key_channel", "fragment_count"]
OUT = "seq long, payload string, fill_bits int, source string, unix_time long, channel string, talker string, own_ship boolean"
_NAMES = [part.split()[0] for part in OUT.split(", ")]


def _keyed(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error IS NULL AND fragment_count > 1").select(
        F.coalesce("source", F.lit("")).alias("key_source"), F.coalesce("sequence_id", F.lit(-1)).alias("key_seq"),
        F.coalesce("channel", F.lit("")).alias("key_channel"), "fragment_count", "fragment_number",
        *(n for n in _NAMES),
    )


def _taken(parts: Column) -> Column:
    """Struct (n, payload, last): the greedy run 1, 2, 3, ... in an island's fragments."""
    last = F.struct(*(F.get(parts, F.lit(0))[n].alias(n) for n in _NAMES))
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("payload"), last.alias("last"))

    def step(acc: Column, p: Column) -> Column:
        fits = p["fragment_number"] == acc["n"] + 1
        return F.struct(
            F.when(fits, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            F.when(fits, F.concat(acc["payload"], p["payload"])).otherwise(acc["payload"]).alias("payload"),
            F.when(fits, F.struct(*(p[n].alias(n) for n in _NAMES))).otherwise(acc["last"]).alias("last"),
        )

    return F.aggregate(parts, start, step)


def islands(parsed: DataFrame) -> DataFrame:
    """One row per island: its key, number of fragments, and what the greedy run took."""
    by_key = Window.partitionBy(*KEY).orderBy("seq")
    marked = _keyed(parsed).withColumn("island", F.sum((F.col("fragment_number") == 1).cast("int")).over(by_key))
    part = F.struct("seq", "fragment_number", *(n for n in _NAMES if n != "seq"))
    grouped = marked.groupBy(*KEY, "island").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return grouped.select(*KEY, "island", F.size("parts").alias("fragments"), _taken(F.col("parts")).alias("taken"))


def _whole(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error IS NULL AND fragment_count = 1").select(*_NAMES)


def reassemble(parsed: DataFrame) -> DataFrame:
    """Whole sentences (seq of the last fragment, payload, fill_bits, source, unix_time, channel, talker, own_ship)."""
    return _whole(parsed).unionByName(_joined(parsed))


def _joined(parsed: DataFrame) -> DataFrame:
    done = islands(parsed).filter(F.col("taken.n") == F.col("fragment_count"))
    return done.select(*(F.col("taken.payload").alias(n) if n == "payload" else F.col(f"taken.last.{n}").alias(n) for n in _NAMES))


#: A line that may hold one of several fragments; whatever else parses holds a whole message.
SEVERAL = r"^[ \t]*(\\[^\\]*\\)?!..VD[MO],0*[2-9],"


def sentences(lines: DataFrame) -> DataFrame:
    """What reassemble gives, from lines: which lines can hold fragments shows before they are parsed, so each line is
    parsed once, in the branch that it belongs to."""
    several = F.coalesce(F.col("line").rlike(SEVERAL), F.lit(False))
    return _whole(nmea.parse(lines.filter(~several))).unionByName(_joined(nmea.parse(lines.filter(several))))


def dropped(parsed: DataFrame) -> DataFrame:
    """One row (fragments_dropped): fragments that are in no message."""
    used = F.when(F.col("taken.n") == F.col("fragment_count"), F.col("fragment_count")).otherwise(0)
    return islands(parsed).agg(F.coalesce(F.sum(F.col("fragments") - used), F.lit(0)).alias("fragments_dropped"))


class Pending:
    """Fragments that wait for their next, the oldest first; the state of one stream."""

    def __init__(self, most: int) -> None:
        self.most, self.held, self.dropped = most, OrderedDict(), 0

    def feed(self, key: tuple, number: int, count: int, payload: str) -> str | None:
        """The whole payload where this fragment completes it."""
        if number == 1:
            self.dropped += len(self.held.pop(key, ()))
            if len(self.held) >= self.most:
                self.dropped += len(self.held.popitem(last=False)[1])
            self.held[key] = [payload]
            return None
        parts = self.held.get(key)
        if parts is None or len(parts) + 1 != number:
            self.dropped += 1
            return None
        parts.append(payload)
        return "".join(self.held.pop(key)) if number == count else None


def reassemble_bounded(parsed: DataFrame, most: int = 256) -> DataFrame:
    """As reassemble, with at most `most` messages pending in the stream: the oldest gives way."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        pending, out = Pending(most), []
        for row in rows.sort_values("seq").itertuples(index=False):
            key = (row.key_source, row.key_seq, row.key_channel, row.fragment_count)
            payload = pending.feed(key, row.fragment_number, row.fragment_count, row.payload)
            if payload is not None:
                out.append({n: payload if n == "payload" else getattr(row, n) for n in _NAMES})
        return pd.DataFrame(out, columns=_NAMES)

    fragments = _keyed(parsed).groupBy(F.lit("stream").alias("stream")).applyInPandas(fold, OUT)
    return _whole(parsed).unionByName(fragments)
