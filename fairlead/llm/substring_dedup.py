"""Exact substring deduplication by bucket-pointer refinement.

A byte goes if it is covered by a string of `LENGTH` bytes that also starts anywhere else, in the same text or another.
Suffixes are put into buckets by their first q = 8 bytes, as they are, and the buckets refined by sorting on the bucket
identifiers of later offsets, where refined identifiers are used again: 8, 16, 32, 64, 128 bytes deep, then LENGTH.

Sorting every suffix of a large corpus isn't affordable, so the work is narrowed first, without loss:

1. Rows are numbered and kept with their texts, once; all later steps read those numbers.
2. Each window of LENGTH bytes points to the least 64-byte gram in it, its anchor. Equal windows have equal anchors,
   and an anchor serves a stretch of about 70 windows. Only (gram, stretch, place) leaves the scan, some 30 bytes for
   70 of text, and is kept, so texts are scanned for anchors once.
3. Grams that occur once end here, by a pre-aggregated count and a semi join.
4. Stretches that occur twice as a whole are duplicated as a whole: again a count and a semi join.
5. What remains are the ends of duplicated passages: grams with different stretches around them. One of each different
   stretch is fetched, those of a gram meet, and bucket-pointer refinement finds the windows that are equal.
   A gram with more than `HOT` different stretches is refined in the open: its windows' identifiers at full depth are
   counted by a pre-aggregated group-by, so no task ever holds more than HOT stretches of a gram.

Skewed keys only meet counts, which are aggregated before the shuffle, and joins whose large partitions adaptive
execution splits. Stretches and windows of hot grams are told apart, within a gram, by XXH3 of 64 bits over their
bytes; what grams are is only where to look, so two that share a hash just meet.

Defined results: a null or empty text has 0 bytes, nothing removed and the hash of no bytes; texts shorter than LENGTH
are kept whole; equal texts of LENGTH bytes or more are removed from each other wholly, and so are rows that repeat; rows
are numbered by place, so null or repeated ids are rows of their own; ties between grams fall to the first; a very long
text is hashed in parts of `CHUNK` bytes, and held once, beside its spans merged to maximal runs, by the task that cuts
it; an empty table gives an empty result; other columns are not read, so their names may clash with ours.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions.stages import discard, durable

LENGTH, GRAM = 200, 64
#: Bytes of a suffix that its first bucket is named by.
Q = 8
#: Different stretches of a gram that one task refines.
HOT = 20_000
#: Bytes that are hashed, or refined, together.
CHUNK = 2_000_000


class Rolling:
    """64-bit hashes of substrings: polynomials modulo 2^64 in an odd base over random values of bytes."""

    def __init__(self) -> None:
        self.byte = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = 0x2545F4914F6CDD1D
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) < n + 1:
            size = n + 1 + n // 4
            inverse = pow(self.base, -1, 1 << 64)
            self.up, self.down = (
                np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (self.base, inverse)
            )
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.byte[data] * self.up[:n], dtype=np.uint64, out=total[1:])
        return total

    def grams(self, total: np.ndarray, n: int) -> np.ndarray:
        """Of all substrings of n bytes, by start."""
        return mixed((total[n:] - total[:-n]) * self.down[: len(total) - n])


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits, in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours: of the end of one block and the start of the next."""
    n = len(values) - width + 1
    blocks = np.concatenate([values, np.full(-len(values) % width, ~np.uint64(0))]).reshape(-1, width)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def chunks(rows: Iterator[tuple[int, bytes]], length: int, most: int = CHUNK) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (rid, offset, bytes) of about `most` bytes; longer texts are cut so that each window is in one part."""
    held, size = [], 0
    for rid, raw in rows:
        for at in range(0, max(0, len(raw) - length + 1), most):
            part = raw[at : at + most + length - 1]
            held.append((rid, at, part))
            size += len(part)
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def stretches(parts: list[tuple[int, int, bytes]], rolling: Rolling, length: int, gram: int) -> list[np.ndarray]:
    """Columns (gram, stretch, rid, place): hashes of an anchor and of the bytes of its windows with the anchor's place
    in them, the text, and where: first window << 9 | number of windows - 1."""
    import xxhash

    sizes = np.array([len(p) for _, _, p in parts])
    ends = np.cumsum(sizes)
    data = b"".join(p for _, _, p in parts)
    grams = rolling.grams(rolling.prefix(np.frombuffer(data, np.uint8)), gram)
    bits = np.uint64(int(len(grams)).bit_length())
    order = grams >> bits << bits | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_least(order, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    n = len(anchor)
    whole = np.ones(n, bool)  # windows that don't run into the next part
    for e in ends[:-1].tolist():
        whole[max(0, e - length + 1) : e] = False
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(new)
    stop = whole.copy()
    stop[:-1] &= ~whole[1:] | new[1:]
    last = np.flatnonzero(stop)
    at = np.searchsorted(ends, first, side="right")
    offset = first - (ends - sizes)[at] + np.array([o for _, o, _ in parts])[at]
    digest = xxhash.xxh3_64_intdigest
    stretch = np.fromiter(
        (digest(data[a:b], k) for a, b, k in zip(first.tolist(), (last + length).tolist(), (anchor[first] - first).tolist(), strict=True)),
        np.uint64, len(first),
    )
    rids = np.array([r for r, _, _ in parts], np.int64)[at]
    return [grams[anchor[first]].view(np.int64), stretch.view(np.int64), rids, offset << 9 | (last - first)]


def equal_windows(segments: list[bytes], length: int) -> np.ndarray:
    """Mask over the bytes of the segments laid end to end: where a window starts that starts elsewhere too.

    Bucket-pointer refinement: bucket[i] tells apart strings of `depth` bytes from i on; sorting those of shared
    buckets by (bucket[i], bucket[i + step]) makes it depth + step. Nothing is hashed.
    """
    sizes = np.array([len(s) for s in segments])
    end = np.repeat(np.cumsum(sizes), sizes)
    n, depth = len(end), min(Q, length)
    data = np.frombuffer(b"".join(segments), np.uint8)
    first = np.zeros(n, np.uint64)
    for k in range(depth):
        first[: n - k] = first[: n - k] << np.uint64(8) | data[k:]
    live = np.flatnonzero(np.arange(n) + depth <= end)
    bucket = np.full(n, -1, np.int64)
    live, bucket[live] = _refined(live, first[live])
    while depth < length and len(live):
        step = min(depth, length - depth)
        live = live[live + depth + step <= end[live]]
        live = live[bucket[live + step] >= 0]
        after = np.full(n, -1, np.int64)
        live, after[live] = _refined(live, bucket[live] * n + bucket[live + step])
        bucket, depth = after, depth + step
    return bucket >= 0


def _refined(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and keys -> the positions whose key another has, and a bucket number for each of those."""
    if not len(at):
        return at, at
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    alone = new & np.concatenate([new[1:], [True]])
    number = np.cumsum(new) - 1
    keep = ~alone
    place = np.argsort(order[keep], kind="stable")
    return at[order[keep]][place], number[keep][place]


def _arrow(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, doc_id, raw): every row with a number of its own, kept, so that however often and in whatever parts the
    rows are read again, a number means the same row."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw")
    return durable(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), raw))


def anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(gram, stretch, rid, place) of every stretch of windows with the same anchor; narrow."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        texts = ((r.as_py(), t.as_py()) for b in batches for r, t in zip(b["rid"], b["raw"], strict=True))
        for parts in chunks(texts, length):
            yield _arrow(stretches(parts, rolling, length, gram), ["gram", "stretch", "rid", "place"])

    return rows.mapInArrow(work, "gram long, stretch long, rid long, place long")


def _first(place: Column) -> Column:
    return F.shiftright(place, 9)


def _more(place: Column) -> Column:
    return place.bitwiseAND(511)


def _fetch(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows that stretches are wanted of, with `wanted`, an array of struct that is shorter than the text. All
    columns of rows are kept, here and wherever rows are read, so that every branch deals out the same frame: texts are
    shuffled once."""
    per_text = wanted.groupBy("rid").agg(F.collect_list(F.struct("gram", "place", "n")).alias("wanted"))
    return rows.join(per_text, "rid")


def _ends(rows: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """(rid, start, stop) of what is duplicated in stretches whose grams are shared by few."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, raw, wanted in zip(batch["rid"], batch["raw"], batch["wanted"], strict=True):
                raw, rid = raw.as_py(), rid.as_py()
                for w in wanted.as_py():
                    at = w["place"] >> 9
                    out.append((w["gram"], rid, at, w["n"] == 1, raw[at : at + (w["place"] & 511) + length]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield _arrow([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["gram", "rid", "at", "open", "segment"])

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= CHUNK and held[-1][0] != row[0]:
                    yield spans(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield spans(held)

    def spans(held: list[tuple]) -> pa.RecordBatch:
        hit = equal_windows([r[4] for r in held], length)
        sizes = np.array([len(r[4]) for r in held])
        hit &= np.repeat([r[3] for r in held], sizes)
        begin = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
        stop = np.flatnonzero(hit & ~np.concatenate([hit[1:], [False]])) + length
        ends = np.cumsum(sizes)
        of = np.searchsorted(ends, begin, side="right")
        shift = np.array([r[2] for r in held], np.int64)[of] - (ends - sizes)[of]
        return _arrow([np.array([r[1] for r in held], np.int64)[of], begin + shift, stop + shift], ["rid", "start", "stop"])

    schema = "gram long, rid long, at long, open boolean, segment binary"
    met = _fetch(rows, reps).mapInArrow(cut, schema).repartition("gram").sortWithinPartitions("gram")
    return met.mapInArrow(refine, "rid long, start long, stop long")


def _hot_ends(rows: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """The same for grams shared by many: every window by its identifier at full depth."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        for batch in batches:
            for rid, raw, wanted in zip(batch["rid"], batch["raw"], batch["wanted"], strict=True):
                raw = raw.as_py()
                for w in wanted.as_py():
                    at, n = w["place"] >> 9, (w["place"] & 511) + 1
                    ids = np.fromiter((digest(raw[k : k + length]) for k in range(at, at + n)), np.uint64, n).view(np.int64)
                    columns = [np.full(n, w["gram"]), ids, np.full(n, rid.as_py()), at + np.arange(n), np.full(n, w["n"] == 1)]
                    yield _arrow(columns, ["gram", "window", "rid", "start", "open"])

    schema = "gram long, window long, rid long, start long, open boolean"
    found = _fetch(rows, reps).mapInArrow(windows, schema)
    twice = found.groupBy("gram", "window").count().filter("count > 1")
    return found.filter("open").join(twice, ["gram", "window"], "left_semi").select("rid", "start", (F.col("start") + length).alias("stop"))


def duplicated(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(rid, start, stop) of stretches to remove, which may overlap, from (rid, raw)."""
    # counts are kept before they are joined with: a join right above an aggregation isn't split where a key is skewed
    every = durable(anchors(rows, length, gram))
    shared = durable(every.groupBy("gram").count().filter("count > 1").select("gram"))
    placed = durable(every.join(shared, "gram", "left_semi"))
    discard(every)
    kinds = durable(placed.groupBy("gram", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("rid", "place")).alias("rep")))
    again = kinds.filter("n > 1").select("gram", "stretch")
    place = F.col("place")
    whole = placed.join(again, ["gram", "stretch"], "left_semi").select(
        "rid", _first(place).alias("start"), (_first(place) + _more(place) + length).alias("stop")
    )
    whole = durable(maximal(whole))
    discard(placed)
    several = durable(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    reps = durable(kinds.join(several, "gram").select("gram", "kinds", "n", "rep.rid", "rep.place"))
    discard(kinds)
    few, many = reps.filter(F.col("kinds") <= hot), reps.filter(F.col("kinds") > hot)
    return whole.unionByName(_ends(rows, few, length)).unionByName(_hot_ends(rows, many, length))


def maximal(found: DataFrame) -> DataFrame:
    """(rid, start, stop) of maximal runs, disjoint and apart from each other."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64),) * 3
        for batch in batches:
            columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            rid, start, stop = (np.concatenate([h, c]) for h, c in zip(held, columns, strict=True))
            if not len(rid):
                continue
            new = np.concatenate([[True], rid[1:] != rid[:-1]])
            # the greatest stop so far within a row: stops of later rows are lifted above those of earlier ones
            lift = np.cumsum(new) * (int(stop.max()) + 1)
            upto = np.maximum.accumulate(stop + lift) - lift
            first = np.flatnonzero(new | np.concatenate([[True], start[1:] > upto[:-1]]))
            last = np.append(first[1:], len(rid)) - 1
            rid, start, stop = rid[first], start[first], upto[last]
            yield _arrow([rid[:-1], start[:-1], stop[:-1]], ["rid", "start", "stop"])  # the last run may go on
            held = rid[-1:], start[-1:], stop[-1:]
        if len(held[0]):
            yield _arrow(list(held), ["rid", "start", "stop"])

    return found.repartition("rid").sortWithinPartitions("rid", "start").mapInArrow(merge, "rid long, start long, stop long")


def cleaned(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text",
    with_rest: bool = False,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row; with_rest adds `kept`, the remaining bytes."""
    rows = numbered(docs, id_col, text_col)
    runs = maximal(duplicated(rows, length, gram, hot))
    found = runs.groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_rest

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, raw, spans in zip(batch["doc_id"], batch["raw"], batch["spans"], strict=True):
                raw = raw.as_py()
                rest, n_spans = without(raw, [(s["start"], s["stop"]) for s in spans.as_py() or ()])
                row = (doc.as_py(), len(raw), len(raw) - len(rest), n_spans, hashlib.sha256(rest).hexdigest())
                out.append((*row, rest) if with_rest else row)
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_rest
            yield _arrow([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_rest
    return rows.join(found, "rid", "left").mapInArrow(work, schema)


def without(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal runs that the spans make."""
    kept, at, runs = [], 0, 0
    for start, stop in sorted(spans):
        if start > at or not runs:
            kept.append(raw[at:start])
            runs += 1
        at = max(at, stop)
    kept.append(raw[at:])
    return b"".join(kept), runs


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document."""
    return cleaned(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLES: dict[str, str] = {}
