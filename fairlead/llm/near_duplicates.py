"""Near-duplicates by SimHash and MinHash bands, and exact Jaccard similarity: one document of each group stays.

This is operator 6 where a corpus is cleaned. Its fingerprints, inverted index, tally and verification link documents
that differ in at most 4 bits, and those that such links lead to meet. That is not enough at this similarity: bits of a SimHash differ with probability acos(c) / pi, c
being the cosine of two shingle sets; at a Jaccard similarity of 0.8 that is 0.15, so two bytes agree with probability
0.27 and three with 0.02. An index of three byte positions then finds 22 % of such pairs in a word of 64 bits, and 0.9
of them only with ten words and 200 keys for each document, keys of 24 bits that unlike documents share as well. So
documents meet by least hashes too, and all that meets, in either way, is verified.

A document is the set of its shingles of five words, each a 64-bit hash. `BANDS` keys, each a hash of `ROWS` of its
`BANDS * ROWS` least values under different permutations, say where documents meet: two of Jaccard similarity s do
under some key with probability 1 - (1 - s^5)^24, which is 99.993 % at 0.8 and 99.9999 % at 0.85. Where documents
meet, their whole sets are compared, and pairs of 0.8 and more link, no others. So precision is exact (up to 64-bit
collisions of shingles), and a pair is lost only where it meets under no key and no links of fingerprints join it.

Equal sets are one entry, the row with the least id. Keys under which the same entries meet are compared once. A key's
entries are compared in the task that sorts them, and what leaves it is a spanning forest of the links, never all
pairs; a key with many entries is dealt in blocks as in `simhash`. Components come from alternating stars. Sets are
made of the documents that meet others only, and go to the tasks that compare them without being kept; tables of keys
are deleted once it is known who meets.

Rows are numbered durably and it is numbers that are kept, one of each component: the least id, null last, then the
least number. Texts are shuffled only where more rows than `MOST_SENT` meet others or are dropped.

Defined results: null and empty texts and those without words are copies of each other; fewer than five words are one
shingle; rows with null or repeated ids are rows like others, and of rows that repeat one stays; of equal ids the row
that was numbered first does; a very long text is a set of eight bytes for each word, held by the tasks it meets
others in; an empty table gives an empty result; columns are as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.functions.stages import discard
from fairlead.llm.graph import components, durable
from fairlead.llm.media import skinny
from fairlead.llm.simhash import dealt, fingerprint
from fairlead.llm.simhash import links as fingerprint_links

WIDTH = 5
#: Pairs link whose common shingles are at least LEAST_NUM / LEAST_DEN of all of theirs.
LEAST_NUM, LEAST_DEN = 4, 5
BANDS, ROWS = 24, 5
#: Entries of a key that one task compares at once.
RUN_LIMIT = 1024
#: Tables of up to so many row numbers are sent to every task; longer ones are joined by a shuffle.
MOST_SENT = 500_000

_draws = np.random.Generator(np.random.PCG64(2024))
FACTORS = _draws.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
MASKS = _draws.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A permutation of 64 bits that spreads every bit (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(raw: bytes) -> np.ndarray:
    """The sorted different hashes of a text's word shingles; words as in simhash.fingerprint."""
    import xxhash

    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - WIDTH + 1)
    width = min(WIDTH, len(words))
    hashes = np.full(n, width, np.uint64)
    for k in range(width):
        hashes = _mixed(hashes * STEP + each[k : k + n])
    return np.unique(hashes)


def keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set, one for each band; none of an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        part = (hashes[None, i : i + 4096] ^ MASKS[:, None]) * FACTORS[:, None]
        least = np.minimum(least, part.min(1))
    rows = least.reshape(BANDS, ROWS)
    found = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        found = _mixed(found * STEP + rows[:, k])
    return found.view(np.int64)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(raw.as_py()) for raw in batch.column("raw")]
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        found = pa.array([keys(s) for s in sets], pa.list_(pa.int64()))
        bits = np.array([fingerprint(raw.as_py()) for raw in batch.column("raw")], np.uint64).view(np.int64)
        kept = [batch.column(c) for c in ("row", "no_id", "id")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(digests, pa.binary()), found, pa.array(bits)], ["row", "no_id", "id", "digest", "keys", "bits"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = pa.array([shingles(raw.as_py()).tobytes() for raw in batch.column("raw")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("runs"), batch.column("id"), sets], ["runs", "node", "set"])


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Index pairs of sets that link, enough of them to connect whatever is linked; each member of a component is
    compared once with those that no component has reached yet."""
    found, unseen = [], np.arange(len(sets))
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(int(codes.max()) + 1, bool)
    while len(unseen) > 1:
        front, unseen = [int(unseen[0])], unseen[1:]
        while front and len(unseen):
            at = front.pop()
            own = codes[starts[at] : starts[at] + sizes[at]]
            mark[own] = True
            low = int(unseen[0])  # members before it are all reached
            common = np.add.reduceat(mark[codes[starts[low] :]], starts[low:] - starts[low], dtype=np.int64)[unseen - low]
            mark[own] = False
            hit = LEAST_DEN * common >= LEAST_NUM * (sizes[at] + sizes[unseen] - common)
            found += [(at, int(k)) for k in unseen[hit]]
            front.extend(unseen[hit].tolist())
            unseen = unseen[~hit]
    return found


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of runs of equal (key, deal), which may go on over batches."""

    def found(nodes, sets):
        pairs = [(nodes[a], nodes[b]) for a, b in forest(sets)] if len(nodes) > 1 else []
        a, b = ([p[k] for p in pairs] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    run, nodes, sets = None, [], []
    for batch in batches:
        for key, deal, node, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if run != (key, deal):
                if nodes:
                    yield found(nodes, sets)
                run, nodes, sets = (key, deal), [], []
            nodes.append(node)
            sets.append(np.frombuffer(raw, np.uint64))
    if nodes:
        yield found(nodes, sets)


def _sent(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= MOST_SENT else rows


def alike(entries: DataFrame) -> DataFrame:
    """(key, node) of (node, bits): entries whose fingerprints are equal or joined by links of operator 6 have one key."""
    held = durable(entries.select("node", "bits"))
    roots = durable(components(fingerprint_links(held.select(F.col("bits").alias("node")).distinct())))
    rooted = held.join(_sent(roots.withColumnRenamed("node", "at")), F.col("bits") == F.col("at"), "left")
    return durable(rooted.select(F.xxhash64(F.coalesce("root", "bits"), F.lit("bits")).alias("key"), "node"))


def meetings(entries: DataFrame) -> DataFrame:
    """(key, node), kept, from (node, keys, bits): under which keys entries meet others."""
    joined = alike(entries.filter(F.size("keys") > 0))  # an empty set is like no other
    each = entries.select(F.explode("keys").alias("key"), "node").unionByName(joined)
    meeting = each.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"))
    # kept before it is joined with: a join right above an aggregation isn't split where a key is large
    once = durable(meeting.filter("n > 1").groupBy("n", "who").agg(F.min("key").alias("key")).select("key"))
    met = durable(each.join(_sent(once), "key"))
    discard(joined)
    discard(once)
    return met


def compared(met: DataFrame, texts: DataFrame, run_limit: int = RUN_LIMIT) -> DataFrame:
    """(a, b), kept, from (key, node) and (id, raw): links of those that meet. A text's set is made where the text lies
    and goes from there to the runs that need it; it is neither kept nor shuffled before."""
    runs = durable(dealt(met, run_limit))
    of_each = durable(runs.groupBy(F.col("node").alias("id")).agg(F.collect_list(F.struct("key", "deal")).alias("runs")))
    few = runs.count() <= MOST_SENT
    sets = texts.join(F.broadcast(of_each) if few else of_each, "id").select("id", "raw", "runs")
    sets = sets.mapInArrow(_sets, "runs array<struct<key: long, deal: long>>, node long, set binary").select(F.inline("runs"), "node", "set")
    found = durable(sets.repartition("key", "deal").sortWithinPartitions("key", "deal", "node").mapInArrow(_links, "a long, b long"))
    discard(runs)
    discard(of_each)
    return found


def links(entries: DataFrame, texts: DataFrame, run_limit: int = RUN_LIMIT) -> DataFrame:
    """(a, b) from (node, keys, bits) of different sets and (id, raw), the texts by row number."""
    met = meetings(entries)
    found = compared(met, texts, run_limit)
    discard(met)
    return found


def dropped(docs: DataFrame, row: str, id_col: str, text_col: str, run_limit: int = RUN_LIMIT) -> DataFrame:
    """(row): the numbers of all rows but one of each component. Keys are deleted before sets are made."""
    texts = skinny(docs, row, text_col)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw")
    named = docs.select(F.col(row).alias("row"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), raw)
    kind = dict(named.dtypes)["id"]
    prints = durable(named.mapInArrow(_prints, f"row long, no_id boolean, id {kind}, digest binary, keys array<long>, bits long"))
    rank = F.struct("no_id", "id", "row")
    first = durable(prints.groupBy("digest").agg(F.min(rank).alias("first")).select("first.row"))
    copies = durable(prints.select("row").join(_sent(first), "row", "left_anti"))
    keyed = durable(prints.join(_sent(first), "row", "left_semi").drop("digest"))
    discard(prints)
    nodes = durable(keyed.select("row", "no_id", "id"))
    met = meetings(keyed.select(F.col("row").alias("node"), "keys", "bits"))
    discard(keyed)
    linked = compared(met, texts, run_limit)
    discard(met)
    roots = durable(components(linked))
    rooted = durable(nodes.join(_sent(roots), F.col("row") == F.col("node")).select("no_id", "id", "row", "root"))
    best = rooted.groupBy("root").agg(F.min(rank).alias("first")).select(F.col("first.row").alias("row"))
    others = rooted.select("row").join(best, "row", "left_anti")
    return copies.unionByName(others)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_limit: int = RUN_LIMIT) -> DataFrame:
    """One row of each group of copies, and all others."""
    row = "row_number"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    numbered = durable(docs.withColumn(row, F.monotonically_increasing_id()))
    gone = durable(dropped(numbered, row, id_col, text_col, run_limit)).withColumnRenamed("row", row)
    return numbered.join(_sent(gone), row, "left_anti").select(*(numbered[c] for c in docs.columns))
