"""SimHash near-duplicates by an inverted index on positional bytes, with count filtering.

Fingerprints of 64 bits that differ in at most 4 bits agree in at least 4 of their 8 bytes, position by position. The
index is keyed by three positions and their bytes. Twenty triples of positions are enough for any four agreeing
positions to contain one of them, so each pair in question meets under some key. Where fingerprints meet, the
agreeing bytes of a pair are tallied, pairs below four dropped, and the others verified by their differing bits.

Equal fingerprints are one entry. A key's entries are compared in the task that sorts them, and what leaves it is a
spanning forest of the links found, never all pairs. A key with more than `RUN_LIMIT` entries is dealt in blocks: every
two blocks meet in a task of their own, so no task holds more than two blocks of a key, and no pair is missed.
Components come from alternating stars over the links, durably; nothing is collected on the driver.

This is exact for pairs that differ in few bits. Texts whose five-word shingles are 0.8 similar differ in 10 of 64 bits
on average, which three agreeing bytes can't find reliably; see `near_duplicates` for those.

Defined results: a null or empty text has fingerprint zero and links like any other; fewer than four words are one
shingle; a bit that is set in exactly half of the hashes is 0; a null id has a fingerprint and a component, but is never
a component's id unless all its ids are null; repeated rows are each returned; a very long text is held once, and its
shingles are hashed 65,536 at a time; an empty table gives an empty result; other columns are not read, so their names
may clash with ours.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm.graph import components, durable
from fairlead.llm.media import skinny


#: Words of a shingle, seed of its hash, and what linked fingerprints agree and differ in.
WIDTH, SEED = 4, 42
MIN_BYTES, MAX_BITS = 4, 4
#: Entries of a key that one task compares at once.
RUN_LIMIT = 65_536
#: Keys with fewer entries are compared across the whole batch at once, by distance in the sorted order.
SHORT_RUN = 16


def triples() -> list[tuple[int, int, int]]:
    """Triples of the 8 positions such that any four positions contain one: the positions lie in three groups on a
    circle, and a triple lies in one group, or two of it in a group and one in the next."""
    groups = ((0, 1, 2), (3, 4, 5), (6, 7))
    found = [t for g in groups for t in combinations(g, 3)]
    for k, g in enumerate(groups):
        found += [(*two, one) for two in combinations(g, 2) for one in groups[(k + 1) % 3]]
    return found


def fingerprint(raw: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """64 bits; bit i is set if it is in over half of the hashes of the text's word shingles."""
    import xxhash

    words = raw.lower().split()  # both know ASCII only, and split at exactly the six white characters
    if not words:
        return 0
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    n = max(1, len(words) - width + 1)
    starts, stops = [0, *ends][:n], ends[min(width, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65_536):
        part = zip(starts[i : i + 65_536], stops[i : i + 65_536], strict=False)
        hashes = np.array([digest(text[a : b - 1], seed) for a, b in part], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node) for every row; node is the fingerprint as a signed long. Narrow."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(raw.as_py()) for raw in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "node"])

    return skinny(docs, id_col, text_col).mapInArrow(work, "id long, node long")


def index(nodes: DataFrame) -> DataFrame:
    """(key, node): an entry under each triple of positions."""
    byte = lambda p: F.shiftrightunsigned("node", 8 * p).bitwiseAND(255)
    keys = [
        sum((F.shiftleft(byte(p), 8 * i) for i, p in enumerate(t)), F.lit(k).cast("long") * (1 << 24)) for k, t in enumerate(triples())
    ]
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "node")


def dealt(entries: DataFrame, run_limit: int = RUN_LIMIT) -> DataFrame:
    """Entries with a column `deal`; those that meet have the same key and deal. Keys of up to run_limit entries have
    deal 0; of others, every two of b blocks share a deal."""
    hot = entries.groupBy("key").count().filter(F.col("count") > run_limit)
    hot = hot.select("key", F.ceil(2 * F.col("count") / run_limit).cast("long").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    deals = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda other: F.least(other, own) * F.col("blocks") + F.greatest(other, own) + 1,
    )
    cold = F.array(F.lit(0).cast("long"))
    deal = F.explode(F.when(F.col("blocks").isNull(), cold).otherwise(deals)).alias("deal")
    return entries.join(hot, "key", "left").select("key", deal, *(c for c in entries.columns if c != "key"))


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where fingerprints agree in enough bytes, then differ in few enough bits."""
    differ = a ^ b
    tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    found = tally >= MIN_BYTES
    found[found] = np.bitwise_count(differ[found]) <= MAX_BITS
    return found


def _forest(fps: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(first member, other members) of each component within a run of different fingerprints.

    Each member is compared once with those that no component has reached yet.
    """
    found, unseen = [], np.arange(len(fps))
    while len(unseen) > 1:
        root, unseen = int(unseen[0]), unseen[1:]
        front, own = [root], []
        while front and len(unseen):
            hit = near(fps[unseen], fps[front.pop()])
            own.append(unseen[hit])
            front.extend(unseen[hit].tolist())
            unseen = unseen[~hit]
        found.append((root, np.concatenate(own) if own else np.zeros(0, np.int64)))
    return found


def _links(run: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of links among entries sorted by run; run is the number of each."""
    first = np.flatnonzero(np.diff(run, prepend=run[0] - 1))
    sizes = np.diff(first, append=len(run))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = np.flatnonzero(np.repeat(sizes <= SHORT_RUN, sizes))
    for d in range(1, int(sizes[sizes <= SHORT_RUN].max(initial=1))):
        at = at[at + d < len(run)]
        at = at[run[at] == run[at + d]]
        hit = at[near(fps[at], fps[at + d])]
        a.append(hit)
        b.append(hit + d)
    for i in np.flatnonzero(sizes > SHORT_RUN):
        for root, others in _forest(fps[first[i] : first[i] + sizes[i]]):
            a.append(np.full(len(others), first[i] + root))
            b.append(first[i] + others)
    return np.concatenate(a), np.concatenate(b)


def links(nodes: DataFrame, run_limit: int = RUN_LIMIT) -> DataFrame:
    """(a, b): links between different nodes, enough of them to connect whatever is linked. From distinct (node)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_run, kept = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        number, last = 0, None

        def found(run, fps):
            a, b = _links(run, fps)
            return pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, deal, node = (np.asarray(c) for c in batch.columns)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (deal[1:] != deal[:-1])
            new[0] = last != (key[0], deal[0])
            run, last = number + np.cumsum(new), (key[-1], deal[-1])
            number = int(run[-1])
            kept_run, kept = np.concatenate([kept_run, run]), np.concatenate([kept, node.view(np.uint64)])
            done = kept_run < number  # the last run may go on
            if done.any():
                yield found(kept_run[done], kept[done])
                kept_run, kept = kept_run[~done], kept[~done]
        if len(kept):
            yield found(kept_run, kept)

    meeting = dealt(index(nodes), run_limit).repartition("key", "deal").sortWithinPartitions("key", "deal", "node")
    return meeting.mapInArrow(work, "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_limit: int = RUN_LIMIT) -> DataFrame:
    """(id, node, component_id) for every row; component_id is the least id that links lead to."""
    prints = durable(fingerprints(docs, id_col, text_col))
    entries = durable(prints.groupBy("node").agg(F.min("id").alias("least")))
    roots = components(links(entries.select("node"), run_limit)).withColumnRenamed("node", "at")
    rooted = entries.join(roots, F.col("node") == F.col("at"), "left").select(
        "node", F.coalesce("root", "node").alias("root"), "least"
    )
    # kept before it is joined with: a join right above an aggregation isn't split where a component is large
    least = durable(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    by_node = rooted.select("node", "root").join(least, "root").drop("root")
    return prints.join(by_node, "node").select("id", "node", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6_simhash}
ORACLES: dict[str, str] = {}
