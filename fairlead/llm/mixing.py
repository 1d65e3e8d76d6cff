"""Mixing sources to target weights: hash-random keys, sorted ranges, prefix sums of sizes, exact cuts.

Sources in code point order (null last) weigh 3, 1, 2, 3, ... and share 150 % of all words; a source's target stops at
twice its own size and what it can't take goes to the others by weight. A target of more than one source size means
whole epochs plus a cut through a random order of the source.

The random order comes from MD5 of a seed, the row's id and its text, so reruns and retried tasks agree. Its first hex
digits deal a source into `RANGES` ranges of near-equal size, so even a source with most of the rows is sorted and summed
by many tasks; the prefix sum within a range is a window, the offsets of ranges are a second window over one row per
range, and only ids, keys and sizes are ever shuffled, after rows that are equal in all of them are counted. Texts are
scanned once. Sources are ranked by running sums over sorted ranges, so there may be many.

Defined results: a null text has size 0; a null source is a source of its own; null ids are ids like others; rows of the
same id and text are interchangeable, so the rows as a whole are defined though not which copy is cut; `mix` takes
exactly as many of them as the plan; a very long text is one row, which the cut may go through; a source of size 0 has
target 0; an empty table gives an empty result; other columns are carried by `mix`, whatever their names, and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlead.functions.stages import durable, running
from fairlead.llm.quality import words_of

WEIGHTS = (3, 1, 2)
#: Ranges of keys within a source; a power of 16, as hex digits name them.
RANGES = 4096
SEED = "mix-1"
#: Targets together are SHARE_NUM / SHARE_DEN of all sizes, each at most MAX_EPOCHS times its source's.
SHARE_NUM, SHARE_DEN, MAX_EPOCHS = 3, 2, 2
GROUP = ["source_null", "source_key"]
#: Cuts of up to so many sources, some 100 bytes each, are sent to every task; more are joined by a shuffle.
MOST_SENT = 50_000


def key_of(id_col: Column, text: Column, seed: str = SEED) -> Column:
    """32 hex digits, uniform over different rows and the same on every run."""
    own = F.coalesce(id_col.cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), own, F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """(source_null, source_key, key, id, size, copies, part), one row for rows of the same id and text; kept."""
    skinny = docs.select(
        F.col(source_col).isNull().alias("source_null"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source_key"),
        key_of(F.col(id_col), F.col(text_col), seed).alias("key"),
        F.col(id_col).alias("id"),
        F.size(words_of(F.col(text_col))).cast("long").alias("size"),
    )
    counted = skinny.groupBy(*GROUP, "key", "id", "size").agg(F.count("*").alias("copies"))
    return durable(counted.withColumn("part", F.substring("key", 1, len(f"{RANGES:x}") - 1)))


def targets(per_range: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source_null, source_key, source_size, target) for each source.

    With sources ordered by the level cap / weight at which they fill up, the common level is the greatest of
    (budget - caps before) / (weights from here on): it rises while sources fill up and falls afterwards.
    """
    sizes = per_range.groupBy(*GROUP).agg(F.sum("size").alias("source_size"))
    ranked = running(sizes, GROUP, {"rank": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    cap = MAX_EPOCHS * F.col("source_size")
    weighed = ranked.withColumn("weight", weight).withColumn("fills_at", cap / F.col("weight"))
    level = ["fills_at", *GROUP]
    filling = running(weighed, level, {"caps": cap, "weights": F.col("weight").cast("long")})
    total = filling.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all_weights"))
    met = filling.join(F.broadcast(total))
    onward = F.col("all_weights") - F.col("weights")
    at = (SHARE_NUM * F.col("total") - SHARE_DEN * F.col("caps")).cast("double") / (SHARE_DEN * onward).cast("double")
    common = met.agg(F.max(at).alias("common"))
    target = F.least(cap.cast("double"), F.col("common") * F.col("weight"))
    return filling.join(F.broadcast(common)).select(*GROUP, "source_size", target.alias("target"))


def placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """(source_null, source_key, key, id, size, copies, source_size, target, epochs, room): `room` is what is left of the
    source's words, beyond whole epochs, where this row's first copy starts; it may be below 0."""
    rows = keyed(docs, id_col, text_col, source_col, seed)
    weight = F.col("size") * F.col("copies")
    in_range = Window.partitionBy(*GROUP, "part").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*GROUP).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_range = rows.groupBy(*GROUP, "part").agg(F.sum(weight).alias("size"))
    offsets = per_range.withColumn("offset", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    ranges = offsets.drop("size").join(targets(per_range), GROUP)
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0)
    room = budget - whole * F.col("source_size") - (F.col("offset") + F.col("upto") - weight)
    return rows.withColumn("upto", F.sum(weight).over(in_range)).join(ranges, [*GROUP, "part"]).select(
        *GROUP, "key", "id", "size", "copies", "source_size", "target", whole.cast("int").alias("epochs"), room.alias("room")
    )


def plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED
) -> DataFrame:
    """(id, source_null, source_key, key, size, source_size, target, taken, epochs, more) for every row.

    A source's words taken are its target's whole words exactly: every document once for each whole epoch, and once
    more in the random order until the rest is used up, where the last document is taken in part.
    """
    rows = placed(docs, id_col, text_col, source_col, seed)
    each = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    part = F.least(F.greatest(F.col("room") - F.col("copy") * F.col("size"), F.lit(0)), F.col("size"))
    more = (part > 0) & (2 * part >= F.col("size"))
    return each.select(
        "id", *GROUP, "key", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
        "epochs", more.alias("more"),
    )


def cuts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED
) -> DataFrame:
    """(source_null, source_key, epochs, last, some, copies) for each source: a document is taken `epochs` times, and
    once more if its key is before `last` (null: none); of the `copies` rows at `last`, `some` are. The document that
    the cut goes through is taken if half of it fits."""
    rows = placed(docs, id_col, text_col, source_col, seed).filter("size > 0")
    room = F.greatest(F.col("room"), F.lit(0))
    fit = F.least(F.col("copies"), F.floor(room / F.col("size")))
    half = (fit < F.col("copies")) & (2 * (room - fit * F.col("size")) >= F.col("size"))
    cut = F.struct(F.col("key"), (fit + half.cast("long")).alias("some"), F.col("copies"))
    last = F.max(F.when(cut["some"] > 0, cut))
    found = rows.groupBy(*GROUP).agg(F.max("epochs").alias("epochs"), last.alias("last"))
    return found.select(*GROUP, "epochs", F.col("last.key").alias("last"), "last.some", "last.copies")


def some_of(rows: DataFrame, groups: list[str], some: str) -> DataFrame:
    """`some` of the rows of each group; rows are numbered durably, and counted by the tasks that numbered them."""
    number, deal, n, before = (unused(rows, f"mix_{c}") for c in ("number", "deal", "n", "before"))
    numbered = durable(rows.withColumn(number, F.monotonically_increasing_id()))
    numbered = numbered.withColumn(deal, F.shiftright(number, 33))
    earlier = Window.partitionBy(*groups).orderBy(deal).rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy(*groups, deal).agg(F.count("*").alias(n))
    counts = durable(counts.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).drop(n))
    rank = F.row_number().over(Window.partitionBy(*groups, deal).orderBy(number))
    ranked = numbered.withColumn(n, rank).join(counts, [*groups, deal])
    return ranked.filter(F.col(n) + F.col(before) <= F.col(some)).select(*rows.columns)


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the frame has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED
) -> DataFrame:
    """The mix as whole documents with all their columns, repeated ones in as many rows.

    A source's cut is one place in its order, which its rows are compared with, so texts aren't shuffled while the cuts
    are few enough to be sent; their number is counted first. Only where a cut falls among copies they are numbered.
    """
    cut = durable(cuts(docs, id_col, text_col, source_col, seed))
    among = cut.filter("some < copies").count()
    if cut.count() <= MOST_SENT:
        cut = F.broadcast(cut)
    names = {c: unused(docs, f"mix_{c}") for c in cut.columns}
    cut = cut.withColumnsRenamed(names)
    source = docs[source_col]
    same = (source.isNull() == F.col(names["source_null"])) & (F.coalesce(source, F.lit("")) == F.col(names["source_key"]))
    key, last = key_of(docs[id_col], docs[text_col], seed), F.col(names["last"])
    has_words = F.coalesce(docs[text_col].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    split = (F.col(names["some"]) < F.col(names["copies"])) & (key == last)
    more = F.coalesce(has_words & (key <= last) & ~split, F.lit(False)).cast("int")
    copy = unused(docs, "mix_copy")
    joined = docs.join(cut, same, "left")
    found = joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.coalesce(F.col(names["epochs"]), F.lit(0)) + more)))
    found = found.select(*(docs[c] for c in docs.columns))
    if not among:
        return found
    tied = joined.filter(split).select(*(docs[c] for c in docs.columns), *(F.col(names[c]) for c in (*GROUP, "some")))
    taken = some_of(tied, [names[c] for c in GROUP], names["some"])
    return found.unionByName(taken.select(*docs.columns))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    planned = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return planned.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


#: SQL for the plan over a relation `docs` of doc_id, text and source.
PLANNED_SQL = rf"""
sized AS (SELECT doc_id, source IS NULL AS source_null, coalesce(source, '') AS source_key,
            md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key,
            CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM docs),
sources AS (SELECT source_null, source_key, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY ALL),
weighed AS (SELECT *, ([{", ".join(map(str, WEIGHTS))}])[1 + (row_number() OVER (ORDER BY source_null, source_key) - 1) % {len(WEIGHTS)}] AS weight FROM sources),
levels AS (SELECT *, CAST({SHARE_NUM} * sum(source_size) OVER () - {SHARE_DEN} * coalesce(sum({MAX_EPOCHS} * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / CAST({SHARE_DEN} * sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
           FROM weighed WINDOW w AS (ORDER BY {MAX_EPOCHS} * source_size / CAST(weight AS DOUBLE), source_null, source_key)),
aimed AS (SELECT source_null, source_key, source_size, least(CAST({MAX_EPOCHS} * source_size AS DOUBLE), max(level) OVER () * weight) AS target FROM levels),
summed AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source_null, source_key ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM sized),
budgeted AS (SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole,
               CAST(floor(target) AS BIGINT) AS budget FROM summed s JOIN aimed a USING (source_null, source_key)),
planned AS (SELECT *, least(greatest(budget - whole * source_size - (upto - size), 0), size) AS part FROM budgeted)"""

QUERIES = {"op10_mixing": op10_mixing}
ORACLES = {
    "op10_mixing": f"""WITH docs AS (SELECT doc_id, text, source FROM documents), {PLANNED_SQL}
SELECT doc_id, size, source_size, target, CAST(whole * size + part AS BIGINT) AS taken FROM planned"""
}
