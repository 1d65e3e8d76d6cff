"""URL filter: host rules, then a ratio of two character language models, calibrated on held-out URLs.

Rules with a host and a path prefix decide what they fit, the longest one winning. URLs that no rule fits are judged
as whole strings, scheme, query and fragment included, by two variable-order Markov models over a small alphabet, one of accepted and one of rejected URLs: a character's
probability after a context of two is interpolated with those after shorter contexts (Witten and Bell), and a context
seen less than `MIN_CONTEXT` times is passed over for the next shorter one. The score is the difference of
log-likelihoods per character; the threshold is the edge of a score bin that best separates held-out labelled URLs.

The labelled URLs are those that a rule decides, all of them. Whatever their number, counts have at most
`SIZE` ** 3 = 54,872 cells for each model, so the ratio table is one array of that many doubles, which reaches the
scan as a scalar subquery; the histogram for the threshold has at most 2 * 401 rows. No row of the table is shuffled.

Defined results: a null URL or one without `://` has an empty host and path and fits no rule; the models judge its own
characters, of a null URL the empty text; without labelled URLs of both kinds every score is compared with 0, and ties
are allowed; where cuts separate held-out URLs equally well, the nearest to 0 is taken, then the greater; a very long
URL is one array of its characters; repeated rows are judged each for itself; an empty table gives an empty result; other
columns are not read, so their names may clash with ours.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlead.llm.quality import bind


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: What a character is to the models; any digit is 0, anything else `~`, and `^` stands before and after a text.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0.-/:?=&#_~^"
#: Characters that are taken for others: capitals for small letters, digits for 0.
PLAIN_OF, PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"
SIZE = len(ALPHABET)
EDGE, OTHER = SIZE - 1, SIZE - 2
MIN_CONTEXT = 4
#: First hex digits of MD5(url) that hold a labelled URL back for the threshold: 3 of 16.
HELD_OUT = ("0", "1", "2")
#: Bins of the score, per unit, and the outermost bin.
BINS, LAST_BIN = 20, 200


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def cells(text: Column) -> Column:
    """Array with a number for each character and the end: those of the two characters before it and its own."""
    plain = F.translate(text, PLAIN_OF, PLAIN)
    codes = F.transform(
        F.array_remove(F.split(plain, ""), ""),
        lambda c: F.when(F.locate("~", c) + F.locate("^", c) > 0, OTHER)
        .when(F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c) - 1)
        .otherwise(OTHER),
    )
    whole = F.concat(F.array(F.lit(EDGE), F.lit(EDGE)), codes, F.array(F.lit(EDGE)))
    return bind(
        whole,
        lambda a: F.transform(
            F.sequence(F.lit(2), F.size(a) - 1),
            lambda i: (F.get(a, i - 2) * SIZE + F.get(a, i - 1)) * SIZE + F.get(a, i),
        ),
    )


def _counts(labelled: DataFrame) -> DataFrame:
    """(cell, allow, block): how often each cell occurs in URLs of either kind."""
    each = labelled.select("verdict", F.explode("cells").alias("cell"))
    kinds = (F.sum((F.col("verdict") == kind).cast("long")).alias(kind) for kind in ("allow", "block"))
    return each.groupBy("cell").agg(*kinds)


def _smoothed(grid: DataFrame, counts: DataFrame, kind: str) -> DataFrame:
    """(cell, p_<kind>) for every cell of the grid: the interpolated probability of its last symbol."""
    cell = F.col("cell")
    n = F.coalesce(F.col(kind), F.lit(0)).cast("double")
    full = grid.join(F.broadcast(counts), "cell", "left").select("cell", n.alias("n3"))
    pair, one = Window.partitionBy(cell % (SIZE * SIZE)), Window.partitionBy(cell % SIZE)
    after2 = Window.partitionBy(F.floor(cell / SIZE))
    after1 = Window.partitionBy(F.floor(cell / SIZE) % SIZE)
    full = full.select(
        "cell", "n3", F.sum("n3").over(pair).alias("n2"), F.sum("n3").over(one).alias("n1"),
        F.sum("n3").over(after2).alias("of3"), F.sum((F.col("n3") > 0).cast("double")).over(after2).alias("kinds3"),
        F.sum("n3").over(after1).alias("of2"), F.sum("n3").over(Window.partitionBy()).alias("of1"),
    )
    # a pair is repeated in SIZE cells of its context, one for each symbol before it
    full = full.withColumn("kinds2", F.sum((F.col("n2") > 0).cast("double")).over(after1) / SIZE)
    p1 = (F.col("n1") + 1) / (F.col("of1") + SIZE)
    mixed = lambda n, of, kinds, p: F.when(of >= MIN_CONTEXT, (n + kinds * p) / (of + kinds)).otherwise(p)
    full = full.withColumn("p1", p1)
    full = full.withColumn("p2", mixed(F.col("n2"), F.col("of2"), F.col("kinds2"), F.col("p1")))
    p3 = mixed(F.col("n3"), F.col("of3"), F.col("kinds3"), F.col("p2"))
    return full.select("cell", p3.alias(f"p_{kind}"))


def log_ratios(labelled: DataFrame) -> DataFrame:
    """One row, one array: the log ratio accepted / rejected of every cell, from (verdict, cells)."""
    counts = _counts(labelled)
    # fixed sizes: SIZE ** 3 cells in one task, where every window finds its rows without a shuffle
    grid = labelled.sparkSession.range(0, SIZE**3, 1, 1).withColumnRenamed("id", "cell")
    both = _smoothed(grid, counts, "allow").join(_smoothed(grid, counts, "block"), "cell")
    ratio = F.log("p_allow") - F.log("p_block")
    ordered = F.array_sort(F.collect_list(F.struct("cell", ratio.alias("w"))))
    return both.agg(F.transform(ordered, lambda s: s["w"]).alias("ratios"))


def score(cells_col: Column, ratios: Column) -> Column:
    """Mean log ratio over an array of cells."""
    total = bind(ratios, lambda w: F.aggregate(cells_col, F.lit(0.0), lambda acc, c: acc + F.get(w, c)))
    return total / F.size(cells_col)


def threshold(scored: DataFrame) -> DataFrame:
    """One row, one double: the cut between neighbouring bins, half-way where bins between them are empty, with the
    greatest sum of both kinds' hit rates, the nearest to 0 of equals; 0 where a kind is missing. From (verdict, score)."""
    edge = F.greatest(F.least(F.floor(F.col("score") * BINS), F.lit(LAST_BIN)), F.lit(-LAST_BIN))
    kinds = (F.sum((F.col("verdict") == kind).cast("long")).alias(kind) for kind in ("allow", "block"))
    bins = scored.groupBy(edge.alias("bin")).agg(*kinds)
    up = Window.orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    down = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = bins.select(
        "bin",
        F.sum("allow").over(up).alias("kept"), F.coalesce(F.sum("block").over(down), F.lit(0)).alias("dropped"),
        F.sum("allow").over(every).alias("allows"), F.sum("block").over(every).alias("blocks"),
        ((F.col("bin") + F.coalesce(F.lag("bin").over(Window.orderBy("bin")) + 1, F.col("bin"))) / 2).alias("cut"),
    )
    gain = F.col("kept") * F.col("blocks") + F.col("dropped") * F.col("allows")
    best = F.max(F.struct(gain.alias("gain"), (-F.abs("cut")).alias("near"), F.col("cut")))
    both = (F.max("allows") > 0) & (F.max("blocks") > 0)
    return ranked.agg(F.when(both, best["cut"] / BINS).otherwise(0.0).cast("double").alias("threshold"))


def parsed(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, url, host, path, ruled, cells)."""
    parts = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"),
        host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"),
    )
    whole = F.coalesce(F.col("url"), F.lit(""))
    return parts.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("ruled"), cells(whole).alias("cells"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for every row."""
    rows = parsed(pages, rules, id_col, url_col)
    labelled = rows.filter("ruled IS NOT NULL").select("url", F.col("ruled.verdict").alias("verdict"), "cells")
    held = F.substring(F.md5("url"), 1, 1).isin(*HELD_OUT)
    ratios = log_ratios(labelled.filter(~held))
    scored = labelled.filter(held).withColumn("ratios", ratios.scalar())
    cut = threshold(scored.select("verdict", score(F.col("cells"), F.col("ratios")).alias("score")))
    by_method = F.when(score(F.col("cells"), F.col("ratios")) >= cut.scalar(), "allow").otherwise("block")
    return rows.withColumn("ratios", ratios.scalar()).select(
        F.col("id").alias(id_col), "host", "path", F.col("ruled.rule").alias("rule"),
        F.coalesce(F.col("ruled.verdict"), by_method).alias("verdict"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _rule_sql(what: str) -> str:
    cases = (
        f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{getattr(r, what)}'"
        for r in sorted(RULES, key=lambda r: -len(r.text))
    )
    return f"CASE {' '.join(cases)} END"


def _smoothed_sql(kind: str) -> str:
    mixed = lambda n, of, kinds, p: f"CASE WHEN {of} >= {MIN_CONTEXT} THEN ({n} + {kinds} * {p}) / ({of} + {kinds}) ELSE {p} END"
    return f"""
{kind}_n AS (SELECT cell, CAST(coalesce({kind}, 0) AS DOUBLE) AS n3 FROM grid LEFT JOIN counts USING (cell)),
{kind}_w AS (SELECT cell, n3, sum(n3) OVER (PARTITION BY cell % {SIZE**2}) AS n2, sum(n3) OVER (PARTITION BY cell % {SIZE}) AS n1,
   sum(n3) OVER (PARTITION BY cell // {SIZE}) AS of3, sum(CAST(n3 > 0 AS DOUBLE)) OVER (PARTITION BY cell // {SIZE}) AS kinds3,
   sum(n3) OVER (PARTITION BY cell // {SIZE} % {SIZE}) AS of2, sum(n3) OVER () AS of1 FROM {kind}_n),
{kind}_p AS (SELECT *, sum(CAST(n2 > 0 AS DOUBLE)) OVER (PARTITION BY cell // {SIZE} % {SIZE}) / {SIZE} AS kinds2, (n1 + 1) / (of1 + {SIZE}) AS p1 FROM {kind}_w),
{kind}_q AS (SELECT *, {mixed("n2", "of2", "kinds2", "p1")} AS p2 FROM {kind}_p),
{kind}_r AS (SELECT cell, {mixed("n3", "of3", "kinds3", "p2")} AS p FROM {kind}_q)"""


_CODE_SQL = f"CASE WHEN c IN ('~', '^') OR instr('{ALPHABET}', c) = 0 THEN {OTHER} ELSE instr('{ALPHABET}', c) - 1 END"
ORACLES = {
    "op1_url_filter": rf"""
WITH parts AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, {_rule_sql("text")} AS rule, {_rule_sql("verdict")} AS ruling,
            list_concat([{EDGE}, {EDGE}], list_transform(string_split(translate(coalesce(url, ''), '{PLAIN_OF}', '{PLAIN}'), ''), lambda c: {_CODE_SQL}), [{EDGE}]) AS codes FROM parts),
coded AS (SELECT *, list_transform(range(3, len(codes) + 1), lambda i: (codes[i - 2] * {SIZE} + codes[i - 1]) * {SIZE} + codes[i]) AS cells,
            substr(md5(url), 1, 1) IN ({", ".join(f"'{d}'" for d in HELD_OUT)}) AS held FROM ruled),
counts AS (SELECT cell, count(*) FILTER (WHERE ruling = 'allow') AS allow, count(*) FILTER (WHERE ruling = 'block') AS block
           FROM (SELECT ruling, unnest(cells) AS cell FROM coded WHERE ruling IS NOT NULL AND NOT held) GROUP BY cell),
grid AS (SELECT range AS cell FROM range({SIZE**3})), {_smoothed_sql("allow")}, {_smoothed_sql("block")},
ratios AS (SELECT list(ln(a.p) - ln(b.p) ORDER BY cell) AS w FROM allow_r a JOIN block_r b USING (cell)),
scored AS (SELECT *, list_sum(list_transform(cells, lambda c: w[c + 1])) / len(cells) AS score FROM coded, ratios),
bins AS (SELECT greatest(least(floor(score * {BINS}), {LAST_BIN}), -{LAST_BIN}) AS bin, count(*) FILTER (WHERE ruling = 'allow') AS allow, count(*) FILTER (WHERE ruling = 'block') AS block
         FROM scored WHERE ruling IS NOT NULL AND held GROUP BY bin),
ranked AS (SELECT bin, sum(allow) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS kept,
             coalesce(sum(block) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dropped, sum(allow) OVER () AS allows, sum(block) OVER () AS blocks,
             (bin + coalesce(lag(bin) OVER (ORDER BY bin) + 1, bin)) / 2 AS middle FROM bins),
cut AS (SELECT coalesce((SELECT middle / {BINS} FROM ranked WHERE allows > 0 AND blocks > 0 ORDER BY kept * blocks + dropped * allows DESC, abs(middle), middle DESC LIMIT 1), 0) AS threshold)
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict FROM scored, cut"""
}
QUERIES = {"op1_url_filter": op1_url_filter}
