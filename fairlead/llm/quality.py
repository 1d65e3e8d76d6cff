"""Quality rules: one table of thresholds compiled into one projection.

Everything a rule looks at is a column expression over the text, so a whole table is judged in a single scan without
a shuffle and without user functions. A rule is a row of `RULES`: a ratio and the closed interval it has to lie in.

Defined results: a null or empty text has no words and fails the base rule; a null id is carried through; repeated
rows are judged each for itself; a measure that ties with a threshold passes; a very long text is judged whole, by arrays
of its words and of a hash for each; an empty table gives an empty result; other columns of the input are not read by
`judge` and passed on by `keep`, so their names may clash with ours.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
SHOUTS = r"[!?]"
STOP_WORDS = tuple(
    "a an and are as at be by for from in is it of on or that the this to was with "
    "der die das den dem des ein eine einen ist mit nicht sich und von zu auf im für "
    "le la les de du et en est que qui dans il pour un une au pas sur "
    "el los las y por con del se no su es una lo al".split()
)


@dataclass(frozen=True)
class Rule:
    """A ratio of two measures that has to lie in [low, high]; where the lower measure is 0 the rule is passed."""

    name: str
    over: str
    under: str
    low: float = float("-inf")
    high: float = float("inf")


#: The threshold table.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.1),
    Rule("shouts_per_word", "n_shouts", "n_words", high=0.5),
    Rule("stop_word_share", "n_stop_words", "n_words", low=0.05),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.4),
)
#: What rules can compare.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_stop_words")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: a lambda's variable isn't inlined as a column's definition may be."""
    return F.transform(F.array(value), body).getItem(0)


def words_of(text: Column) -> Column:
    """The maximal runs of characters other than space and the controls 9 to 13."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more in the array, first occurrences included.

    Windows are compared by 64-bit hash. Texts without any repeated window, most of them, stop after a hash-set test;
    in the others windows are sorted by (hash, position) so that equal ones are neighbours.
    """

    def covered(found: Column) -> Column:
        step = lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")
        )
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(found, start, step, lambda acc: acc["n"])

    def among(order: Column) -> Column:
        hash_at = lambda k: F.get(order, k)["h"]
        twice = lambda k: F.coalesce(hash_at(k) == hash_at(k - 1), F.lit(False)) | F.coalesce(
            hash_at(k) == hash_at(k + 1), F.lit(False)
        )
        at = F.filter(F.sequence(F.lit(0), F.size(order) - 1), twice)
        return covered(F.array_sort(F.transform(at, lambda k: F.get(order, k)["i"])))

    def among_hashes(hashes: Column) -> Column:
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bind(order, among))

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(bind(hashes, among_hashes))


def measures(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Name -> long column for every measure that rules may use; words and lines are of this text, bound."""
    found = {
        "n_words": F.size(words),
        "word_chars": F.length(text) - F.regexp_count(text, F.lit(SPACE)),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_words(words),
        "n_lines": F.size(lines),
        "n_shouts": F.regexp_count(text, F.lit(SHOUTS)),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))),
    }
    return {name: c.cast("long") for name, c in found.items()}


def base_failed(m: Column) -> Column:
    """Too short, or made of repeated windows."""
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def passes(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression."""
    verdict = F.lit(True)
    for rule in rules:
        over, under = m[rule.over].cast("double"), m[rule.under].cast("double")
        if rule.low > float("-inf"):
            verdict &= over >= under * F.lit(rule.low)
        if rule.high < float("inf"):
            verdict &= over <= under * F.lit(rule.high)
    return verdict


def judged(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct of the measures, base_failed and kept. Words, lines and measures are bound, so each is computed once."""

    def verdict(m: Column) -> Column:
        failed = base_failed(m)
        return F.struct(
            *(m[name].alias(name) for name in MEASURES),
            failed.alias("base_failed"),
            (~failed & passes(m, rules)).alias("kept"),
        )

    def of_parts(part: Column) -> Column:
        found = measures(part["text"], part["words"], part["lines"])
        return bind(F.struct(*(found[name].alias(name) for name in MEASURES)), verdict)

    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return bind(F.struct(whole.alias("text"), words_of(whole).alias("words"), lines.alias("lines")), of_parts)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the measures, base_failed, kept) for every row; narrow, in one stage."""
    found = docs.select(F.col(id_col).alias("id"), judged(F.col(text_col), rules).alias("found"))
    return found.select(F.col("id").alias(id_col), "found.*")


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows whose text passes, with all columns as they are."""
    return docs.filter(judged(F.col(text_col), rules)["kept"])


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*COLUMNS)


def rule_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The threshold table as SQL."""
    parts = ["true"]
    for rule in rules:
        for op, bound in ((">=", rule.low), ("<=", rule.high)):
            if abs(bound) != float("inf"):
                parts.append(f"CAST({rule.over} AS DOUBLE) {op} CAST({rule.under} AS DOUBLE) * CAST({bound} AS DOUBLE)")
    return " AND ".join(parts)


#: SQL for measures and verdicts over a relation `docs` of doc_id (unique) and text.
JUDGED_SQL = rf"""
base AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM docs),
windows AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM base)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
            FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM twice WHERE n > 1) GROUP BY doc_id),
measured AS (SELECT b.doc_id, CAST(len(words) AS BIGINT) AS n_words,
               CAST(length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
               CAST(length(body) - length(regexp_replace(body, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
               CAST(length(body) - length(regexp_replace(body, '{SHOUTS}', '', 'g')) AS BIGINT) AS n_shouts,
               CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
               CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
               CAST(len(list_filter(words, lambda w: lower(w) IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) AS BIGINT) AS n_stop_words
             FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id),
failed AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM measured),
judged AS (SELECT *, NOT base_failed AND {rule_sql()} AS kept FROM failed)"""

QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES = {"op9_quality_rules": f"WITH docs AS (SELECT doc_id, text FROM documents), {JUDGED_SQL} SELECT {', '.join(COLUMNS)} FROM judged"}
