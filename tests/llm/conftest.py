import random

import pytest
from llm_cases import words
from pyspark.sql import functions as F

CLASH = ("id", "raw", "rid", "fp", "node", "key", "size", "part", "found", "spans", "n_words", "gram", "copies", "mix_epochs", "kept_id")


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and long texts, repeats, and columns whose names the operators use inside."""
    rng = random.Random(11)
    base = words(rng, 300)
    near = base.replace(base.split()[150], "changed", 1)
    rows = [
        (1, "", "a"), (2, None, None), (None, "only words here", "b"), (None, None, None), (3, " \t\n\x0b ", "a"), (4, base, "a"), (4, base, "a"),
        (5, base, None), (6, near, "b"), (7, words(rng, 20_000), "b"), (8, "x" * 30_000, "c"), (9, "ab " * 3000, "c"), (10, "naïve façade 😀 日本語 end", "c"),
    ]
    rows += [(20 + k, words(rng, 120), "abc"[k % 3]) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(f"other {c}") for c in CLASH}).cache()


@pytest.fixture(scope="session")
def none(awkward):
    return awkward.filter("false")

