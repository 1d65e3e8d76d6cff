import random
from itertools import combinations

import numpy as np
import pytest
from llm_cases import plain, words
from test_simhash import roots

from fairlead.llm import near_duplicates as near


def brute_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute_roots(texts):
    sets = [brute_set(t) for t in texts]
    return roots(len(texts), [(i, j) for i, j in combinations(range(len(texts)), 2) if linked(sets[i], sets[j])])


def changed(rng, text, n):
    w = text.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("run_limit", [near.RUN_LIMIT, 6])
def test_one_of_each_component_of_all_pairs_stays(spark, run_limit):
    rng = random.Random(21)
    texts = [words(rng, 120) for _ in range(40)] + ["", None, " \t", "one two", "one two", "one", "ONE"]
    for k in range(40):  # from 0.96 down to some 0.6, on both sides of the limit, and chains of copies
        texts += [changed(rng, texts[k], n) for n in (1, 2, 3, 4, 6)]
        texts.append(changed(rng, texts[-4], 2))
    texts += [changed(rng, texts[0], rng.randrange(1, 7)) for _ in range(30)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    df = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string").repartition(5)
    kept = sorted(i for i, _ in plain(near.keep_one(df, run_limit=run_limit)))
    group = brute_roots(texts)
    assert kept == sorted({min(i for i in range(len(texts)) if group[i] == g) for g in set(group)})


def test_documents_whose_fingerprints_link_meet(spark):
    """Under no key of least hashes, but by operator 6's links: those that are similar link, those that aren't don't."""
    rng = random.Random(5)
    text = words(rng, 200)
    texts = [text, changed(rng, text, 1), words(rng, 200), changed(rng, text, 1), words(rng, 200)]
    bits = [0, 0b1111, 0b11110000, 0b11111111, -1]  # the first four are a chain of links of 4 bits
    entries = spark.createDataFrame([(k, [k], b) for k, b in enumerate(bits)], "node long, keys array<long>, bits long")
    found = near.links(entries, spark.createDataFrame([(k, t.encode()) for k, t in enumerate(texts)], "id long, raw binary"))
    assert roots(5, [(r.a, r.b) for r in found.collect()]) == roots(5, [(0, 1), (0, 3)])
    keys = [r.key for r in near.alike(entries).orderBy("node").collect()]
    assert len(set(keys[:4])) == 1 and keys[4] != keys[0]


@pytest.mark.parametrize(("similarity", "least"), [(0.8, 0.998), (0.85, 0.999), (0.9, 0.999)])
def test_recall_of_pairs(similarity, least):
    rng = np.random.default_rng(5)
    met = total = 0
    for size in (100, 396):
        common = int(np.ceil(2 * size * similarity / (1 + similarity)))
        for _ in range(1000):
            drawn = rng.integers(0, 1 << 64, 2 * size - common, np.uint64)
            a, b = near.keys(drawn[:size]), near.keys(drawn[size - common :])
            met += bool((a == b).any())
            total += 1
    print(similarity, met, total)
    assert met >= least * total


def test_pairs_below_the_limit_never_link():
    rng = np.random.default_rng(6)
    drawn = rng.integers(0, 1 << 64, 200, np.uint64)
    assert near.forest([drawn[:180], drawn[20:]]) == [(0, 1)]  # 160 of 200
    assert near.forest([drawn[:179], drawn[20:]]) == []  # 159 of 200


def test_columns_and_empty_tables(awkward, none):
    kept = near.keep_one(awkward)
    assert kept.columns == awkward.columns and near.keep_one(none).count() == 0


def test_rows_with_null_and_repeated_ids(spark):
    rng = random.Random(4)
    a, b, c, d, e = (words(rng, 100) for _ in range(5))
    rows = [(None, a), (None, a), (None, changed(rng, a, 1))]  # no id at all
    rows += [(None, b), (7, b), (None, changed(rng, b, 1))]  # the one with an id stays
    rows += [(8, c), (8, c), (8, d), (9, d), (3, e), (8, changed(rng, e, 1))]  # ids repeated within and across groups
    kept = plain(near.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert len(kept) == 5
    assert [i for i, t in kept if brute_set(t) & brute_set(a)] == [None]
    assert {(7, b), (8, c), (8, d), (3, e)} <= set(kept)


def test_keys_and_sets_are_not_left_on_disk(spark):
    from fairlead.functions import stages

    rng = random.Random(8)
    texts = [words(rng, 80) for _ in range(6)]
    texts += [changed(rng, t, 1) for t in texts[:4]]
    stages.forget(spark)
    kept = near.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    left = [spark.read.parquet(path).columns for path in stages._WRITTEN[stages.shared_folder(spark)]]
    assert left and not any({"keys", "key", "set", "runs"} & set(columns) for columns in left)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(6))
