import random
from collections import Counter, defaultdict

from llm_cases import plain

from fairlead.llm import mixing


def targets(sizes):
    """Shares by weight, with what doesn't fit shared again until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    budget, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            budget -= out[s]
        open_ -= full
    return out


def test_targets_and_cuts(awkward):
    rows = mixing.plan(awkward).collect()
    key = lambda r: None if r.source_null else r.source_key
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[key(r)] += r.size
        taken[key(r)] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    expected = targets(sizes)
    for r in rows:
        assert abs(r.target - expected[key(r)]) < 1e-6
        assert r.source_size == sizes[key(r)]
    assert {s: int(t) for s, t in expected.items()} == dict(taken)


def test_reruns_agree_however_rows_are_dealt(awkward):
    a = Counter((r.id, r.size, r.taken) for r in mixing.plan(awkward).collect())
    assert a == Counter((r.id, r.size, r.taken) for r in mixing.plan(awkward.repartition(7)).collect())


def test_rows_without_ids_are_dealt_to_many_ranges(spark):
    df = spark.createDataFrame([(None, f"text {k}", "a") for k in range(400)] + [(1, "again", "a")] * 300, "doc_id long, text string, source string")
    rows = mixing.keyed(df, "doc_id", "text", "source", mixing.SEED)
    assert rows.count() == 401 and rows.select("part").distinct().count() > 300


def test_targets_of_many_sources(spark):
    rng = random.Random(5)
    sizes = {f"s{rng.randrange(10**6)}": rng.choice((0, 1, 7, rng.randrange(1, 5000))) for _ in range(500)} | {None: 40, "": 3}
    rows = [(s is None, s or "", "000", n) for s, n in sizes.items()]
    found = mixing.targets(spark.createDataFrame(rows, "source_null boolean, source_key string, part string, size long").repartition(5)).collect()
    expected = targets(sizes)
    assert len(found) == len(sizes)
    assert all(abs(r.target - expected[None if r.source_null else r.source_key]) < 1e-6 * max(1, r.target) for r in found)


def test_mix_returns_whole_documents_near_the_targets(spark, awkward, none):
    mixed = mixing.mix(awkward)
    assert mixed.columns == awkward.columns
    texts = {t for _, t in plain(awkward)}
    assert all(t in texts for _, t in plain(mixed))
    many = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', 1 + cast(id % 50 AS int)) AS text", "concat('s', id % 4) AS source")
    words = {r.source: r.n for r in mixing.mix(many).groupBy("source").agg(mixing.F.sum(mixing.F.size(mixing.words_of(mixing.F.col("text")))).alias("n")).collect()}
    aims = {r.source_key: r.target for r in mixing.plan(many).select("source_key", "target").distinct().collect()}
    assert all(abs(words[s] - aims[s]) <= 50 for s in aims)
    assert mixing.mix(none).count() == 0 and mixing.plan(none).count() == 0


def test_mix_is_the_plan_for_null_and_repeated_ids(spark):
    texts = ["w " * (1 + k % 7) + f"t{k % 11}" for k in range(600)]
    ids = [None if k % 3 == 0 else k % 5 if k % 3 == 1 else k for k in range(600)]
    rows = [(i, t, ("a", "b", "c")[k % 2 if k < 400 else 2], k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    rows += [(None, "same text here", "d", 1000 + k) for k in range(90)] + [(5, "same text here", "e", 2000 + k) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row long").repartition(6)
    planned = Counter()
    for r in mixing.plan(df).collect():
        planned[r.source_key, r.id, r.size] += r.epochs + r.more
    mixed = mixing.mix(df).collect()
    assert Counter((r.source, r.doc_id, len(r.text.split())) for r in mixed) == +planned
    often = Counter(r.row for r in mixed)
    for source in "abcde":  # a row is taken the whole epochs, or once more
        times = {often[r[3]] for r in rows if r[2] == source}
        assert max(times) - min(times) <= 1
    assert any(len({often[r[3]] for r in rows if r[2] == s}) == 2 for s in "de")  # a cut among copies
