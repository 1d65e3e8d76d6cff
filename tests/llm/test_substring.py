import hashlib
import random
from collections import Counter
from itertools import cycle

import numpy as np
import pytest

from fairlead.llm import substring_dedup as s


def brute(texts, length=200):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    text = lambda letters, n: "".join(rng.choices(letters, k=n))
    base = [text("abcdef é ", rng.randrange(1200)) for _ in range(25)]
    shared, short = text("xyz", 230), text("xyz", 150)
    docs = list(base)
    for _ in range(40):
        b = rng.choice(base)
        k = rng.randrange(max(1, len(b)))
        docs.append(text("abc", rng.randrange(300)) + b[k : k + rng.randrange(600)] + rng.choice((shared, short, "")) + text("qr", 60))
    return docs + ["a" * 1000, "a" * 199, "a" * 200, "", "ab" * 300, base[0], base[0]]


@pytest.mark.parametrize(("seed", "hot"), [(1, s.HOT), (2, 3)])
def test_against_brute_force(spark, seed, hot):
    docs = corpus(seed)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.cleaned(df, hot=hot).collect()}
    assert [found[k] for k in range(len(docs))] == brute([d.encode() for d in docs])


def test_long_texts_are_cut_without_loss(monkeypatch):
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 100, 5000, np.uint8).tobytes()
    rolling = s.Rolling()
    monkeypatch.setattr(s.chunks, "__defaults__", (700,))
    starts = []
    for parts in s.chunks([(1, raw), (2, raw[:150])], 200):
        *_, rids, places = s.stretches(parts, rolling, 200, 64)
        assert set(rids.tolist()) == {1}
        starts += [p for q in places.tolist() for p in range(q >> 9, (q >> 9) + (q & 511) + 1)]
    assert sorted(starts) == list(range(5000 - 199))


def test_refinement_finds_equal_windows():
    rng = random.Random(5)
    segments = [bytes(rng.choices(b"ab", k=300)) for _ in range(6)]
    segments += [segments[0][20:260] + b"x" * 40, b"a" * 230, segments[3][:210]]
    hit = s.equal_windows(segments, 200)
    seen = Counter(t[i : i + 200] for t in segments for i in range(len(t) - 199))
    expected = [i + 200 <= len(t) and seen[t[i : i + 200]] > 1 for t in segments for i in range(len(t))]
    assert hit.tolist() == expected


def test_numbers_hold_when_the_input_is_split_otherwise_later(spark, tmp_path, monkeypatch):
    docs = corpus(9)
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/docs")
    expected = brute([d.encode() for d in docs])
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n) for n in names}
    real, sizes = s.durable, cycle(((4096, 1, 3), (10**8, 10**7, 5), (900, 100, 2), (10**6, 10**6, 7)))

    def keeps_and_changes(df):
        kept = real(df)
        for n, v in zip(names, next(sizes), strict=True):
            spark.conf.set(n, str(v))
        return kept

    monkeypatch.setattr(s, "durable", keeps_and_changes)
    try:
        stored = spark.read.parquet(f"{tmp_path}/docs")
        for df in (stored, stored.repartition(5), stored.orderBy(stored.text)):
            found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.cleaned(df, hot=3).collect()}
            assert [found[k] for k in range(len(docs))] == expected
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_strings_that_collide_under_polynomials(spark):
    pair = []
    for a, b in ("ab", "ba"):
        word = a
        while len(word) < 4096:
            word += word.translate(str.maketrans("ab", "ba"))
        pair.append(word)
    docs = [pair[0], pair[1], pair[0][:900] + "x", "y" + pair[1][:900]]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for hot in (s.HOT, 1):
        found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.cleaned(df, hot=hot).collect()}
        assert [found[k] for k in range(len(docs))] == brute([d.encode() for d in docs])


def test_runs_are_merged_over_batches(spark):
    rng = random.Random(6)
    spans = [(rng.randrange(3), a, a + rng.randrange(1, 40)) for a in (rng.randrange(400) for _ in range(60))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        found = sorted(map(tuple, s.maximal(spark.createDataFrame(spans, "rid long, start long, stop long")).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    covered = {r: {x for q, a, b in spans if q == r for x in range(a, b)} for r in range(3)}
    expected = [(r, a, next(b for b in range(a, 999) if b not in covered[r])) for r in range(3) for a in sorted(covered[r]) if a - 1 not in covered[r]]
    assert found == expected


def test_awkward_rows(awkward, none):
    rows = s.cleaned(awkward, with_rest=True).collect()
    assert len(rows) == awkward.count()
    assert all(r.n_bytes == 0 and r.n_spans == 0 for r in rows if r.doc_id in (1, 2))
    assert all(r.kept == b"" for r in rows if r.doc_id in (4, 5))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and r.n_bytes == len(r.kept) + r.n_removed for r in rows)
    assert s.cleaned(none).count() == 0
