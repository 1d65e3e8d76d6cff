import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from llm_cases import plain

from fairlead.llm import graph, simhash


def brute_print(text, width=4, seed=42):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), seed) for i in range(max(1, len(w) - width + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, links):
    own = list(range(n))

    def find(x):
        while own[x] != x:
            own[x] = own[own[x]]
            x = own[x]
        return x

    for a, b in links:
        own[find(a)] = find(b)
    return [find(k) for k in range(n)]


def test_any_four_positions_hold_a_triple():
    found = simhash.triples()
    assert len(found) == 20
    assert all(any(set(t) <= set(four) for t in found) for four in combinations(range(8), 4))


def test_fingerprints(awkward):
    rows = simhash.fingerprints(awkward).collect()
    assert sorted(((r.id, r.node % (1 << 64)) for r in rows), key=str) == sorted(((i, brute_print(t)) for i, t in plain(awkward)), key=str)


@pytest.mark.parametrize("run_limit", [65_536, 5])
def test_components_are_those_of_all_pairs(spark, run_limit):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(120)]
    for f in list(fps[:40]):  # chains of up to four flipped bits, and clusters around one value
        for _ in range(6):
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                f ^= 1 << b
            fps.append(f)
    fps += [fps[0] ^ 1 << a ^ 1 << b for a, b in combinations(range(12), 2)]
    fps = sorted(set(fps))
    near = [(a, b) for a, b in combinations(range(len(fps)), 2) if bin(fps[a] ^ fps[b]).count("1") <= 4]
    expected = roots(len(fps), near)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(s,) for s in signed], "node long").repartition(3)
    found = {r.node: r.root for r in graph.components(simhash.links(df, run_limit=run_limit)).collect()}
    label = [found.get(s, s) for s in signed]
    assert len(set(label)) == len(set(expected)) == len(set(zip(label, expected, strict=True)))


def test_groups(awkward, none):
    rows = simhash.groups(awkward).collect()
    group = {r.id: r.component_id for r in rows if r.id is not None}
    assert group[4] == group[5] == 4 and group[1] == group[2] == group[3] == 1
    assert len(rows) == awkward.count()
    assert simhash.groups(none).count() == 0


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(0, 400)] + [(1000 + k, 1000) for k in range(1, 300)] + [(5, 5)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(found.values()) == {0, 1000} and len(found) == 401 + 300
