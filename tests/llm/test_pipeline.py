import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import brute_pii
import corpus_pipeline
import numpy as np
import pytest
from llm_cases import words
from test_mixing import targets
from test_near_duplicates import brute_roots, changed
from test_quality import brute as measures
from tokenizers import Tokenizer

from fairlead.llm import mixing, packing, pii, quality, token_count

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def accepted(text):
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = measures(text)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    m = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_lines": len(lines)}
    m |= {"n_shouts": len(re.findall("[!?]", text or "")), "n_stop_words": sum(w.lower() in quality.STOP_WORDS for w in (text or "").split())}
    good = n_words >= 50 and 100 * n_repeat_words <= 50 * n_words
    return good and all(m[r.under] * r.low <= m[r.over] if r.low > float("-inf") else True for r in quality.RULES) and all(
        m[r.over] <= m[r.under] * r.high for r in quality.RULES if r.high < float("inf")
    )


def mixed(docs):
    """Documents as often as the mix takes them, in order of their keys: whole epochs, and a cut at half a document."""
    sizes, by_source, out = defaultdict(int), defaultdict(list), []
    for i, t, s in docs:
        own = hashlib.md5(t.encode()).hexdigest()
        key = hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}:{own}".encode()).hexdigest()
        sizes[s] += len(t.split())
        by_source[s].append((key, i, t))
    for s, target in targets(sizes).items():
        whole, rest = divmod(int(target), sizes[s])
        for _, i, t in sorted(by_source[s], key=lambda r: r[0]):
            n = len(t.split())
            part = min(max(rest, 0), n)
            out += [(i, t)] * (whole + (part > 0 and 2 * part >= n))
            rest -= n
    return out


def brute_pieces(rows):
    """(doc_id, start, length, crc, doc_tokens) of every piece, with how often it occurs."""
    rows = [r for r in rows if accepted(r[1])]
    group = brute_roots([r[1] for r in rows])
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0, k)
    first = {g: min((k for k in range(len(rows)) if group[k] == g), key=order) for g in set(group)}
    kept = [rows[k] for k in sorted(first.values())]
    safe = [(i, brute_pii.replaced(t, pii.DEMO_KEY)[0], s) for i, t, _, s, _ in kept]
    library, found = Tokenizer.from_file(token_count.tokenizer_path()), Counter()
    for i, t in mixed(safe):
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4")
        for at in range(0, len(ids), packing.CAPACITY):
            part = ids[at : at + packing.CAPACITY]
            found[i, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    return found, len(kept)


def clean(rng, n):
    return " ".join("the" if k % 9 == 0 else w for k, w in enumerate(words(rng, n).split()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = [clean(rng, 150) for _ in range(50)] + [clean(rng, 2500)]
    for k in range(30):  # near copies from 0.96 down to below the limit, and copies of copies
        texts += [changed(rng, texts[k], n) for n in (1, 2, 4, 7)]
        texts.append(changed(rng, texts[-3], 2))
    texts += texts[:10] + ["too short", "go " * 200, None, "", "# " * 300]
    for k in range(40, 50):
        texts[k] += f" mail jane.doe{k % 3}@example.org or call +1 (212) 555-01{k}, card 4111 1111 1111 1111, born 1985-02-2{k % 8}"
    found = [(k, t, "en", (None, "a", "b", "c")[k % 4], len(t or "")) for k, t in enumerate(texts)]
    found += [(None, clean(rng, 90), None, "d", None), (None, None, None, None, None)]
    rng.shuffle(found)
    return found


def test_run_is_a_plain_pipeline(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    expected, n_kept = brute_pieces(rows)
    assert 50 < n_kept < 200
    ran = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in ran) == expected
    by_sequence = defaultdict(list)
    for r in ran:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_stages_keep_the_columns(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS row_number", "2 AS mix_some", "3 AS raw")
    assert len(corpus_pipeline.STAGES) == 5
    for some in (docs, docs.filter("false")):
        now = some
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, now, str(tmp_path)).write.mode("overwrite").parquet(f"{tmp_path}/{k}")
            now = spark.read.parquet(f"{tmp_path}/{k}")
            assert k == 4 or now.columns == docs.columns
        assert bool(now.count()) == bool(some.count())
