import re
from collections import Counter

from llm_cases import plain

from fairlead.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_are_those_of_brute_force(spark, awkward):
    more = spark.createDataFrame([(90, "a b c a b c\n\na b c\nx # $\nx # $"), (91, "a a a a"), (92, "a a a"), (93, "p q r s p q r")], "doc_id long, text string")
    docs = awkward.select("doc_id", "text").unionByName(more)
    expected = Counter((i, *brute(t)) for i, t in plain(docs))
    found = quality.judge(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == expected
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in found)
    assert not any(r.kept and r.base_failed for r in found)


def test_keep_returns_the_judged_rows_with_all_columns(awkward, none):
    kept = quality.keep(awkward)
    assert kept.columns == awkward.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in quality.judge(awkward).filter("kept").collect())
    assert quality.keep(none).count() == 0 and quality.judge(none).count() == 0


def test_thresholds(spark):
    clean = " ".join(["the harbour of a town and"] + [f"word{k}" for k in range(60)])
    rows = [(1, clean), (2, clean.replace(" ", " # ")), (3, re.sub(r"\b(the|of|a|and)\b", "zzz", clean)), (4, "\n".join([clean] * 3)), (5, clean.replace(" ", "!! "))]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False}
