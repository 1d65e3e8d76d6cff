import random
import zlib

import numpy as np
import pytest
from llm_cases import plain
from tokenizers import Tokenizer

from fairlead.llm import bpe, packing, token_count
from fairlead.llm.bpe import Encoder

HARD = ["", " ", "  ", "it's we'll they've I'm you'd 're 'x ''s  's", "foo  bar\n\n baz \t\tq", "trail   ", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|>",
        "a" * 500, "😀 日本語 ñandú 123 456,789 \u3000x \u00a0 y", "'" * 7, "\x1c\x1d\x85 a", "don't're", "'re"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_count.tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    return Encoder(token_count.tokenizer_path())


def test_ids_are_the_librarys(library, encoder):
    rng = random.Random(3)
    alphabet = list("ab' \n\t.,1é😀") + ["s", "t", "re", "ve", "ll", "m", "d", "’", "<|endoftext|>"]
    texts = HARD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    ids, n = encoder.encode(texts, 0)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids + [0] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert (encoder.count(texts) == n - 1).all()


def test_memory_is_bounded(library):
    small = Encoder(token_count.tokenizer_path(), remembered=50)
    for k in range(20):
        texts = [f"word{k}{j} other{j}" for j in range(20)]
        assert small.count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(small.number) <= 50


def thue_morse(letters, n):
    a, b = letters, letters[::-1]
    words = []
    for first, second in (a, b):
        word, swap = first, str.maketrans(first + second, second + first)
        while len(word) < n:
            word += word.translate(swap)
        words.append(word)
    return words


def test_words_that_collide_under_polynomials(library, encoder):
    for texts in (thue_morse("ab", 1024), thue_morse("ab", 2048), [" ".join(thue_morse("xy", 2048) * 2)], ["".join(thue_morse("αβ", 1024))]):
        ids, n = encoder.encode(texts, 0)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids + [0] for e in library.encode_batch(texts, add_special_tokens=False)]
        assert (encoder.count(texts) == n - 1).all()


def test_long_texts_are_encoded_in_parts(library, monkeypatch):
    rng = random.Random(4)
    alphabet = list("ab' \n\t.,1é😀") + ["s", "re", "<|endoftext|>", "  ", " \n", "\u3000 "]
    texts = HARD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(400)]
    monkeypatch.setattr(bpe, "LONG", 7)
    monkeypatch.setattr(bpe.parts_of, "__defaults__", (7,))
    assert all("".join(bpe.parts_of(t)) == t for t in texts) and sum(len(bpe.parts_of(t)) > 1 for t in texts) > 200
    own = Encoder(token_count.tokenizer_path())
    ids, n = own.encode(texts, 0)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids + [0] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert (own.count(texts) == n - 1).all()


def test_counts(library, awkward, none):
    expected = sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in plain(awkward)), key=str)
    found = token_count.token_counts(awkward).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in found), key=str) == expected
    assert all(r.over_limit == (r.n_tokens > 512) for r in found)
    assert token_count.token_counts(none).count() == 0


def test_every_id_is_packed_once(library, awkward):
    docs = awkward.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).repartition(5)
    for most_open, fan in ((64, 64), (2, 2)):
        rows = [r.asDict() for r in packing.pack(docs, most_open=most_open, fan=fan).collect()]
        for i, t in plain(docs):
            ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
            at = 0
            for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
                assert (r["start"], r["doc_tokens"]) == (at, len(ids))
                assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(ids)
        for s in {r["sequence_id"] for r in rows}:
            own = sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"])
            assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
            assert sum(r["length"] for r in own) <= packing.CAPACITY


def test_windows_are_bounded_and_well_filled():
    rng = random.Random(2)
    windows, emitted, total = packing.Windows(16), [], 0
    for _ in range(20_000):
        n = rng.randrange(1, 1024)
        total += n
        if full := windows.place(n, n):
            emitted.append(sum(full))
        assert len(windows.held) <= 16
    assert sum(emitted) + sum(sum(h) for h in windows.held.values()) == total
    assert sum(emitted) / (1024 * len(emitted)) > 0.9


def test_ids_beside_a_null_id_are_whole(spark):
    great = [2**60 + 1, 2**60 + 3, None, -(2**62) - 1]
    docs = spark.createDataFrame([(i, f"some words {k}") for k, i in enumerate(great)], "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id for r in packing.pack(docs).collect()), key=str) == sorted(great, key=str)


def test_rows_without_ids(awkward, none):
    rows = packing.pack(awkward).collect()
    assert sum(1 for r in rows if r.doc_id is None and r.doc_tokens == 1) == 1
    assert packing.pack(none).count() == 0
