"""Byte-level BPE over batches of texts, in numpy: pre-tokens by character classes, merges by rank, in step.

A batch of texts is one array of code points. Pre-token starts follow from the classes of neighbouring characters,
which is what the tokenizer's pattern says of letters, numbers, white space, the rest and English contractions.
Each different pre-token is merged once per worker and then looked up by its text. Within a batch, equal ones are found
by a 64-bit hash and then compared, code point by code point, so that a collision costs time and nothing else.

A text of more than `LONG` characters is taken in parts that end before white space which begins a pre-token, so what
is held beside the text and its ids is bounded, unless a text has no such place.

Different pre-tokens are merged together, held as one ragged array of symbols. In each turn every sequence applies its
own lowest-ranked pair wherever it occurs, until no sequence has a pair that the table knows. A merged symbol's pairs
rank above the pair that made it, so this gives what merging one occurrence at a time gives.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The characters that the pattern's `\\s` stands for.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CUT = re.compile(f"(?<![{''.join(f'\\U{c:08x}' for c in WHITE)}]) ")
#: The contractions that are pre-tokens of their own.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Different pre-tokens that a worker remembers; beyond that it starts anew.
REMEMBERED = 200_000
#: Characters of a text, or of several, that are encoded together.
LONG = 4_000_000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter(
        (kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1
    )
    table[WHITE] = SPACE
    return table


def starts_of(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, as a mask over code points; text_starts marks the first of each text."""
    n = len(points)
    kind = _classes()[points]
    before = np.empty(n, np.uint8)
    before[1:] = kind[:-1]
    before[text_starts] = 255
    plain_space_before = np.zeros(n, bool)
    plain_space_before[1:] = points[:-1] == 0x20
    plain_space_before[text_starts] = False
    space = kind == SPACE
    followed = np.zeros(n, bool)  # by a character of another class in the same text
    followed[:-1] = (kind[1:] != SPACE) & ~text_starts[1:]
    starts = kind != before
    # the last of a run of white space stands alone or, as a plain space, begins what follows
    starts |= space & followed
    starts &= space | ~plain_space_before
    _contractions(points, kind, starts, text_starts)
    return starts


def parts_of(text: str, most: int = LONG) -> list[str]:
    """The text cut where its tokens don't depend on what is on the other side: before a plain space after anything
    but white space, the first such place that lies `most` characters or more after the last."""
    found, start = [], 0
    while len(text) - start > most and (cut := _CUT.search(text, start + most)):
        found.append(text[start : cut.start()])
        start = cut.start()
    return [*found, text[start:]]


def _contractions(points: np.ndarray, kind: np.ndarray, starts: np.ndarray, text_starts: np.ndarray) -> None:
    at = np.flatnonzero((points == 0x27) & starts)
    if not len(at):
        return
    n = len(points)
    ahead = lambda k: np.where((at + k < n) & ~text_starts[np.minimum(at + k, n - 1)], points[np.minimum(at + k, n - 1)], 0)
    one, two = ahead(1), ahead(2)
    two = np.where(one == 0, 0, two)
    for c in CONTRACTIONS:
        fits = (one == ord(c[1])) & (len(c) < 3 or two == ord(c[-1]))
        found = at[fits]
        starts[found + 1] = False
        after = found + len(c)
        starts[after[after < n]] = True


class Vocabulary:
    """A tokenizer file's byte-level BPE: symbols of bytes, and a hash table of its pairs."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = _byte_names()
        self.of_byte = np.array([vocab[names[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.uint64) for i in (0, 1))
        self.merged = np.array([vocab["".join(p)] for p in pairs], np.int64)
        self._build(left << np.uint64(32) | right)

    def _build(self, keys: np.ndarray) -> None:
        self.shift = np.uint64(64 - 20)
        self.keys, self.ranks = np.full(1 << 20, ~np.uint64(0)), np.full(1 << 20, len(keys), np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(todo):  # linear probing, all keys at once
            self.probes += 1
            free = self.keys[slot] == ~np.uint64(0)
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.ranks[slot[put]] = keys[todo[put]], todo[put]
            todo, slot = todo[~put], (slot[~put] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, the number of pairs where there is none."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        found = np.where(self.keys[slot] == keys, self.ranks[slot], len(self.merged))
        on = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != ~np.uint64(0)))
        at = slot[on]
        for _ in range(self.probes):
            if not len(on):
                break
            at = (at + 1) & (len(self.keys) - 1)
            hit = self.keys[at] == keys[on]
            found[on[hit]] = self.ranks[at[hit]]
            more = ~hit & (self.keys[at] != ~np.uint64(0))
            on, at = on[more], at[more]
        return found

    def merge(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of byte sequences laid end to end: (symbols laid end to end, their number per sequence)."""
        none = len(self.merged)
        symbols, owner = self.of_byte[raw], np.repeat(np.arange(len(lengths)), lengths)
        done_symbols, done_owner = [], []
        while len(symbols):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            rank = np.full(len(symbols), none)
            within = owner[:-1] == owner[1:]
            rank[:-1][within] = self.rank(symbols[:-1][within], symbols[1:][within])
            least = np.minimum.reduceat(rank, first)
            each = np.repeat(least, np.diff(first, append=len(symbols)))
            finished = each == none
            take = (rank == each) & ~finished
            if finished.any():
                done_symbols.append(symbols[finished])
                done_owner.append(owner[finished])
            # of overlapping pairs every other one, from the left
            run_start = np.flatnonzero(take & ~np.concatenate([[False], take[:-1]]))
            if len(run_start) < np.count_nonzero(take):
                at = np.flatnonzero(take)
                from_start = at - run_start[np.searchsorted(run_start, at, side="right") - 1]
                take[at[from_start % 2 == 1]] = False
            symbols[take] = self.merged[rank[take]]
            gone = finished
            gone[1:] |= take[:-1]
            symbols, owner = symbols[~gone], owner[~gone]
        if not done_owner:
            return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        return symbols[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(lengths))


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in a vocabulary: itself, or the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names, more = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in names:
            names[b], more = chr(more), more + 1
    return [names[b] for b in range(256)]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Token ids of texts, with a memory of pre-tokens."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        self.vocabulary, self.remembered = vocabulary(path), remembered
        rng = np.random.default_rng(20)
        self.mix = rng.integers(1, 1 << 63, 1 << 16, np.uint64) | np.uint64(1)
        self.base = np.uint64(0x2545F4914F6CDD1D)
        self.powers = self.inverses = np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        """number: a pre-token -> its place in starts; ids[starts[i]:starts[i + 1]] are its tokens."""
        self.number: dict[str, int] = {}
        self.lengths = np.zeros(1024, np.int64)
        self.starts = np.zeros(1024, np.int64)
        self.ids = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _hashes(self, points: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Polynomials modulo 2^64 in an odd base, of mixed code points, by differences of prefix sums."""
        n = len(points)
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers))
            inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, self.base)]), dtype=np.uint64)
            self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]), dtype=np.uint64)
        mixed = self.mix[points & 0xFFFF] + (points >> 16).astype(np.uint64) * self.base
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed * self.powers[:n], dtype=np.uint64)])
        return (total[end] - total[first]) * self.inverses[first] + (end - first).astype(np.uint64)

    def _kinds(self, text: str, points: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One pre-token of each kind, and the kind of every one; of a kind are those that are equal."""
        _, at, which = np.unique(self._hashes(points, first, end), return_index=True, return_inverse=True)
        length, like = end - first, at[which]
        shift = np.repeat(first[like] - first, length)
        differs = points[np.minimum(np.arange(len(points)) + shift, len(points) - 1)] != points
        wrong = np.flatnonzero(np.logical_or.reduceat(differs, first) | (length != length[like]))
        if len(wrong):
            others: dict[str, int] = {}
            for k in wrong.tolist():
                which[k] = others.setdefault(text[first[k] : end[k]], len(at) + len(others))
            at = np.append(at, wrong[np.unique(which[wrong], return_index=True)[1]])
        return at, which

    def _places(self, text: str, points: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each pre-token its place in the memory, where new ones are put."""
        at, which = self._kinds(text, points, first, end)
        if len(self.number) + len(at) > self.remembered:
            self._forget()
        words = [text[i:j] for i, j in zip(first[at].tolist(), end[at].tolist(), strict=True)]
        get = self.number.get
        places = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(places < 0).tolist()
        if new:
            raws = [words[i].encode() for i in new]
            sizes = np.fromiter(map(len, raws), np.int64, len(raws))
            ids, lengths = self.vocabulary.merge(np.frombuffer(b"".join(raws), np.uint8), sizes)
            k = len(self.number)
            places[new] = np.arange(k, k + len(new))
            self.number.update((words[i], k + j) for j, i in enumerate(new))
            self._keep(k, ids, lengths)
        return places[which]

    def _keep(self, k: int, ids: np.ndarray, lengths: np.ndarray) -> None:
        n = len(lengths)
        if k + n > len(self.lengths):
            grow = np.zeros(max(n, len(self.lengths)), np.int64)
            self.lengths, self.starts = np.concatenate([self.lengths, grow]), np.concatenate([self.starts, grow])
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), np.int64)])
        self.lengths[k : k + n] = lengths
        self.starts[k : k + n] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _pieces(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Stretches between special strings, the text each is of, and the id of the special that ends it (-1: none)."""
        pieces, owner, special = [], [], []
        for k, text in enumerate(texts):
            rest = text
            for content, number in self.vocabulary.special.items():
                if content in rest:
                    *heads, rest = rest.split(content)
                    pieces += heads
                    owner += [k] * len(heads)
                    special += [number] * len(heads)
            pieces.append(rest)
            owner.append(k)
            special.append(-1)
        return pieces, np.array(owner, np.int64), np.array(special, np.int64)

    def _tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places and owning pieces of all pre-tokens, owners of pieces, specials of pieces."""
        pieces, owner, special = self._pieces(texts)
        text = "".join(pieces)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), owner, special
        bounds = np.cumsum(sizes) - sizes
        text_starts = np.zeros(len(points), bool)
        text_starts[bounds[sizes > 0]] = True
        first = np.flatnonzero(starts_of(points, text_starts))
        end = np.append(first[1:], len(points))
        places = self._places(text, points, first, end)
        full = np.flatnonzero(sizes > 0)
        piece = full[np.searchsorted(bounds[full], first, side="right") - 1]
        return places, piece, owner, special

    def _groups(self, texts: list[str]) -> Iterator[tuple[list[str], list[int], list[bool]]]:
        """Parts of about LONG characters together, the text each is of, and whether it is that text's last."""
        parts, owner, final, size = [], [], [], 0
        for k, text in enumerate(texts):
            own = parts_of(text)
            for i, part in enumerate(own):
                parts.append(part)
                owner.append(k)
                final.append(i == len(own) - 1)
                size += len(part)
                if size >= LONG:
                    yield parts, owner, final
                    parts, owner, final, size = [], [], [], 0
        if parts:
            yield parts, owner, final

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        counts = np.zeros(len(texts), np.int64)
        for parts, text_of, _ in self._groups(texts):
            places, piece, owner, special = self._tokens(parts)
            each = np.bincount(owner[piece], weights=self.lengths[places], minlength=len(parts)).astype(np.int64)
            each += np.bincount(owner[special >= 0], minlength=len(parts))
            np.add.at(counts, text_of, each)
        return counts

    def encode(self, texts: list[str], last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids laid end to end, as 32-bit numbers, and their number per text; `last`, if given, is put after each."""
        found, counts = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        for parts, text_of, final in self._groups(texts):
            ids, n = self._encoded(parts, None if last is None else (last, np.array(final)))
            found.append(ids.astype(np.uint32))
            np.add.at(counts, text_of, n)
        return np.concatenate(found), counts

    def _encoded(self, texts: list[str], last: tuple[int, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        places, piece, owner, special = self._tokens(texts)
        # one entry for each pre-token, special and last id, in order
        ends = [(np.flatnonzero(special >= 0), special[special >= 0], 1)]
        if last is not None:
            final = np.flatnonzero(np.diff(owner, append=-1))[last[1]]
            ends.append((final, np.full(len(final), last[0]), 2))
        where = np.concatenate([piece, *(e[0] for e in ends)])
        order = np.concatenate([np.zeros(len(piece), np.int64), *(np.full(len(e[0]), e[2]) for e in ends)])
        lengths = np.concatenate([self.lengths[places], *(np.ones(len(e[0]), np.int64) for e in ends)])
        starts = np.concatenate([self.starts[places], *(-1 - e[1] for e in ends)])
        by = np.argsort(where * 4 + order, kind="stable")
        where, lengths, starts = where[by], lengths[by], starts[by]
        at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        single = np.repeat(starts < 0, lengths)
        ids = self.ids[np.where(single, 0, at)]
        ids[single] = -1 - np.repeat(starts, lengths)[single]
        return ids, np.bincount(owner[where], weights=lengths, minlength=len(texts)).astype(np.int64)
