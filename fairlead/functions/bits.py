"""Six-bit armour and bit fields, as expressions over 60-bit words.

Ten armour characters are one word, a long. Armour differs from Base64 in its alphabet only, so payloads are turned
into bytes, and back, by built-in functions; fields are shifts and masks of one word or two.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that armour uses: '0' to 'W' and '`' to 'w'.
ARMOUR = r"[0-W`-w]"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WORD = 60
#: The six-bit alphabet in the order of its values: '@' to '_', then space to '?'.
SIX_BIT = "".join(chr(v + 64 if v < 32 else v) for v in range(64))


def armour_characters() -> str:
    """The 64 armour characters in the order of their values."""
    return "".join(chr(v + 48 if v < 40 else v + 56) for v in range(64))


def _words(digits: Column, n_words: int) -> list[Column]:
    """60-bit words of a string of hex digits."""
    return [F.conv(F.substr(digits, F.lit(15 * k + 1), F.lit(15)), 16, 10).cast("long") for k in range(n_words)]


def _base64(words: list[Column]) -> Column:
    """Ten characters for each word; what pads them is cut off."""
    digits = [*(F.lpad(F.hex(w), 15, "0") for w in words), F.lit("0" * (-15 * len(words) % 6))]
    return F.substr(F.base64(F.unhex(F.concat(*digits))), F.lit(1), F.lit(10 * len(words)))


def words_of(payload: Column, n_bits: Column, n_words: int) -> list[Column]:
    """The first words of a payload, of which n_bits count; bits past the end are zero."""
    coded = F.rpad(F.translate(payload, armour_characters(), BASE64), -(-n_words * 10 // 4) * 4, "A")
    found = []
    for k, word in enumerate(_words(F.hex(F.unbase64(coded)), n_words)):
        past = F.lit(WORD * (k + 1)) - n_bits
        clean = F.call_function("shiftleft", F.call_function("shiftright", word, past), past)
        found.append(F.when(past >= WORD, F.lit(0).cast("long")).when(past > 0, clean).otherwise(word))
    return found


@dataclass(frozen=True)
class Bits:
    """Readers of fields, most significant bit first; bits past the end are zero, but for `checked`."""

    words: tuple[Column, ...]
    n: Column

    def unsigned(self, start: int, length: int) -> Column:
        k, at = divmod(start, WORD)
        past = at + length - WORD
        if past <= 0:
            return F.shiftright(self.words[k], -past).bitwiseAND((1 << length) - 1)
        high = F.shiftleft(self.words[k].bitwiseAND((1 << (length - past)) - 1), past)
        return high.bitwiseOR(F.shiftright(self.words[k + 1], WORD - past)) if k + 1 < len(self.words) else high

    def signed(self, start: int, length: int) -> Column:
        """Two's complement."""
        return F.shiftright(F.shiftleft(self.unsigned(start, length), 64 - length), 64 - length)

    def checked(self, start: int, length: int) -> Column:
        """An unsigned field, or null where it isn't wholly there."""
        return F.when(self.n >= start + length, self.unsigned(start, length))

    def text(self, start: int, characters: int, most: Column | None = None) -> Column:
        """Six-bit text, of at most so many characters, up to the first '@', spaces trimmed from both ends."""
        words = [self.unsigned(start + at, WORD) for at in range(0, 6 * characters, WORD)]
        whole = F.substr(F.translate(_base64(words), BASE64, SIX_BIT), F.lit(1), F.lit(characters))
        cut = whole if most is None else F.substr(whole, F.lit(1), F.greatest(most, F.lit(0)).cast("int"))
        return F.trim(F.substring_index(cut, "@", 1))


def packed(fields: list[tuple[Column, int]]) -> tuple[list[Column], int]:
    """(words, number of bits) of fields (value, length) laid end to end, values cut to their length; negative ones are
    two's complement."""
    parts: dict[int, list[Column]] = {}
    start = 0
    for value, length in fields:
        value = value.cast("long").bitwiseAND((1 << length) - 1)
        k, at = divmod(start, WORD)
        past = at + length - WORD
        parts.setdefault(k, []).append(F.shiftleft(value, -past) if past <= 0 else F.shiftright(value, past))
        if past > 0:
            parts.setdefault(k + 1, []).append(F.shiftleft(value.bitwiseAND((1 << past) - 1), WORD - past))
        start += length
    words = []
    for k in sorted(parts):
        word = parts[k][0]
        for other in parts[k][1:]:
            word = word.bitwiseOR(other)
        words.append(word)
    return words, start


def text_fields(value: Column, characters: int) -> list[tuple[Column, int]]:
    """Upper-case text as six-bit characters, filled with '@'."""
    n_words = -(-characters // 10)
    coded = F.translate(F.rpad(value, 20, "@"), SIX_BIT, BASE64)
    words, last = _words(F.hex(F.unbase64(coded)), n_words), 6 * characters - WORD * (n_words - 1)
    return [*((w, WORD) for w in words[:-1]), (F.shiftright(words[-1], WORD - last), last)]


def payload_of(words: list[Column], n_bits: int) -> Column:
    """The armour of so many bits; the last character is filled with zeros."""
    return F.translate(F.substr(_base64(words), F.lit(1), F.lit(-(-n_bits // 6))), BASE64, armour_characters())
