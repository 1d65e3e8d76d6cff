r"""PII: format-preserving Feistel pseudonyms, as DataFrame expressions.

Personal numbers, dates, addresses and credentials are found by one pattern, validated by kind, and replaced by another
value of the same format: the characters that carry the value are permuted by a keyed Feistel network over strings of
their alphabet, separators and the rest stay. Equal values get equal pseudonyms in every document, different values
different ones, and who holds the key can invert them.

    kind    found                                              stays valid as
    card    13 to 19 digits, or groups of four; Luhn           first digit kept, check digit computed anew
    iban    2 letters, check digits, account; remainder 97     country, letters and spaces kept, check digits anew
    phone   with a country code, or North American groups      country code and punctuation kept
    ip      four numbers up to 255                             four numbers up to 255
    ssn     ddd-dd-dddd of an area that is assigned            digits permuted
    date    yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, dd/mm/yyyy     a date between 1900 and 2099
    email   local part                                         letters and digits permuted, domain kept
    secret  value with a digit, after a word like token=       its alphabet kept

What isn't valid (a card number whose check digit is wrong, 30 February) is left alone. A text without a digit or an @,
one of which every kind needs, is passed on after one scan. All of it is one projection: no shuffle, no user function.

The key is the caller's. It is a literal of the plan, so plans and event logs have to be kept as the key is. The
registered query and the pipeline take the session's `spark.fairlead.pii.key`, and where none is set a key that is
written here, which protects nothing.

Defined results: a null text stays null, an empty one empty; where several kinds fit at a place the first in the table's
order of search is taken; every row is replaced for itself, repeated rows alike; a very long text is searched whole, as
one string, with patterns whose backtracking is bounded; an empty table gives an empty result; other columns are passed
on whatever their names, and the order of columns stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm.quality import bind

#: Where the session's key is, and what stands in for it in demonstrations.
KEY_SETTING, DEMO_KEY = "spark.fairlead.pii.key", "fairlead-demo-key"
ROUNDS = 8
DIGITS, HEX = "0123456789", "0123456789abcdef"
LOWER = DIGITS + "abcdefghijklmnopqrstuvwxyz"
MIXED = LOWER + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: 1900-01-01 to 2099-12-31 are 73,049 = 17 * 4,297 days: two halves for a network of numbers.
FIRST_DAY, DAYS, DAY_PARTS = "1900-01-01", 73_049, (17, 4_297)

FREE, END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
PATTERNS = {
    "secret": r"(?i:(?<![a-z])(?:token|password|passwd|pwd|secret|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)"
    r"(?=[A-Za-z+/_-]{0,127}[0-9])[0-9A-Za-z+/_-]{8,128}",
    "email": r"(?<![0-9A-Za-z._%+-])[0-9A-Za-z._%+-]{1,64}+@[0-9A-Za-z-]{1,63}(?:\.[0-9A-Za-z-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "iban": rf"{FREE}[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{2,7}}(?: ?[0-9A-Z]{{1,4}})?{END}",
    "ip": rf"(?<![0-9A-Za-z.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?[0-9])",
    "card": rf"{FREE}(?:[0-9]{{13,19}}+|[0-9]{{4}}([ -])[0-9]{{4}}\1[0-9]{{4}}\1[0-9]{{4}}){END}",
    "date": rf"{FREE}(?:[12][0-9]{{3}}-[0-9]{{2}}-[0-9]{{2}}|[12][0-9]{{3}}/[0-9]{{2}}/[0-9]{{2}}"
    rf"|[0-9]{{2}}\.[0-9]{{2}}\.[12][0-9]{{3}}|[0-9]{{2}}/[0-9]{{2}}/[12][0-9]{{3}}){END}",
    "ssn": rf"{FREE}(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}{END}",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
    r"|\+(?=(?:[ .-]?[0-9]){8,15}(?![0-9]))[0-9]{1,3}(?:[ .-][0-9]{2,8}){1,4}(?![0-9A-Za-z])|\+[0-9]{8,15}(?![0-9A-Za-z])",
}
#: What is looked for, in this order where several fit at a place.
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _keystream(key: str, kind: str, turn: Column, other: Column) -> Column:
    """128 hex digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), other), 512)


def _shifted(part: Column, stream: Column, alphabet: str) -> Column:
    """Each character moved on within its alphabet by four hex digits of the stream."""
    moved = lambda j: F.substr(
        F.lit(alphabet),
        (
            F.instr(F.lit(alphabet), F.substr(part, j, F.lit(1)))
            - 1
            + F.conv(F.substr(stream, F.pmod(j - 1, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        )
        % len(alphabet)
        + 1,
        F.lit(1),
    )
    each = F.transform(F.sequence(F.lit(1), F.length(part)), moved)
    return F.when(F.length(part) == 0, "").otherwise(F.array_join(each, ""))


def permuted(text: Column, alphabet: str, kind: str, key: str) -> Column:
    """A keyed permutation of the strings over the alphabet, among those of the same length."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1).alias("b"))

    def turn(acc: Column, r: Column) -> Column:
        new = bind(_keystream(key, kind, r, acc["b"]), lambda stream: _shifted(acc["a"], stream, alphabet))
        return F.struct(acc["b"].alias("a"), new.alias("b"))

    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, turn, lambda acc: F.concat(acc["a"], acc["b"]))


def in_format(text: Column, characters: str, change: Callable[[Column], Column]) -> Column:
    """The characters of a class changed as one string, and put back between the others."""

    def filled(parts: Column) -> Column:
        put = lambda gap, i: F.concat(gap, F.substr(parts["new"], i + 1, F.lit(1)))
        return F.array_join(F.transform(parts["gaps"], put), "")

    own = F.regexp_replace(text, f"[^{characters}]", "")
    return bind(F.struct(F.split(text, f"[{characters}]", -1).alias("gaps"), change(own).alias("new")), filled)


def luhn_sum(digits: Column) -> Column:
    """Sum of digits with every other one doubled, the last one not."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + worth(i))


def _card(text: Column, key: str) -> Column:
    def change(digits: Column) -> Column:
        inner = permuted(F.substr(digits, F.lit(2), F.length(digits) - 2), DIGITS, "card", key)
        body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), inner)
        with_check = lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string"))
        return bind(body, with_check)

    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(luhn_sum(digits) % 10 == 0, in_format(text, "0-9", change)).otherwise(text)


def remainder_97(text: Column) -> Column:
    """Of the number that digits and capital letters, A as 10 to Z as 35, make."""
    value = lambda c: F.ascii(c) - F.when(c <= "9", 48).otherwise(55)
    step = lambda acc, c: (acc * F.when(c <= "9", 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.array_remove(F.split(text, ""), ""), F.lit(0), step)


def _iban(text: Column, key: str) -> Column:
    bare = F.replace(text, F.lit(" "), F.lit(""))
    country, account = F.substr(bare, F.lit(1), F.lit(2)), F.substr(bare, F.lit(5))

    def checked(new: Column) -> Column:
        digits = F.lpad((98 - remainder_97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
        return in_format(text, "0-9A-Z", lambda _: F.concat(country, digits, new))

    new = in_format(account, "0-9", lambda d: permuted(d, DIGITS, "iban", key))
    valid = remainder_97(F.concat(account, F.substr(bare, F.lit(1), F.lit(4)))) == 1
    return F.when(valid, bind(new, checked)).otherwise(text)


def _ip(text: Column, key: str) -> Column:
    """A network over the 32 bits, as eight hex digits."""
    as_hex = F.array_join(F.transform(F.split(text, r"\."), lambda o: F.lpad(F.lower(F.hex(o.cast("int"))), 2, "0")), "")
    octet = lambda h, i: F.conv(F.substr(h, F.lit(2 * i + 1), F.lit(2)), 16, 10)
    return bind(permuted(as_hex, HEX, "ip", key), lambda h: F.concat_ws(".", *(octet(h, i) for i in range(4))))


def _date(text: Column, key: str) -> Column:
    year_first = text.rlike("^[0-9]{4}")
    digits = F.regexp_replace(text, "[^0-9]", "")
    iso = F.when(year_first, digits).otherwise(
        F.concat(F.substr(digits, F.lit(5), F.lit(4)), F.substr(digits, F.lit(3), F.lit(2)), F.substr(digits, F.lit(1), F.lit(2)))
    )
    low, high = DAY_PARTS

    def turn(acc: Column, r: Column) -> Column:
        stream = lambda other: F.conv(F.substr(_keystream(key, "date", r, other.cast("string")), F.lit(1), F.lit(12)), 16, 10).cast("long")
        return F.when(r % 2 == 0, F.struct(((acc["a"] + stream(acc["b"])) % low).alias("a"), acc["b"].alias("b"))).otherwise(
            F.struct(acc["a"].alias("a"), ((acc["b"] + stream(acc["a"])) % high).alias("b"))
        )

    def moved(day: Column) -> Column:
        n = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
        start = F.struct((n % low).alias("a"), F.floor(n / low).alias("b"))
        new = F.aggregate(
            F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1)), start, turn,
            lambda acc: F.date_add(F.lit(FIRST_DAY).cast("date"), (acc["a"] + acc["b"] * low).cast("int")),
        )
        put = lambda d: in_format(text, "0-9", lambda _: F.when(year_first, F.date_format(d, "yyyyMMdd")).otherwise(F.date_format(d, "ddMMyyyy")))
        inside = day.between(F.lit(FIRST_DAY).cast("date"), F.lit("2099-12-31").cast("date"))
        return F.when(inside, bind(new, put)).otherwise(text)

    return bind(F.try_to_date(iso, "yyyyMMdd"), moved)


def _phone(text: Column, key: str) -> Column:
    """All digits but those of a country code."""
    code = F.regexp_extract(text, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substr(text, F.length(code) + 1)
    return F.concat(code, in_format(rest, "0-9", lambda d: permuted(d, DIGITS, "phone", key)))


def _email(text: Column, key: str) -> Column:
    """Equal up to case is equal, as mail treats it."""
    local = F.lower(F.substring_index(text, "@", 1))
    new = in_format(local, "0-9a-z", lambda s: permuted(s, LOWER, "email", key))
    return F.concat(new, F.substr(text, F.length(local) + 1))


def _secret(text: Column, key: str) -> Column:
    value = F.regexp_extract(text, "[0-9A-Za-z+/_-]+$", 0)
    head = F.substr(text, F.lit(1), F.length(text) - F.length(value))
    new = F.when(value.rlike("^[0-9a-f]+$"), permuted(value, HEX, "hex", key)).otherwise(
        in_format(value, "0-9A-Za-z", lambda s: permuted(s, MIXED, "secret", key))
    )
    return F.concat(head, new)


def kind_of(found: Column) -> Column:
    """The kind that a match of ANY is of: the first in order that fits all of it."""
    kind = F.lit("phone")
    for name in [k for k in reversed(PATTERNS) if k != "phone"]:
        kind = F.when(found.rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(kind)
    return kind


def pseudonym(found: Column, key: str) -> Column:
    """Another value of the same format for a match; the match itself where it isn't valid."""
    changes = {"secret": _secret, "email": _email, "iban": _iban, "ip": _ip, "card": _card, "date": _date, "phone": _phone}
    ssn = lambda t, k: in_format(t, "0-9", lambda d: permuted(d, DIGITS, "ssn", k))

    def by_kind(kind: Column) -> Column:
        new = ssn(found, key)
        for name, change in changes.items():
            new = F.when(kind == name, change(found, key)).otherwise(new)
        return new

    return bind(kind_of(found), by_kind)


def replaced(text: Column, key: str) -> Column:
    """Struct (text, found, changed): the text with pseudonyms, the matches, and what each became."""
    matches = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def joined(parts: Column) -> Column:
        whole = F.zip_with(parts["gaps"], parts["new"], lambda gap, new: F.concat(gap, F.coalesce(new, F.lit(""))))
        return F.struct(F.array_join(whole, "").alias("text"), parts["found"].alias("found"), parts["new"].alias("changed"))

    def among(found: Column) -> Column:
        parts = F.struct(
            F.split(text, ANY, -1).alias("gaps"), found.alias("found"), F.transform(found, lambda m: pseudonym(m, key)).alias("new")
        )
        nothing = F.struct(text.alias("text"), found.alias("found"), found.alias("changed"))
        return F.when(F.size(found) > 0, bind(parts, joined)).otherwise(nothing)

    return bind(matches, among)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The rows with their texts replaced, columns and their order as they are."""
    new = replaced(F.col(text_col), key)["text"]
    return docs.select(*(new.alias(c) if c == text_col else docs[c] for c in docs.columns))


def report(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_found, n_replaced, kinds) for every row; kinds are those replaced, sorted, each once."""
    done = docs.select(F.col(id_col).alias("id"), replaced(F.col(text_col), key).alias("done"))
    pairs = F.filter(F.arrays_zip(F.col("done.found"), F.col("done.changed")), lambda p: p["found"] != p["changed"])
    kinds = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: kind_of(p["found"]))))
    return done.select(
        F.col("id").alias(id_col), F.col("done.text").alias("text"), F.size("done.found").cast("long").alias("n_found"),
        F.size(pairs).cast("long").alias("n_replaced"), F.array_join(kinds, ",").alias("kinds"),
    )


def session_key(spark: SparkSession) -> str:
    """The key that the session names, else the one for demonstrations."""
    return spark.conf.get(KEY_SETTING, None) or DEMO_KEY


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms, and what was replaced."""
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), session_key(spark))


QUERIES = {"op4_pii_pseudonyms": op4_pii_pseudonyms}
ORACLES: dict[str, str] = {}
