import random
import re

import brute_pii as brute
from llm_cases import plain
from pyspark.sql import functions as F

from fairlead.llm import pii

TEXTS = [
    "card 4111 1111 1111 1111, 4111-1111-1111-1111 and 4111111111111111", "not a card 4111111111111112", "+1 (386) 555-3733 4795326016703902",
    "Bob.Smith+x9@Example.co.uk or bob.smith+x9@example.co.uk.", "10.0.0.1 256.1.1.1 1.2.3.4.5", "born 1985-02-28, 28.02.1985, 28/02/1985; 1985-02-30",
    "ssn 123-45-6789 000-12-3456", 'token = "9c15af2e04ec61a65151e3d6e2ef256e8fd7e9c3" password=e3b3ed3cc8548923d6 secret: important', "no digits", "", None,
    "+49 30 1234567 555-123-4567 +4915112345678", "v1.2.3 chapter 12 of 1984, 3,000 ships",
]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def run(spark, texts, key="a key"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii.report(df, key).collect()}


def test_formats_stay_valid_and_values_linked(spark):
    rows = run(spark, TEXTS)
    out = [rows[k].text for k in range(len(TEXTS))]
    cards = [re.sub(r"\D", "", c) for c in re.findall(r"[0-9][0-9 -]{14,}[0-9]", out[0])]
    assert len(set(cards)) == 1 and luhn(cards[0]) and cards[0] != "4111111111111111" and cards[0][0] == "4"
    assert out[1] == TEXTS[1] and out[8] == "no digits" and out[9] == "" and out[10] is None and out[12] == TEXTS[12]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} \d{16}", out[2]) and "555-3733" not in out[2]
    a, b = re.findall(r"\S+@\S+[a-z]", out[3])
    assert a.split("@")[0] == b.split("@")[0] != "bob.smith+x9" and a.endswith("@Example.co.uk")
    assert re.fullmatch(r"\d+\.\d+\.\d+\.\d+ 256\.1\.1\.1 1\.2\.3\.4\.5", out[4]) and "10.0.0.1" not in out[4]
    iso = re.findall(r"\d{4}-\d\d-\d\d", out[5])
    y, m, d = iso[0].split("-")
    assert iso[0] != "1985-02-28" and f"{d}.{m}.{y}" in out[5] and f"{d}/{m}/{y}" in out[5] and iso[1] == "1985-02-30"
    assert "123-45-6789" not in out[6] and "000-12-3456" in out[6]
    assert re.fullmatch(r'token = "[0-9a-f]{40}" password=[0-9a-f]{18} secret: important', out[7]) and "9c15af" not in out[7]
    assert [len(o) for o in out if o] == [len(t) if k != 4 else len(out[4]) for k, t in enumerate(TEXTS) if t]
    assert rows[0].n_replaced == 3 and rows[0].kinds == "card"


def test_pseudonyms_differ_and_depend_on_the_key(spark):
    texts = [f"ip 10.1.{k // 250}.{k % 250} tel +1 (212) 555-{k:04d} on {1950 + k % 60}-0{1 + k % 9}-1{k % 10}" for k in range(400)]
    a, b = run(spark, texts), run(spark, texts, "another key")
    for pattern in (r"ip (\S+)", r"tel (\S+ \S+ \S+)"):
        values = [re.search(pattern, a[k].text)[1] for k in range(400)]
        assert len(set(values)) == 400
        assert sum(v == re.search(pattern, b[k].text)[1] for k, v in enumerate(values)) < 4
    dates = {re.search(r"on (\S+)", t)[1]: re.search(r"on (\S+)", a[k].text)[1] for k, t in enumerate(texts)}
    assert len(set(dates.values())) == len(dates) and all(re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", d) for d in dates.values())


def test_bank_accounts(spark):
    rows = run(spark, ["to DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 and GB82 WEST 1234 5698 7654 32", "not DE88 3704 0044 0532 0130 00"])
    found = re.findall(r"[A-Z]{2}\d\d[0-9A-Z ]+[0-9]", rows[0].text)
    bare = [f.replace(" ", "") for f in found]
    assert all(int("".join(str(int(c, 36)) for c in b[4:] + b[:4])) % 97 == 1 for b in bare)
    assert bare[1] == bare[2] != "GB82WEST12345698765432" and bare[1][4:8] == "WEST" and re.fullmatch(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", found[0])
    assert rows[0].n_replaced == 3 and "3704 0044" in rows[1].text


def test_addresses_in_texts_without_digits(spark):
    rows = run(spark, ["write to jane.doe@example.org", "write to jane.doe@example.org in 1984", "a @ b", "_@example.org"])
    found = [re.search(r"\S+@example\.org", rows[k].text)[0] for k in (0, 1)]
    assert found[0] == found[1] != "jane.doe@example.org" and rows[0].kinds == "email" and rows[0].n_replaced == 1
    assert rows[2].text == "a @ b" and rows[3].text == "_@example.org"


def test_small_domains_are_permuted(spark):
    df = spark.range(100).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("d"))
    assert df.select(pii.permuted(F.col("d"), pii.DIGITS, "t", "k").alias("p")).distinct().count() == 100


def test_tables(awkward, none):
    done = pii.pseudonymise(awkward, "k")
    assert done.columns == awkward.columns
    assert sorted(plain(done), key=str) == sorted(plain(awkward), key=str)  # nothing personal in it
    assert pii.pseudonymise(none, "k").count() == 0 and pii.report(none, "k").count() == 0
    assert pii.report(awkward, "k").filter("n_found > 0").count() == 0


def made(rng):
    """A text of values of all kinds, some of them invalid, and words between them."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcxyzÄé😀-_.@'0Z ") for _ in range(rng.randrange(6)))
    body = digits(15)
    valid = body + str(-brute.luhn(body + "0") % 10)
    account = rng.choice(("WEST", "3704")) + digits(14)
    bank = f"GB{brute.check_digits(account, 'GB'):02d}{account}"
    kinds = (
        lambda: valid, lambda: " ".join(valid[k : k + 4] for k in range(0, 16, 4)), lambda: digits(16), lambda: bank,
        lambda: " ".join(bank[k : k + 4] for k in range(0, 22, 4)), lambda: f"GB00{account}", lambda: ".".join(str(rng.randrange(300)) for _ in range(4)),
        lambda: f"{rng.randrange(1800, 2200)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 32):02d}", lambda: f"{rng.randrange(1, 32):02d}.{rng.randrange(1, 13):02d}.{rng.randrange(1900, 2100)}",
        lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: f"+{rng.randrange(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"+{digits(2)} {digits(3)} {digits(6)}", lambda: f"+{digits(11)}",
        lambda: f"{rng.choice(('Jane.Doe', 'x', 'a_b%c'))}{rng.choice(('', digits(2)))}@mail.example.{rng.choice(('org', 'co.uk'))}",
        lambda: f"{rng.choice(('token=', 'API_key: ', 'password = '))}{rng.choice(('', 'Ab/', 'f0'))}{digits(9)}", lambda: f"secret={rng.randbytes(20).hex()}",
    )
    return " ".join(rng.choice(kinds)() + rng.choice((" ", ",", ".", " and ", word())) for _ in range(rng.randrange(12)))


def test_against_plain_python(spark):
    rng = random.Random(12)
    texts = TEXTS + [made(rng) for _ in range(600)]
    rows = run(spark, texts)
    found = [(r.text, r.n_found, r.n_replaced, r.kinds) for r in (rows[k] for k in range(len(texts)))]
    assert found == [brute.replaced(t, "a key") for t in texts]
    kinds = {k for f in found for k in f[3].split(",")}
    assert kinds >= set(pii.PATTERNS)


def test_whoever_holds_the_key_can_invert():
    rng = random.Random(13)
    for alphabet in (pii.DIGITS, pii.HEX, pii.LOWER, pii.MIXED):
        for n in range(1, 80):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert brute.restored(brute.permuted(text, alphabet, "t", "k"), alphabet, "t", "k") == text


def test_the_sessions_key(spark):
    assert pii.session_key(spark) == pii.DEMO_KEY
    spark.conf.set(pii.KEY_SETTING, "mine")
    try:
        assert pii.session_key(spark) == "mine"
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_hostile_lengths(spark):
    rows = run(spark, ["a" * 200_000 + "@", "1" * 100_000, "a.b" * 30_000 + "@x.com", "1.1." * 20_000])
    assert all(r.n_replaced == 0 for r in rows.values())
