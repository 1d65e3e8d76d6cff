"""Pseudonyms by plain Python, to compare those of the expressions with, and their inverse."""

import datetime
import hashlib
import re

from fairlead.llm.pii import DIGITS, HEX, LOWER, MIXED, PATTERNS

ANY = re.compile("|".join(f"(?:{p})" for p in PATTERNS.values()), re.ASCII)
FIRST = datetime.date(1900, 1, 1)


def stream(key, kind, turn, other):
    return hashlib.sha512(f"{key}|{kind}|{turn}|{other}".encode()).hexdigest()


def shifted(part, by, alphabet, sign):
    moved = (alphabet.index(c) + sign * int(by[4 * (j % 32) : 4 * (j % 32) + 4], 16) for j, c in enumerate(part))
    return "".join(alphabet[m % len(alphabet)] for m in moved)


def permuted(text, alphabet, kind, key):
    a, b = text[: len(text) // 2], text[len(text) // 2 :]
    for turn in range(8):
        a, b = b, shifted(a, stream(key, kind, turn, b), alphabet, 1)
    return a + b


def restored(text, alphabet, kind, key):
    a, b = text[: len(text) // 2], text[len(text) // 2 :]
    for turn in reversed(range(8)):
        a, b = shifted(b, stream(key, kind, turn, a), alphabet, -1), a
    return a + b


def in_format(text, wanted, change):
    new = iter(change("".join(c for c in text if re.match(f"[{wanted}]", c))))
    return "".join(next(new) if re.match(f"[{wanted}]", c) else c for c in text)


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def check_digits(body, country):
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def card(text, key):
    digits = re.sub(r"\D", "", text)
    if luhn(digits):
        return text
    body = digits[0] + permuted(digits[1:-1], DIGITS, "card", key)
    return in_format(text, "0-9", lambda _: body + str(-luhn(body + "0") % 10))


def iban(text, key):
    bare = text.replace(" ", "")
    if int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 != 1:
        return text
    new = in_format(bare[4:], "0-9", lambda d: permuted(d, DIGITS, "iban", key))
    return in_format(text, "0-9A-Z", lambda _: f"{bare[:2]}{check_digits(new, bare[:2]):02d}{new}")


def ip(text, key):
    new = permuted("".join(f"{int(o):02x}" for o in text.split(".")), HEX, "ip", key)
    return ".".join(str(int(new[k : k + 2], 16)) for k in range(0, 8, 2))


def date(text, key):
    d = re.sub(r"\D", "", text)
    y, m, day = (d[:4], d[4:6], d[6:]) if re.match(r"\d{4}", text) else (d[4:], d[2:4], d[:2])
    try:
        n = (datetime.date(int(y), int(m), int(day)) - FIRST).days
    except ValueError:
        return text
    if not 0 <= n < 73_049:
        return text
    a, b = n % 17, n // 17
    for turn in range(16):
        by = lambda other, t=turn: int(stream(key, "date", t, other)[:12], 16)
        a, b = ((a + by(b)) % 17, b) if turn % 2 == 0 else (a, (b + by(a)) % 4_297)
    new = FIRST + datetime.timedelta(a + 17 * b)
    shown = f"{new:%Y%m%d}" if re.match(r"\d{4}", text) else f"{new:%d%m%Y}"
    return in_format(text, "0-9", lambda _: shown)


def phone(text, key):
    code = (re.match(r"\+[0-9]{1,3}(?=[ .(-])", text) or [""])[0]
    return code + in_format(text[len(code) :], "0-9", lambda d: permuted(d, DIGITS, "phone", key))


def email(text, key):
    local, _, domain = text.partition("@")
    return in_format(local.lower(), "0-9a-z", lambda s: permuted(s, LOWER, "email", key)) + "@" + domain


def secret(text, key):
    value = re.search("[0-9A-Za-z+/_-]+$", text)[0]
    if re.fullmatch("[0-9a-f]+", value):
        new = permuted(value, HEX, "hex", key)
    else:
        new = in_format(value, "0-9A-Za-z", lambda s: permuted(s, MIXED, "secret", key))
    return text[: len(text) - len(value)] + new


def ssn(text, key):
    return in_format(text, "0-9", lambda d: permuted(d, DIGITS, "ssn", key))


CHANGES = {"card": card, "iban": iban, "ip": ip, "date": date, "phone": phone, "email": email, "secret": secret, "ssn": ssn}


def replaced(text, key):
    """(new text, number of matches, number replaced, their kinds)."""
    found = []

    def change(m):
        kind = next((k for k, p in PATTERNS.items() if k != "phone" and re.fullmatch(p, m[0], re.ASCII)), "phone")
        found.append((kind, m[0], CHANGES[kind](m[0], key)))
        return found[-1][2]

    new = ANY.sub(change, text or "")
    done = {kind for kind, a, b in found if a != b}
    return None if text is None else new, len(found), sum(a != b for _, a, b in found), ",".join(sorted(done))
