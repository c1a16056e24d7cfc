"""Pseudonyms against a plain version of every kind, over texts with planted values."""

import datetime
import hashlib
import random

import regex

from quire.llm import pii

KEY = "k"


def digest(*parts):
    return hashlib.sha256("|".join([KEY, *map(str, parts)]).encode()).hexdigest()


def network(tag, left, right, a, b):
    for i in range(1, pii.ROUNDS + 1):
        add = int(digest(tag, i, right if i % 2 else left)[:15], 16)
        left, right = ((left + add) % a, right) if i % 2 else (left, (right + add) % b)
    return left, right


def digits(tag, d):
    n, half = len(d), len(d) // 2
    a, b = network(f"{tag}{n}", int(d[:half]), int(d[half:]), 10**half, 10 ** (n - half))
    return str(a).zfill(half) + str(b).zfill(n - half)


def fill(form, d):
    it = iter(d)
    return "".join(next(it) if c.isdigit() else c for c in form)


def luhn(d):
    r = [int(c) for c in reversed(d)]
    return sum(r[::2]) + sum(x * 2 - 9 * (x > 4) for x in r[1::2])


def card(m):
    d = regex.sub(r"\D", "", m)
    if luhn(d) % 10 or len(set(d)) == 1:
        return None
    new = d[0] + digits("card", d[1:-1])
    return fill(m, new + str((10 - luhn(new + "0") % 10) % 10))


def phone(m):
    d = regex.sub(r"\D", "", m)
    if regex.fullmatch(r"1?[2-9]\d{2}[2-9]\d{6}", d) and (m.startswith("+1") or m[0] != "+"):
        a, b = network("nanp", int(d[-10:-7]) - 200, (int(d[-7:-4]) - 200) * 10_000 + int(d[-4:]), 800, 8_000_000)
        return fill(m, d[:-10] + str(a + 200) + str(b + 2_000_000))
    if m[0] == "+" and 7 <= len(d) <= 15:
        code = len((regex.match(r"\+(\d{1,3})(?!\d)", m) or [None, "00"])[1])
        return fill(m, d[:code] + digits("phone", d[code:]))
    return None


def ipv4(m):
    o = [int(x) for x in m.split(".")]
    a, b = network("ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], 65_536, 65_536)
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def ssn(m):
    a, g, s = map(int, m.split("-"))
    if not (1 <= a <= 899 and a != 666 and g and s):
        return None
    x, y = network("ssn", (a - 1 - (a > 666)) * 99 + g - 1, s - 1, 898 * 99, 9999)
    at = x // 99 + 1
    return f"{at + (at >= 666):03d}-{x % 99 + 1:02d}-{y + 1:04d}"


def date(m):
    for form, write in (("%Y-%m-%d", "%Y-%m-%d"), ("%Y/%m/%d", "%Y/%m/%d"), ("%d.%m.%Y", "%d.%m.%Y"), ("%m/%d/%Y", "%m/%d/%Y"), ("%d/%m/%Y", "%d/%m/%Y")):
        try:
            day = datetime.datetime.strptime(m, form).date()
        except ValueError:
            continue
        n = (day - datetime.date(1800, 1, 1)).days
        if not 0 <= n <= 146_096:
            return None
        a, b = network("date", n // 773, n % 773, 189, 773)
        return (datetime.date(1800, 1, 1) + datetime.timedelta(days=a * 773 + b)).strftime(write)
    return None


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def iban(m):
    s = m.replace(" ", "")
    d = regex.sub(r"\D", "", s[4:])
    if not 15 <= len(s) <= 34 or mod97(s[4:] + s[:4]) != 1 or len(d) < 2:
        return None
    new = fill(s[4:], digits("iban", d))
    out = iter(s[:2] + f"{98 - mod97(new + s[:2] + '00'):02d}" + new)
    return "".join(c if c == " " else next(out) for c in m)


def email(m):
    local, rest = m.split("@")
    half = max(1, len(local) // 2)
    left, right = local[:half], local[half:]
    shape = regex.sub("[0-9]", "0", regex.sub("[A-Z]", "A", regex.sub("[a-z]", "a", local)))

    def shift(part, h):
        out = ""
        for i, c in enumerate(part):
            low, n = (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (48, 10) if c.isdigit() else (0, 0)
            out += chr((ord(c) - low + int(h[i * 2 : i * 2 + 2], 16)) % n + low) if n else c
        return out

    for i in range(1, pii.ROUNDS + 1):
        h = digest("email", shape, i, right if i % 2 else left)
        left, right = (shift(left, h), right) if i % 2 else (left, shift(right, h))
    return f"{left}{right}@{rest}"


KINDS = {"email": email, "iban": iban, "ipv4": ipv4, "date": date, "ssn": ssn, "phone": phone, "card": card}
ANY = regex.compile(pii.ANY)


def plain(t):
    found = []

    def one(m):
        for kind, f in KINDS.items():
            if regex.fullmatch(pii.FORMS[kind], m[0]) and (new := f(m[0])) is not None:
                found.append((kind, new))
                return new
        return m[0]

    return ANY.sub(one, t), found


def value(rnd):
    n = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    kind = rnd.randrange(9)
    if kind == 0:
        d = rnd.choice("3456") + n(14)
        d += str((10 - luhn(d + "0") % 10) % 10) if rnd.random() < 0.8 else "0"
        return d if rnd.random() < 0.5 else "-".join(d[i : i + 4] for i in range(0, 16, 4))
    if kind == 1:
        return rnd.choice([f"+1 ({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"+{rnd.randint(1, 999)} {n(2)} {n(4)} {n(4)}", f"({n(3)}) {n(3)}.{n(4)}"])
    if kind == 2:
        return ".".join(str(rnd.randint(0, 260)) for _ in range(4))
    if kind == 3:
        return f"{n(3)}-{n(2)}-{n(4)}"
    if kind == 4:
        y, m, d = rnd.randint(1700, 2300), rnd.randint(1, 13), rnd.randint(1, 31)
        return rnd.choice([f"{y}-{m:02d}-{d:02d}", f"{m}/{d}/{y}", f"{d}.{m}.{y}", f"{y}/{m:02d}/{d:02d}", f"{d:02d}/{m:02d}/{y}"])
    if kind == 5:
        account = n(18)
        s = f"DE{98 - mod97(account + 'DE00'):02d}{account}"
        return s if rnd.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, 22, 4))
    if kind == 6:
        return "".join(rnd.choice("abcXYZ09._") for _ in range(rnd.randint(1, 20))) + rnd.choice(["@mail8.example.com", "@x.org", "@nodot"])
    return rnd.choice(["words", "é1", "v1.2.3", "x" * 40, n(5), "a@b", "(12)", "#", "12:30"])


def test_against_a_plain_version(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(["", " ", ", ", "\n", ".", "(", "é"]) + value(rnd) for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.text, [tuple(x) for x in r.pii]) for r in pii.pseudonymize(df, KEY).orderBy("doc_id").collect()]
    want = [plain(t) for t in texts]
    assert {k for _, f in want for k, _ in f} == set(KINDS)
    for t, g, w in zip(texts, got, want, strict=True):
        assert g == w, t
