"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

E-mail addresses, phone numbers, IPv4 addresses, payment cards, US social security numbers, IBANs and dates are found
by one pattern and validated; each valid value is then permuted within the valid values of its format by a keyed
Feistel network, so that equal values have equal pseudonyms in every document, different values never share one, and
card, IBAN and calendar checks still hold. A network works on pairs from Z_a x Z_b: odd rounds add a keyed hash of the
right half to the left modulo a, even rounds the other way round modulo b. Formats are numbered so that a * b is exactly
the number of valid values (146,097 days of a 400-year cycle are 189 * 773), so nothing has to be walked back into range.

The pattern splits a text into the parts between matches and the matches, and higher-order functions put it together
again, so no row leaves its partition and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

_IPV4 = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Characters that the IBANs of a country have.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_form(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")


_KNOWN = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
_IBANS = "|".join(_iban_form(n, c) for n, c in IBAN_LENGTHS.items())
#: Four groups of four digits, and what can stand beside them as more groups. Digits behind the head of an IBAN are no
#: longer run.
_FOURS = "|".join(rf"\d{{4}}(?:{s}\d{{4}}){{3}}(?!\d)" for s in " -")
_FOURS_AND_MORE = r"(?<![A-Z]{2}\d{2} )(?:" + "|".join(rf"\d{{4}}(?:{s}\d{{4}}){{4,7}}(?!\d)|\d{{4}}(?:{s}\d{{4}}){{3,7}}{s}\d{{1,3}}(?!\d)" for s in " -") + ")"
#: Fixed forms of the kinds, tried in this order. Layouts that are in use come first, looser ones after them.
FORMS = {
    "email": r"[A-Za-z0-9._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "iban": _IBANS + r"|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "ipv4": _IPV4,
    "date": r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone": r"\+\d{1,3}(?:[ .\-]?\(\d{1,4}\)|[ .\-]\d{1,4}|\d{2,4})(?:[ .\-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[ .\-]\d{3}[ .\-]\d{4}",
    "card": rf"{_FOURS_AND_MORE}|{_FOURS}|\d{{15,16}}(?!\d)|\d(?:(?![ \-](?:{_FOURS}))[ \-]?\d){{12,18}}",
}
#: Forms that are tried inside a match that isn't valid as a whole, longer ones first. IBANs of a known country have its
#: length.
PARTS = {
    "iban": [_IBANS, *(rf"(?!{_KNOWN})[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{{k}}}{rest}" for k in range(7, 1, -1) for rest in (" ?[A-Z0-9]{1,3}", ""))],
    "card": [*(rf"\d{{4}}(?:{s}\d{{4}}){{3}}{s}\d{{1,3}}" for s in " -"), _FOURS, *(rf"\d{{4}}{s}\d{{6}}{s}\d{{{n}}}" for s in " -" for n in (5, 4)), r"\d{13,19}"],
}
#: Values that a hyphen can part from another: the two ends of a range. Looking back needs repeats of groups written out.
_OCTET, _BLOCK = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)", r"[ .\-]?\d{2,4}"
_END = "|".join([r"\.".join([_OCTET] * 4), FORMS["date"], FORMS["ssn"], FORMS["phone"].replace(f"(?:{_BLOCK}){{1,4}}", _BLOCK + f"(?:{_BLOCK})?" * 3)])
_AFTER = r"(?![\p{L}\p{N}_])(?![.\-]\d)"
#: Where a value can't begin or end: inside a word, or inside a longer dotted or dashed number that isn't a range.
ANY = (
    rf"(?<![\p{{L}}\p{{N}}_])(?<!\d\.)(?:(?<!\d-)|(?<=(?<![\p{{L}}\p{{N}}_.\-])(?:{_END})-))(?:"
    + "|".join(FORMS.values())
    + rf")(?![\p{{L}}\p{{N}}_])(?!\.\d)(?!-(?!(?:{_END}){_AFTER})\d)"
)


def _int(c: Column) -> Column:
    return c.cast("long")


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def feistel(key: str, tag: Column, left: Column, right: Column, a: Column, b: Column) -> Column:
    """struct(l, r): the image of (left, right) under the permutation of Z_a x Z_b that key and tag choose."""

    def round_(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        seen = F.when(odd, acc["r"]).otherwise(acc["l"])
        add = _int(F.conv(F.substring(_hash(key, tag, i.cast("string"), seen.cast("string")), 1, 15), 16, 10))
        return F.struct(F.when(odd, (acc["l"] + add % a) % a).otherwise(acc["l"]).alias("l"), F.when(odd, acc["r"]).otherwise((acc["r"] + add % b) % b).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(_int(left).alias("l"), _int(right).alias("r")), round_)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pad(n: Column, width: Column | int) -> Column:
    return F.lpad(n.cast("string"), F.lit(width) if isinstance(width, int) else width, F.lit("0"))


def permute_digits(key: str, tag: str, digits: Column) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length."""
    n = F.length(digits)
    half = (n / 2).cast("int")
    power = lambda k: _int(F.rpad(F.lit("1"), k + 1, F.lit("0")))
    out = feistel(key, F.concat(F.lit(tag), n.cast("string")), F.substr(digits, F.lit(1), half), F.substr(digits, half + 1), power(half), power(n - half))
    return _let(out, lambda x: F.concat(_pad(x["l"], half), _pad(x["r"], n - half)))


def _only_digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def laid_out(form: Column, digits: Column) -> Column:
    """form with its digits replaced, in order, by those of digits."""
    places = F.regexp_extract_all(form, F.lit(r"\d|\D+"), F.lit(0))
    step = lambda acc, p: F.when(p.rlike(r"^\d$"), F.struct(F.concat(acc["s"], F.substr(digits, acc["n"], F.lit(1))).alias("s"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(acc["s"], p).alias("s"), acc["n"].alias("n")))
    return F.aggregate(places, F.struct(F.lit("").alias("s"), F.lit(1).alias("n")), step, lambda acc: acc["s"])


# Cards


def luhn_sum(digits: Column) -> Column:
    """The weighted digit sum that is a multiple of 10 for valid numbers."""
    chars = F.reverse(F.split(digits, ""))
    parts = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(parts, F.lit(0), lambda acc, x: acc + x)


def _card(key: str, m: Column) -> Column:
    """The first digit stays, the check digit is computed anew."""

    def of(d: Column) -> Column:
        inner = F.concat(F.substring(d, 1, 1), permute_digits(key, "card", F.substr(d, F.lit(2), F.length(d) - 2)))
        new = _let(inner, lambda x: F.concat(x, ((10 - luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when((F.length(d) <= 19) & (luhn_sum(d) % 10 == 0) & ~d.rlike(r"^(\d)\1*$"), laid_out(m, new))

    return _let(_only_digits(m), of)


# Phone numbers


def _phone(key: str, m: Column) -> Column:
    """North American numbers are permuted among area and exchange codes that begin with 2 to 9, whatever stands before
    them; of other international numbers the country code stays."""

    def national(d: Column) -> Column:
        digit = lambda at, n: _int(F.substr(d, F.length(d) + at, F.lit(n)))
        out = feistel(key, F.lit("nanp"), digit(-9, 3) - 200, (digit(-6, 3) - 200) * 10_000 + digit(-3, 4), F.lit(800), F.lit(8_000_000))
        return _let(out, lambda x: F.concat(F.substr(d, F.lit(1), F.length(d) - 10), (x["l"] + 200).cast("string"), (x["r"] + 2_000_000).cast("string")))

    def of(d: Column) -> Column:
        code = F.length(F.regexp_extract(m, r"^\+(\d{1,3})(?!\d)", 1))
        code = F.when(code == 0, 2).otherwise(code)
        other = F.concat(F.substr(d, F.lit(1), code), permute_digits(key, "phone", F.substr(d, code + 1)))
        new = F.when(d.rlike(r"^1?[2-9]\d{2}[2-9]\d{6}$") & (m.rlike(r"^\+1") | ~m.startswith("+")), national(d)).when(m.startswith("+") & F.length(d).between(7, 15), other)
        return F.when(new.isNotNull(), laid_out(m, new))

    return _let(_only_digits(m), of)


# Addresses, social security numbers, dates, IBANs, e-mail


def _ipv4(key: str, m: Column) -> Column:
    def of(p: Column) -> Column:
        octet = lambda i: _int(F.element_at(p, i))
        out = feistel(key, F.lit("ipv4"), octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), F.lit(65_536), F.lit(65_536))
        low = lambda v: F.concat((v / 256).cast("int").cast("string"), F.lit("."), (v % 256).cast("string"))
        return _let(out, lambda x: F.concat(low(x["l"]), F.lit("."), low(x["r"])))

    return _let(F.split(m, r"\."), of)


def _ssn(key: str, m: Column) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (_int(F.substring(m, at, n)) for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    out = feistel(key, F.lit("ssn"), place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))

    def text(x: Column) -> Column:
        at = (x["l"] / 99).cast("int") + 1
        return F.concat_ws("-", _pad(at + F.when(at >= 666, 1).otherwise(0), 3), _pad(x["l"] % 99 + 1, 2), _pad(x["r"] + 1, 4))

    return F.when(valid, _let(out, text))


#: Pattern of a date, its format to read, and whether day and month may have one digit.
_DATES = ((r"^\d{4}-", "yyyy-MM-dd", "yyyy-MM-dd"), (r"^\d{4}/", "yyyy/MM/dd", "yyyy/MM/dd"), (r"^\d{1,2}\.", "d.M.yyyy", "dd.MM.yyyy"), (r"^(?:0?[1-9]|1[0-2])/", "M/d/yyyy", "MM/dd/yyyy"), (r"^\d{1,2}/", "d/M/yyyy", "dd/MM/yyyy"))


def _date(key: str, m: Column) -> Column:
    """Days from 1800 to 2199. With slashes the month is read first where that is a date."""
    first = F.to_date(F.lit("1800-01-01"))

    def written(format_: str) -> Callable[[Column], Column]:
        def of(day: Column) -> Column:
            n = F.datediff(day, first)
            out = feistel(key, F.lit("date"), (n / 773).cast("int"), n % 773, F.lit(189), F.lit(773))
            return F.when(n.between(0, 146_096), _let(out, lambda x: F.date_format(F.date_add(first, (x["l"] * 773 + x["r"]).cast("int")), format_)))

        return of

    made = F.lit(None).cast("string")
    for pattern, read, write in reversed(_DATES):
        made = F.when(m.rlike(pattern), _let(F.try_to_timestamp(m, F.lit(read)).cast("date"), written(write))).otherwise(made)
    return made


def _mod97(s: Column) -> Column:
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(s, ""), F.lit(0), step)


def _iban(key: str, m: Column) -> Column:
    """The country and all letters stay, digits are permuted, check digits are computed anew."""

    def of(s: Column) -> Column:
        country, account = F.substring(s, 1, 2), F.substr(s, F.lit(5))
        digits = _only_digits(account)
        inner = F.when(F.length(digits) > 1, laid_out(account, permute_digits(key, "iban", digits)))
        new = _let(inner, lambda x: F.concat(country, _pad(98 - _mod97(F.concat(x, country, F.lit("00"))), 2), x))
        valid = (_mod97(F.concat(account, F.substring(s, 1, 4))) == 1) & F.length(s).between(15, 34)
        return F.when(valid & inner.isNotNull(), _let(new, lambda x: _spaced(m, x)))

    return _let(F.regexp_replace(m, " ", ""), of)


def _spaced(form: Column, s: Column) -> Column:
    """s with spaces where form has them."""
    step = lambda acc, c: F.when(c == " ", F.struct(F.concat(acc["s"], c).alias("s"), acc["n"].alias("n"))).otherwise(F.struct(F.concat(acc["s"], F.substr(s, acc["n"], F.lit(1))).alias("s"), (acc["n"] + 1).alias("n")))
    return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("n")), step, lambda acc: acc["s"])


def _email(key: str, m: Column) -> Column:
    """The domain stays. The local part's letters and digits are shifted within small letters, capitals or digits, half
    by half, by a keyed hash of the other half and the classes of its characters."""

    def of(local: Column) -> Column:
        half = F.greatest((F.length(local) / 2).cast("int"), F.lit(1))
        shape = F.translate(F.translate(F.translate(local, "bcdefghijklmnopqrstuvwxyz", "a" * 25), "BCDEFGHIJKLMNOPQRSTUVWXYZ", "A" * 25), "123456789", "0" * 9)

        def shifted(part: Column, h: Column) -> Column:
            def char(c: Column, i: Column) -> Column:
                by, code = F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int"), F.ascii(c)
                turn = lambda low, n: F.char(((code - low + by) % n + low).cast("long"))
                return F.when(c.rlike("^[a-z]$"), turn(97, 26)).when(c.rlike("^[A-Z]$"), turn(65, 26)).when(c.rlike("^[0-9]$"), turn(48, 10)).otherwise(c)

            return F.array_join(F.transform(F.filter(F.split(part, ""), lambda c: c != ""), char), "")

        def round_(acc: Column, i: Column) -> Column:
            odd = i % 2 == 1
            h = _hash(key, F.lit("email"), shape, i.cast("string"), F.when(odd, acc["r"]).otherwise(acc["l"]))
            new = shifted(F.when(odd, acc["l"]).otherwise(acc["r"]), h)
            return F.struct(F.when(odd, new).otherwise(acc["l"]).alias("l"), F.when(odd, acc["r"]).otherwise(new).alias("r"))

        start = F.struct(F.substr(local, F.lit(1), half).alias("l"), F.substr(local, half + 1).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, lambda acc: F.concat(acc["l"], acc["r"]))

    at = F.instr(m, "@")
    return F.concat(_let(F.substr(m, F.lit(1), at - 1), of), F.substr(m, at))


_KINDS = {"email": _email, "iban": _iban, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _inside(key: str, m: Column, kind: str) -> Column:
    """array of struct(kind, value) that is m in pieces: the valid values of a kind among PARTS, and what is between."""
    piece = lambda k, v: F.struct(F.lit(k).cast("string").alias("kind"), v.alias("value"))
    rest = lambda p: F.substr(m, p)
    starts = F.filter(F.sequence(F.lit(1), F.length(m)), lambda p: (p == 1) | ~F.substr(m, p - 1, F.lit(1)).rlike("[A-Z0-9]"))
    tried = lambda p: F.transform(F.array(*(F.regexp_extract(rest(p), f"^(?:{x})(?![A-Z0-9])", 0) for x in PARTS[kind])), lambda c: F.struct(p.alias("at"), c.alias("text")))
    found = F.filter(F.flatten(F.transform(starts, tried)), lambda c: c["text"] != "")
    found = F.transform(found, lambda c: F.struct(c["at"].alias("at"), F.length(c["text"]).alias("n"), _KINDS[kind](key, c["text"]).alias("value")))
    none = F.array().cast("array<struct<kind:string,value:string>>")

    def step(acc: Column, c: Column) -> Column:
        more = F.concat(acc["made"], F.array(piece(None, F.substr(m, acc["at"], c["at"] - acc["at"])), piece(kind, c["value"])))
        return F.when(c["value"].isNotNull() & (c["at"] >= acc["at"]), F.struct((c["at"] + c["n"]).alias("at"), more.alias("made"))).otherwise(acc)

    return F.aggregate(found, F.struct(F.lit(1).alias("at"), none.alias("made")), step, lambda acc: F.concat(acc["made"], F.array(piece(None, rest(acc["at"])))))


def pseudonym(key: str, m: Column) -> Column:
    """array of struct(kind, value) for a match of ANY. A match can have the form of several kinds; the first that it is
    valid for holds. One that isn't valid as a whole is searched for shorter values; what is none has a null kind."""
    named = lambda kind: lambda v: F.when(v.isNotNull(), F.array(F.struct(F.lit(kind).alias("kind"), v.alias("value"))))
    tried = [F.when(m.rlike(f"^(?:{FORMS[k]})$"), _let(make(key, m), named(k))) for k, make in _KINDS.items()]
    shorter = [F.when(m.rlike(f"^(?:{FORMS[k]})$"), _inside(key, m, k)) for k in PARTS]
    return F.coalesce(*tried, *shorter, F.array(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value"))))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", found_col: str = "pii") -> DataFrame:
    """docs with text_col rewritten, and found_col: array of struct(kind, value), the pseudonyms in order.

    Texts without valid values are unchanged, empty ones too; null texts stay null and have an empty array. All other
    columns and rows, repeated ones too, stay as they are; a column named found_col is replaced. The key is a secret:
    with it the permutations can be undone.
    """
    if not key:
        raise ValueError("an empty key protects nothing")
    text = F.col(f"`{text_col}`")
    some = text.rlike("[0-9@]")
    found = F.when(some, F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: pseudonym(key, m)))
    made = docs.withColumn("_found", found)
    written = F.transform(F.col("_found"), lambda x: F.array_join(F.transform(x, lambda y: y["value"]), ""))
    parts = F.zip_with(F.split(text, ANY, -1), written, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    kept = F.filter(F.flatten("_found"), lambda x: x["kind"].isNotNull())
    new = F.when(F.size(kept) > 0, F.array_join(parts, "")).otherwise(text)
    valid = F.coalesce(kept, F.array().cast("array<struct<kind:string,value:string>>"))
    return made.withColumns({text_col: new, found_col: valid}).drop("_found")


#: Stands in for a deployment's secret.
DEMO_KEY = "an example, not a secret"


def op2_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = pseudonymize(table(spark, sf_dir, "documents"), DEMO_KEY)
    return out.select("doc_id", F.size("pii").cast("long").alias("n_found"), F.array_join(F.transform("pii", lambda x: x["kind"]), ",").alias("kinds"), F.array_join(F.transform("pii", lambda x: x["value"]), "\n").alias("pseudonyms"), "text")
