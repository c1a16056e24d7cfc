import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quire.llm import pii


def model(key, tag, left, right, a, b):
    """The network as plain arithmetic."""
    for i in range(1, pii.ROUNDS + 1):
        seen = right if i % 2 else left
        add = int(hashlib.sha256(f"{key}|{tag}|{i}|{seen}".encode()).hexdigest()[:15], 16)
        if i % 2:
            left = (left + add) % a
        else:
            right = (right + add) % b
    return left, right


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, [tuple(x) for x in r.pii]) for r in pii.pseudonymize(df, "k").orderBy("doc_id").collect()]


def test_networks_are_permutations(spark):
    df = spark.range(100).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("d"))
    out = [r[0] for r in df.select(pii.permute_digits("k", "t", F.col("d"))).collect()]
    assert sorted(out) == [f"{i:02d}" for i in range(100)]
    assert out == ["%d%d" % model("k", "t2", i // 10, i % 10, 10, 10) for i in range(100)]
    days = spark.range(0, 146_097, 1, 4).select(pii.feistel("k", F.lit("date"), (F.col("id") / 773).cast("int"), F.col("id") % 773, F.lit(189), F.lit(773)).alias("x"))
    assert days.select("x.l", "x.r").distinct().count() == 146_097


def test_values_keep_their_checks(spark):
    texts = [
        "a 4041894974608795 b", "4041 8949 7460 8795", "4041894974608796", "DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19.",
        "ip 42.144.35.254!", "42.144.35.256 1.2.3", "123-45-6789", "666-12-3456 000-12-3456", "2020-02-29", "2021-02-29", "31/12/1999 12/31/1999",
    ]
    got = run(spark, texts)
    card, spaced = got[0][1][0][1], got[1][1][0][1]
    assert got[0][0] == f"a {card} b" and luhn(card) % 10 == 0 and card[0] == "4" and card != "4041894974608795" and spaced.replace(" ", "") == card
    assert got[2] == (texts[2], [])
    for i in (3, 4):
        new = got[i][1][0][1].replace(" ", "")
        assert mod97(new) == 1 and new[:2] == texts[i][:2] and new != texts[i].replace(" ", "").strip(".")
    ip = got[5][1][0][1]
    assert got[5][0] == f"ip {ip}!" and all(0 <= int(x) < 256 for x in ip.split("."))
    assert got[6] == (texts[6], []) and got[8] == (texts[8], []) and got[10] == (texts[10], [])
    area, group, serial = map(int, got[7][1][0][1].split("-"))
    assert area not in (0, 666) and area < 900 and group and serial
    assert re.fullmatch(r"(18|19|20|21)\d\d-\d\d-\d\d", got[9][0])
    (_, a), (_, b) = got[11][1]
    assert {tuple(a.split("/")[:2][::-1]), tuple(b.split("/")[:2])}.__len__() == 1 and a[-4:] == b[-4:]


def test_mail_and_phones(spark):
    got = run(spark, ["bosbt.42@mail8.example.com, x", "call +1 (988) 555-2485 or 988-555-2485", "+44 20 7946 0958", "bosbt.42@mail8.example.com"])
    assert re.fullmatch(r"[a-z]{5}\.\d\d@mail8\.example\.com, x", got[0][0]) and got[0][1] == got[3][1] and "bosbt" not in got[0][0]
    (_, a), (_, b) = got[1][1]
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", a) and re.sub(r"\D", "", a)[1:] == re.sub(r"\D", "", b)
    assert re.fullmatch(r"\+44 \d\d \d{4} \d{4}", got[2][0])


def test_the_rest_of_a_text_stays(spark):
    texts = ["", None, "no data, 12 or 3.5 @ all", "x" * 50_000 + " 42.144.35.254 " + "1" * 5000 + "\n", "42.144.35.254", "42.144.35.254"]
    got = run(spark, texts)
    assert got[:3] == [("", []), (None, []), (texts[2], [])]
    ip = got[3][1][0][1]
    assert got[3][0] == texts[3].replace("42.144.35.254", ip) and got[4][0] == got[5][0] == ip


def test_columns_and_cases(spark):
    df = spark.createDataFrame([(1, "42.144.35.254", "a", "b")], "id long, body string, _found2 string, pii string")
    out = pii.pseudonymize(df, "k", text_col="body", found_col="hits")
    assert out.columns == ["id", "body", "_found2", "pii", "hits"] and out.first().pii == "b"
    assert pii.pseudonymize(df.limit(0), "k", text_col="body").count() == 0
    assert run(spark, ["42.144.35.254"]) != [(r.body, [tuple(x) for x in r.hits]) for r in pii.pseudonymize(df, "other", text_col="body", found_col="hits").collect()]
    with pytest.raises(ValueError):
        pii.pseudonymize(df, "")
    plan = out._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_values_beside_other_text(spark):
    card = "4041 8949 7460 8795"
    texts = [f"{card} 12/26", f"{card} 123", f"{card} 12", f"no 12 {card}", f"1234 {card} 123", f"{card} {card}", f"{card}, 4041-8949-7460-8795 x", "4041894974608795 123", "3782 822463 10005 1234"]
    for t, (new, found) in zip(texts, run(spark, texts), strict=True):
        kinds = {k for k, _ in found}
        assert kinds == {"card"} and card not in new and "4041894974608795" not in new and "822463" not in new, t
    one = run(spark, [card])[0][0]
    got = run(spark, texts)
    assert [got[i][0] for i in (0, 3, 5)] == [f"{one} 12/26", f"no 12 {one}", f"{one} {one}"]
    ibans = ["ES9121000418450200051332", "AT611904300234573201", "BE68539007547034", "SE4550000000058398257466", "PL61109010140000071219812874"]
    for iban, (new, found) in zip(ibans, run(spark, [f"{i} BIC" for i in ibans]), strict=True):
        assert [k for k, _ in found] == ["iban"] and new == found[0][1] + " BIC" and mod97(found[0][1]) == 1 and iban not in new
    spaced = " ".join(ibans[0][i : i + 4] for i in range(0, 24, 4))
    assert run(spark, [f"{spaced} CODE"])[0][1][0][1].replace(" ", "") == run(spark, [ibans[0]])[0][0]
    ranges = ["12/05/2020-13/05/2020", "192.168.0.1-192.168.0.20", "2020-01-01-2020-02-01"]
    for t, (new, found) in zip(ranges, run(spark, ranges), strict=True):
        assert len(found) == 2 and new == "-".join(v for _, v in found) and not set(t.split("-", 1)) & {v for _, v in found}
    kept = ["192.168.0.1-20", "1.2.3.4.5", "12/05/2020-13", "1-2020-01-01", "2020-01-01-5"]
    assert run(spark, kept) == [(t, []) for t in kept]
