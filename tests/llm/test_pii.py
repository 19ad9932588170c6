"""Surrogates: what is detected, in which form it is replaced, and that the draws end."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from loomspark.llm import pii


def replaced(spark, texts, key="k"):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r for r in sorted(pii.replaced(d, key).collect(), key=lambda r: r["doc_id"])]


FOUND = {
    "phone": ["+14155550123", "+49 30 1234567", "+33 6 12 34 56 78", "06 12 34 56 78", "+1 (212) 555-0199", "(555) 123-4567", "555-123-4567"],
    "card": ["378282246310005", "3782 822463 10005", "4111111111111111", "4111-1111-1111-1111", "1234 5678 9012 3456", "30569309025904"],
    "ipv6": ["2001:db8:85a3:0:0:8a2e:370:7334", "2001:db8::1", "fe80::1"],
    "ip": ["10.0.0.1"], "ssn": ["123-45-6789"], "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "email": ["a.b@c.example.org", "ünal@bücher.example", "用户@例子.公司", "παύλος@αθήνα.ελ", "مثال@موقع.شبكة"],
    "female": ["Frau Meier", "Mrs Anna Smith", "Г-жа Иванова"], "male": ["Mr Παπαδόπουλος", "Herr Müller", "Mr 王小明"],
}
CLEAN = ["1700000000000 ms", "std::vector a::b", "12:34:56", "v1.2.3.4.5", "the 1234567 items of 2024", "a @ b", "Mr. and", "1234567890123"]


@pytest.fixture(scope="module")
def forms(spark):
    """Kind, value, result row and new value of each form, alone in a sentence; then the rows of the clean texts."""
    values = [(kind, v) for kind, own in FOUND.items() for v in own]
    rows = replaced(spark, [f"see {v}, thanks" for _, v in values] + CLEAN)
    new = [re.fullmatch(r"see (.*), thanks", r["text"])[1] for r in rows[: len(values)]]
    return [(kind, v, r, n) for (kind, v), r, n in zip(values, rows, new)], rows[len(values) :]


def test_forms_of_each_kind(forms):
    for kind, value, r, new in forms[0]:
        assert r[f"n_{kind}"] == r["n_entities"] == 1 and new != value, value
        if kind not in ("female", "male", "ip", "ipv6"):
            shape = lambda t: [(unicodedata.category(c)[0], unicodedata.name(c).split()[0] if c.isalpha() else "") for c in t]
            assert [k for k, _ in shape(new)] == [k for k, _ in shape(value)]
            if kind == "email":
                assert [s for _, s in shape(new)] == [s for _, s in shape(value)]


def test_names_keep_gender_and_script(forms):
    for kind, value, _, new in forms[0]:
        if kind in ("female", "male"):
            title, name = new.split(" ", 1)
            assert title == value.split(" ")[0]
            script = {unicodedata.name(c).split()[0] for c in name if c.isalpha()}
            assert script == {unicodedata.name(c).split()[0] for c in value.split(" ", 1)[1] if c.isalpha()}
            if " " in name:
                assert name.split()[0] in pii.FIRST["female", "latin"]


def test_clean_texts_stay(forms):
    assert [r["text"] for r in forms[1]] == CLEAN


def test_checks_still_pass(forms):
    for kind, value, _, new in forms[0]:
        if kind == "card" and value != "1234 5678 9012 3456":
            assert sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(re.sub(r"\D", "", new)))) % 10 == 0
        if kind == "iban":
            plain = new.replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_one_entity_has_one_surrogate_in_all_texts(spark):
    texts = ["A@B.COM and a@b.com", "a@b.com a@b.com", "call +49 30 1234567 or +49-30-1234567", "Mr John Smith, Mr. John Smith", "Mrs John Smith"]
    found = [r["text"] for r in replaced(spark, texts)]
    mail = {x.lower() for t in found[:2] for x in re.findall(r"\S+@\S+", t)}
    assert len(mail) == 1 and len({re.sub(r"[^0-9]", "", x) for x in re.split(" or |call ", found[2])[1:]}) == 1
    one, two = found[3].split(", ")
    assert one.replace("Mr ", "") == two.replace("Mr. ", "")
    assert replaced(spark, texts, "other")[0]["text"] != found[0]


def test_draws_end_where_a_class_is_full(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    e = spark.createDataFrame([("email", f"{a}@{b}.com") for a in letters for b in letters] + [("email", "用@例.公司")], "kind string, canon string")
    found = pii.assigned(e, "k").toPandas()
    assert len(found) == 677 and found["drawn"].nunique() == 677 and not set(found["drawn"]) & set(found["canon"])


def test_more_names_than_the_first_draw_has(spark):
    e = spark.range(120_000).select(F.lit("female").alias("kind"), F.concat(F.lit("N"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("canon"))
    found = pii.assigned(e, "k").agg(F.count("*").alias("n"), F.count_distinct("drawn").alias("distinct")).first()
    assert (found["n"], found["distinct"]) == (120_000, 120_000)


def test_very_long_matches(spark):
    long = "x@" + "a." * 100_000 + "com"
    runs = ["1 " * 100_000, "+1" * 50_000, "a:" * 100_000, "A" * 100_000 + "@", "Mr " * 50_000, " ".join(f"u{i}@h.com" for i in range(20_000))]
    found = replaced(spark, [long, *runs])
    assert found[0]["n_email"] == 1 and found[0]["text"] != long and len(found[0]["text"]) == len(long)
    assert found[-1]["n_email"] == 20_000 and len(set(found[-1]["text"].split())) == 20_000


def test_one_address_in_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr("loomspark.llm.common.HOT_ROWS", 10)
    found = replaced(spark, [f"write to office@firm.example n {i}" if i % 3 == 0 else f"mine is u{i}@firm.example" for i in range(300)])
    assert len({r["text"].split()[2] for r in found if r["doc_id"] % 3 == 0}) == 1 and len({r["text"].split()[2] for r in found if r["doc_id"] % 3}) == 200
