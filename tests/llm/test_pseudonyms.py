import datetime as dt
import re

from pyspark.sql import functions as F

from sensorframe.llm import pseudonyms as P


def luhn(s):
    total = 0
    for k, c in enumerate(reversed(s)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def apply(docs_of, texts):
    rows = P.pseudonymise(docs_of(list(enumerate(texts))), count="n").orderBy("doc_id").collect()
    return [(r.text, r.n) for r in rows]


def test_formats_are_kept(docs_of):
    texts = ["card 4569074906673314, 4569-0749-0667-3314.", "x 192.168.0.1 y", "+1 (976) 555-9947 or 976-555-9947", "123-45-6789", "2024-02-29, 29.02.2024 29/02/2024", "a.b99@Foo9.bar.com!"]
    got = apply(docs_of, texts)
    assert [n for _, n in got] == [2, 1, 2, 1, 3, 1]
    for (text, _), was in zip(got, texts, strict=True):
        shape = lambda s: re.sub("[0-9]+" if "192" in was else "[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", s)))
        assert shape(text) == shape(was)
    cards = re.findall(r"[0-9][0-9-]+", got[0][0])
    assert all(luhn(c.replace("-", "")) for c in cards) and cards[1].replace("-", "") == cards[0]
    assert len(set(re.findall(r"[0-9]{3}[) -]+[0-9]{3}-[0-9]{4}", got[2][0].replace(") ", "-").replace("(", "")))) == 1
    assert all(int(p) < 256 for p in got[1][0].split()[1].split("."))
    iso, dots, _ = re.split("[, ]+", got[4][0])
    assert dt.date.fromisoformat(iso) == dt.datetime.strptime(dots, "%d.%m.%Y").date()


def test_what_fails_its_check_stays(docs_of):
    texts = ["4569074906673315", "300.1.1.1 01.2.3.4 1.2.3.4.5", "(976) 155-9947", "000-12-1234 666-12-1234 123-00-1234", "2023-02-29 31.04.2020 1799-12-31", "x@y @a.b", "", "2292759423dee90163", "v1.2.3 12345"]
    assert apply(docs_of, texts) == [(t, 0) for t in texts]


def test_null_repeats_long_and_other_columns(docs_of):
    long = "word " * 50000 + "4569074906673314"
    docs = docs_of([(1, None), (None, "4569074906673314"), (2, "4569074906673314"), (2, "4569074906673314"), (3, long)])
    out = P.pseudonymise(docs, length="n_chars")
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    rows = out.collect()
    values = {r.text[-16:] for r in rows if r.text}
    assert len(values) == 1 and values != {"4569074906673314"} and sum(r.text is None for r in rows) == 1
    assert P.pseudonymise(docs_of([]), count="n").collect() == []


def test_permutations(spark):
    low, high = 27, 5411
    ids = spark.range(low * high).select(P.feistel(F.col("id"), low, high, F.lit("k"), "date").alias("v"))
    assert tuple(ids.agg(F.countDistinct("v"), F.min("v"), F.max("v")).first()) == (low * high, 0, low * high - 1)
    text = F.concat(F.lit("a"), F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("-Z"))
    got = spark.range(1000).select(P.feistel_text(text, F.lit("k"), "mail").alias("v"))
    assert got.distinct().count() == 1000 and got.where(~F.col("v").rlike("^[a-z][0-9]{3}-[A-Z]$")).count() == 0
    keys = spark.range(50).select(P.feistel(F.col("id"), low, high, F.lit("k"), "date").alias("x"), P.feistel(F.col("id"), low, high, F.lit("other"), "date").alias("y"))
    assert keys.where("x = y").count() < 5


def test_only_sql_expressions(docs_of):
    plan = P.pseudonymise(docs_of([(1, "x")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_values_that_stand_alone_in_a_text(docs_of):
    samples = {"mail": ["a@b.c"], "address": ["1.2.3.4", "192.168.0.1"], "date": ["1990-05-12", "12.05.1990", "12/05/1990"], "ssn": ["123-45-6789"],
               "phone": ["976-555-9947", "976.555.9947", "976 555 9947", "(976)555-9947", "+1 (976) 555-9947", "+1976.555.9947"],
               "card": ["4569074906673314", "4569-0749-0667-3314", "4569 0749 0667 3314"]}
    assert set(samples) == set(P.SHAPES)
    for kind, values in samples.items():
        assert all(re.search(P.SHAPES[kind], v) and re.search(P.MAYBE, v) for v in values), kind
    texts = [f"born {v} in Rome" for values in samples.values() for v in values]
    assert [n for _, n in apply(docs_of, texts)] == [1] * len(texts)


def test_cards_beside_other_numbers(docs_of):
    card, other = "4111 1111 1111 1111", "5500 0000 0000 0004"
    values = ["2024-01-02", "123-45-6789", "976-555-9947", "+1 (976) 555-9947", "192.168.0.1", "12.05.1990", "123@x.com"]
    alone, second, *made = (t for t, _ in apply(docs_of, [card, other, *values]))
    around = [("card ", " 123"), ("", " 12 items"), ("7 ", ""), ("12345 ", ""), ("1 2 3 ", " 4 5 6"), ("99 ", " 1234 99"), ("1234567890123456 ", " 12")]
    want = {a + card + b: (a + alone + b, 1) for a, b in around}
    want |= {a + card.replace(" ", "") + b: (a + alone.replace(" ", "") + b, 1) for a, b in around}
    want |= {f"{card} {other}": (f"{alone} {second}", 2), f"7 {card} 123 {other} 12": (f"7 {alone} 123 {second} 12", 2)}
    for value, m in zip(values, made, strict=True):
        want |= {f"{card} {value}": (f"{alone} {m}", 2), f"{value} {card}": (f"{m} {alone}", 2), f"12345 {value} 12345 {card}": (f"12345 {m} 12345 {alone}", 2)}
    assert apply(docs_of, list(want)) == list(want.values())


def test_long_runs_of_numbers(docs_of):
    numbers = " 1 2 3" * 3000
    assert apply(docs_of, [f"4569074906673314{numbers}"])[0][1] >= 1


def test_low_phones_with_a_country_code_and_month_first(docs_of, spark):
    texts = ["+1 (017) 555-7713", "1-976-155-9947", "12/25/1990", "02.29.2024", "(017) 555-7713", "02/30/2024"]
    got = apply(docs_of, texts)
    assert [n for _, n in got] == [1, 1, 1, 1, 0, 0]
    for (text, _), was in zip(got[:4], texts, strict=False):
        assert re.sub("[0-9]", "9", text) == re.sub("[0-9]", "9", was)
    for text, _ in got[:2]:
        ten = re.sub("[^0-9]", "", text)[1:]
        assert len(ten) == 10 and (int(ten[:3]) < 200 or int(ten[3:6]) < 200)
    assert dt.datetime.strptime(got[2][0], "%m/%d/%Y").day > 12 and dt.datetime.strptime(got[3][0], "%m.%d.%Y").day > 12
    days = spark.range(146_097).select(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).alias("d")).where("day(d) > 12")
    made = days.select(P._late_day(F.col("d"), F.lit("k")).alias("d")).where("day(d) > 12 and year(d) between 1800 and 2199")
    assert made.distinct().count() == days.count() == 9 * 9833
