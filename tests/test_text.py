import math

from pyspark.sql import functions as F

from tidewire.functions import obfuscation as ob, sender as sn, text as tx


def one(spark, value, *cols):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_obfuscation_words(spark):
    cases = {"паpоль": 0.6, "аb": 1.0, "сло2во": 0.1, "код7": 0.2, "7код": 0.1, "код77": 0.0,
             "МONOBANK": 0.6, "MONOBANK": 0.0, "ба": 0.0}
    df = spark.createDataFrame([(w,) for w in cases], "w string")
    got = {r.w: r.s for r in df.select("w", ob.word_score("w").alias("s")).collect()}
    assert {w: round(s, 6) for w, s in got.items()} == cases


def test_message_score(spark):
    rows = {"x": 0.0, "   ": 0.0, "privat24": 0.0, "паpоль": 0.36, "a​b тест": 0.17,
            "a.ua www.b +380501234567": 0.0, "😀😀 текст": 0.0}
    df = spark.createDataFrame([(w,) for w in rows], "w string")
    got = {r.w: round(r.s, 6) for r in df.select("w", ob.obfuscation_score("w").alias(
        "s")).collect()}
    assert got == rows
    assert one(spark, "a​b тест", ob.obfuscation_score("t", "literal"))[0] < 0.1


def test_combined(spark):
    df = spark.createDataFrame([(0.4, 0.4), (0.8, 0.1), (0.2, 0.1), (0.9, 0.9)],
                               "m double, s double")
    got = [round(r[0], 6) for r in df.select(ob.combined_obfuscation("m", "s")).collect()]
    assert got == [0.8, 0.64, 0.155, 1.0]


def test_text_features(spark):
    text = "УВАГА!!!! ТЕРМІНОВО рахунок 12 100 грн https://bit.ly/x www.a.ua +380501234567"
    f = tx.text_features("t")
    names = list(f)
    row = dict(zip(names, one(spark, text, *f.values())))
    assert row["suspicious_word_count"] == 2 and row["url_count"] == 2
    assert row["suspicious_url"] == 1 and row["urgency_score"] == 1.0
    assert row["financial_patterns"] == 2 and row["phone_numbers"] == 1
    counts = {c: text.count(c) for c in set(text)}
    bits = -sum(k / len(text) * math.log2(k / len(text)) for k in counts.values())
    assert abs(row["message_entropy"] - min(bits / 5, 1)) < 1e-9
    empty = dict(zip(names, one(spark, None, *f.values())))
    assert empty["empty_message"] == 1 and empty["message_entropy"] == 0.0


def test_url_pattern_matches_plain_regex(spark):
    import re
    plain = re.compile(r"https?://[^\s]+|www\.[^\s]+|[^\s]+\.[a-z]{2,}")
    texts = ["foo.com/www.x a.b www.q", "x.ua,y.com http://", "://a www.", "a.bc.de fg.h ij.kl/http://m",
             "нова.пошта a.ua", "end. next"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(tx.url_count("t")).collect()]
    assert got == [len(plain.findall(t.lower())) for t in texts]


def test_normal_forms(spark):
    row = one(spark, "  Код 123456  сума 50 грн www.a.ua тел 38050123456x ", tx.normalize_text("t"),
              tx.normalize_text("t", extended=True))
    assert row[0] == "код LONGNUM сума MONEY www.a.ua тел PHONEx"
    assert row[1] == "код LONGNUM сума MONEY URL тел PHONEx"


def test_sender_rules(spark):
    df = spark.createDataFrame([("M0NOBANK",), ("MONOBANK",), ("MONOBANK24",), ("AB1",), ("AAAA",),
                                ("",)], "s string")
    bank = F.lit("banking")
    got = [tuple(r) for r in df.select(
        sn.typosquatting("s", bank), sn.sender_legitimacy("s", bank),
        sn.source_category_mismatch("s", bank), sn.unusual_sender_pattern("s")).collect()]
    assert got == [(1.0, 0.0, 1, 0), (0.0, 1.0, 0, 0), (0.0, 0.7, 0, 0), (0.0, 0.0, 1, 1),
                   (1.0, 0.0, 1, 1), (0.0, 0.0, 0, 0)]  # AAAA is two characters from ALFA


def test_time_rules(spark):
    df = spark.createDataFrame([(5, 4), (9, 4), (18, 4), (22, 5)], "h int, d int")
    flags = lambda p: [tuple(r) for r in df.select(
        *[c.alias(n) for n, c in sn.time_flags("h", "d", p).items()]).collect()]
    assert flags("ingest") == [(1, 0, 0), (0, 0, 1), (0, 0, 1), (1, 1, 0)]
    assert flags("feature") == [(1, 0, 0), (0, 0, 1), (0, 0, 0), (0, 1, 0)]
