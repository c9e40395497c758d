"""The block-wise text scores against the column expressions."""
import random

from pyspark.sql import functions as F

from tidewire.functions import obfuscation as ob, scan, text as tx
from tidewire.plans import features as ft

ODD = [None, "", " ", "x", "​", "​​", " ​ ", "a​b тест", "😀😀 текст", "\U0001fae0 abc", "͸ слово",
       "a.ua www.b +380501234567", "+380501234567.com", "+38050123456", "380501234567 +380 0501234567 00501234567", "1" * 40 + "$",
       "12 грн 12₴12$ 3  USD рахунок12 рахунок 1 карта\n5 карти баланс переказ", "http://", "http://x http:// HTTPS://y WWW.z",
       "foo.com/www.x a.b www.q x.ua,y.com ://a www. end. next", "a.comb a.com.b b.UA! .net x.net.", "x.uaslovo x.ua_ X.orGі",
       "паpоль privat24 monobank99 сло2во код7 7код код77 МONOBANK аb ab² ²ab ①а٣b", "Ⅷabc а́b İstanbul ſ K", "УВАГА!!!! ТЕРМІНОВО",
       "заблоковано " * 300 + "click here: bit.ly t.co", "a" * 1001, "я" * 160 + "\r\n\x1c\x85", "ᅟab ឴а ­", "__ _а a_б",
       "x" * 3000 + ".ru " + "1" * 3000 + "."]
LETTERS = ["a", "e", "o", "x", "B", "а", "е", "о", "Б", "і", "0", "1", "3", "7", "٣", "²", "_", " ", " ", "\n", " ", ".", ".", "/", ":", "+",
           "!", "?", "$", "₴", "​", "­", "😀", "漢", "͸", "www.", "http://", ".com", ".ua", "+380", "501234567", "грн",
           "рахунок ", "карта ", "баланс", "увага", "free", "t.co", "privat24", "♥", "ß", "Ω"]


def texts():
    draw = random.Random(5)
    return ODD + ["".join(draw.choices(LETTERS, k=draw.randint(1, 60))) for _ in range(3000)]


def test_scores_equal_the_expressions(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK_CHARS", 5000)
    df = spark.createDataFrame(list(enumerate(texts())), "id int, t string").repartition(4)
    want = df.select("id", *[c.alias(n) for n, c in tx.text_features("t").items()], ob.obfuscation_score("t").alias("message_obfuscation"))
    got = scan.add_text_scores(df, "t", keep_text=False)
    assert sorted(got.schema.names) == sorted(want.schema.names)
    assert {f.name: f.dataType for f in got.schema} == {f.name: f.dataType for f in want.schema}
    left = {r["id"]: r.asDict() for r in want.collect()}
    for r in got.collect():
        for name, value in left.pop(r["id"]).items():
            assert abs(r[name] - value) < 1e-12, (name, value, r)
    assert not left


def test_model_texts_equal_the_expressions(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK_CHARS", 5000)
    more = ["код 1234", "otp\n1234 pin x99999", "мій код: 12 345 code 77777!", "5 uah 12345 грн a12345 12345a 1234567890123 +380501234567",
            "HTTPS://a www.b WWW.c?", "1234 12345678 ٣٣٣٣ x", "\t a  b\x85 "]
    df = spark.createDataFrame(list(enumerate(texts() + more)), "id int, t string").repartition(4)
    want = df.select("id", tx.normalize_text("t", extended=True).alias("processed_text"),
                     *[c.cast("double").alias(f"st_{n}") for n, c in tx.text_model_features("t").items()])
    got = scan.add_model_texts(df, "t")
    assert {f.name: f.dataType for f in got.drop("t").schema} == {f.name: f.dataType for f in want.schema}
    left = {r["id"]: r for r in got.collect()}
    for r in want.collect():
        for name, value in r.asDict().items():
            assert left[r["id"]][name] == value, (name, value, left[r["id"]])
    assert scan.normalize_text("1" * 200_000 + " грн " + "код" * 50_000, True, True).startswith("LONGNUM")
    assert not scan.has_code("код" * 50_000)


def test_long_runs_are_read_once():
    text = "1" * 200_000 + " " + "." * 200_000 + " " + "a." * 100_000 + "$"
    assert scan.financial_patterns(text) == 0
    assert scan.url_count(text) == 0
    assert scan.clean_for_scoring(text + " https://x", text) == text + " https://x"


def test_feature_job_scores_texts_in_blocks(spark):
    rows = spark.createDataFrame([(1, "МONOBANK паpоль https://bit.ly/x", "BANK1", "380501234567", None), (2, None, None, None, "other")],
                                 "id long, message_text string, source_addr string, dest_addr string, category string") \
        .withColumn("timestamp", F.timestamp_seconds(F.lit(0)))
    out = ft.extract_features(rows)
    plan = out._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "regexp_extract_all(message_text" not in plan
    a, b = out.orderBy("id").collect()
    assert (a.message_text, a.suspicious_url, a.message_length) == ("МONOBANK паpоль https://bit.ly/x", 1, 32)
    assert abs(a.message_obfuscation - 0.36) < 1e-9 and (b.empty_message, b.message_obfuscation) == (1, 0.0)
