"""Language identification: texts of known languages are kept, others go, at every length."""
import base64
import random

from tidewire.llm import langid

SYLLABLES = {"aa": "the an er in tion ou st re sh ly".split(), "bb": "der ein ung ß ver lich keit ü be ä".split(),
             "cc": "el la ción ñ os ar mente do ó que".split()}
UNKNOWN = {"han": [chr(c) for c in range(0x4E00, 0x9FA5)], "cyrillic": [chr(c) for c in range(0x430, 0x450)],
           "greek": [chr(c) for c in range(0x3B1, 0x3CA)], "latin": list("abcdefghijklmnopqrstuvwxyz"),
           "polish": "wszy scy lu dzie ro dzą się wol ni rów ni pod wzglę dem swej god noś ci".split()}
LENGTHS = (10, 20, 50, 200, 1000, 5000)


def _text(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(n))


def test_unknown_languages_are_rejected(spark):
    rng = random.Random(7)
    known = [(_text(rng, SYLLABLES[k], rng.choice((3, 30, 200, 800))), k) for k in SYLLABLES for _ in range(120)]
    model = langid.fit(spark.createDataFrame([(i, *r) for i, r in enumerate(known)],
                                             "doc_id long, text string, lang string"))
    cases = [(_text(rng, parts, n), name, n) for name, parts in UNKNOWN.items() for n in LENGTHS]
    cases += [(base64.b64encode(rng.randbytes(5 * n)).decode(), "base64", n) for n in LENGTHS]
    cases += [(_text(rng, parts, n), name, n) for name, parts in SYLLABLES.items() for n in LENGTHS]
    docs = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)],
                                 "doc_id long, text string, name string, n int")
    got = langid.identify(docs, model).collect()
    assert [(r.name, r.n) for r in got if r.accepted and r.name not in SYLLABLES] == []
    assert [(r.name, r.n) for r in got if r.name in SYLLABLES and not (r.accepted and r.lang_pred == r.name)] == []


def test_a_language_without_trigrams_is_left_out(spark):
    rows = [(i, "lorem ipsum dolor", "aa") for i in range(5)] + [(9, "a", "bb"), (10, "é", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert set(model.languages) == {"aa"}
    got = {r.doc_id: r.accepted for r in langid.identify(docs, model).collect()}
    assert got == {**dict.fromkeys(range(5), True), 9: False, 10: False}
    none = langid.fit(docs.where("lang = 'bb'"))
    assert not any(r.accepted for r in langid.identify(docs, none).collect())


def test_columns_of_added_names(spark):
    docs = spark.createDataFrame([(1, "aba caba aba dab", "xx", "old"), (1, "aba caba aba dab", "xx", "old"), (2, None, None, None),
                                  (3, "efe gehe efe geh", "yy", "old")], "doc_id long, text string, lang string, score string")
    rows = langid.identify(docs.withColumn("lang_pred", docs.lang), langid.fit(docs)).collect()
    assert len(rows) == 4 and rows[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "score", "accepted"}
    assert sorted((r.doc_id, r.lang_pred) for r in rows) == [(1, "xx"), (1, "xx"), (2, "und"), (3, "yy")]
    assert all(0 <= r.score <= 1 for r in rows)
