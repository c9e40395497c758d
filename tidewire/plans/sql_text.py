"""SQL building blocks of the oracle queries (plain text, one CTE each)."""
from __future__ import annotations

from .. import config
from ..functions.chars import NONSPACE, SPACE
from .driver_tables import ALERT

W = r"[\p{L}\p{N}_]"
BURST_SQL = {"window": "interval 6 hours", "sender": 12, "recipient": 2}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def r6(*cols: str) -> str:
    return ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in cols)


TEXTS = f"""texts AS (
  SELECT doc_id, lang, source, n_chars, CASE doc_id % 10
    WHEN 0 THEN translate(text, 'aeo', 'аео')
    WHEN 1 THEN text || {q(ALERT)}
    WHEN 2 THEN replace(text, ' the ', ' th​e ')
    WHEN 3 THEN translate(text, 'os', '05')
    ELSE text END AS message_text FROM documents)"""

MSG = """msg AS (
  SELECT event_id AS id, ts AS "timestamp", user_id, event_id % (SELECT count(*) FROM documents) AS doc_id,
    CASE event_id % 8 WHEN 0 THEN 'MONOBANK' WHEN 1 THEN 'M0NOBANK' WHEN 2 THEN 'PRIVAT24'
      WHEN 3 THEN 'BANK1' WHEN 4 THEN CAST(user_id AS VARCHAR) WHEN 5 THEN 'NOVAPOSHTA'
      WHEN 6 THEN 'DIIA' ELSE 'GOV.UA' END AS source_addr,
    CASE WHEN event_id % 7 = 0 THEN CAST(user_id AS VARCHAR)
      ELSE CAST(user_id + 380000000000 AS VARCHAR) END AS dest_addr,
    CASE event_type WHEN 'purchase' THEN 'banking' WHEN 'signup' THEN 'government'
      WHEN 'click' THEN 'delivery' WHEN 'view' THEN 'medical' ELSE 'other' END AS category,
    value, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week
  FROM events)"""

LABELLED = """lab AS (
  SELECT m.*, CAST(coalesce(l.toxic, 0) AS INTEGER) AS is_anomaly
  FROM msg m LEFT JOIN labels l USING (doc_id))"""


def present(text: str, items) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {q(i)}) AS INTEGER)" for i in items) + ")"


def any_of(text: str, items) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(i)})" for i in items) + ")"


def matches(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}))"


SUSPICIOUS = [w for ws in config.SUSPICIOUS_WORDS.values() for w in ws]
FINANCIAL = [rf"\p{{Nd}}+{SPACE}*(?:грн|₴|\$|USD|EUR)", rf"рахунок{SPACE}*\p{{Nd}}+",
             rf"карт[аи]{SPACE}*\p{{Nd}}+", "баланс", "переказ"]

ENTROPY = """chars AS (
  SELECT doc_id, ch, count(*) AS k FROM (
    SELECT doc_id, unnest(string_split(message_text, '')) AS ch FROM texts) GROUP BY ALL),
entropy AS (
  SELECT t.doc_id, CASE WHEN length(message_text) = 0 THEN 0.0 ELSE
    least((log2(length(message_text)) - e.s / length(message_text)) / 5.0, 1.0) END AS message_entropy
  FROM texts t LEFT JOIN (SELECT doc_id, sum(k * log2(k)) AS s FROM chars GROUP BY doc_id) e USING (doc_id))"""

_low = "lower(message_text)"
TEXTFEAT = ENTROPY + f""",
textfeat AS (
  SELECT t.doc_id, CAST(length(message_text) AS INTEGER) AS message_length,
    CAST(greatest(1, (length(message_text) + 139) // 140) AS INTEGER) AS message_parts,
    CAST({any_of('message_text', config.WEIRD_CHARS)} AS INTEGER) AS encoding_issues,
    CAST(length(message_text) = 0 AS INTEGER) AS empty_message,
    CAST(length(message_text) > 1000 AS INTEGER) AS excessive_length,
    least({present(_low, SUSPICIOUS)}, 10) AS suspicious_word_count,
    CAST({matches(_low, rf"https?://{NONSPACE}+|www[.]{NONSPACE}+|{NONSPACE}+[.][a-z]{{2,}}")} AS INTEGER) AS url_count,
    CAST({any_of(_low, config.SHORTENERS)} AS INTEGER) AS suspicious_url,
    least(({present(_low, config.URGENCY_STEMS)}
      + CAST(length(regexp_replace(message_text, '[^\\p{{Lu}}]', '', 'g')) > 0.3 * length(message_text) AS INTEGER)
      + least(length(message_text) - length(replace(message_text, '!', '')), 3)) / 5.0, 1.0) AS urgency_score,
    CAST(least({' + '.join(matches(_low, p) for p in FINANCIAL)}, 5) AS INTEGER) AS financial_patterns,
    CAST({matches('message_text', r'[+]?3?8?0[0-9]{9}')} AS INTEGER) AS phone_numbers,
    message_entropy,
    CAST({any_of(_low, config.SOCIAL_STEMS)} AS INTEGER) AS social_engineering
  FROM texts t JOIN entropy USING (doc_id))"""

_plain = [b for b in config.KNOWN_BRANDS if b == b.lower()]
# Obfuscation of every document text ('d') and every distinct sender ('s').
OBFUSCATION = f"""raw AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS key, message_text AS txt FROM texts
  UNION ALL SELECT DISTINCT 's', source_addr, source_addr FROM msg),
cleaned AS (
  SELECT kind, key, length(st) AS n, regexp_replace(regexp_replace(st, '[+]380\\p{{Nd}}{{9}}', '', 'g'),
    {q(rf"https?://{NONSPACE}+|www[.]{NONSPACE}+|{NONSPACE}+[.](?:com|ua|org|net)([^\p{{L}}\p{{N}}_]|$)")}, '\\1', 'gi') AS c
  FROM (SELECT kind, key, regexp_replace(txt, {q(f'^{SPACE}+|{SPACE}+$')}, '', 'g') AS st FROM raw)),
toks AS (
  SELECT kind, key, w, count(*) AS n FROM (
    SELECT kind, key, unnest(regexp_extract_all(c, {q(W + '+')})) AS w FROM cleaned WHERE n >= 2)
  WHERE length(w) >= 2 AND NOT regexp_full_match(w, '\\p{{Nd}}+') GROUP BY ALL),
wfeat AS (
  SELECT w, lower(w) AS lw, length(regexp_replace(w, '[^\\x{{400}}-\\x{{4ff}}]', '', 'g')) AS cyr,
    length(regexp_replace(w, '[^\\p{{Latin}}]', '', 'g')) AS lat,
    regexp_replace(w, '(\\p{{L}})', '\\1\\1', 'g') AS dbl
  FROM (SELECT DISTINCT w FROM toks)),
wdig AS (
  SELECT *, CASE WHEN NOT regexp_matches(w, '\\p{{Nd}}') THEN 0.0
    WHEN lw IN (SELECT unnest({lst(config.BRANDS_WITH_NUMBERS)}))
      OR regexp_extract(lw, '^([a-z]+)\\p{{Nd}}{{2,}}$', 1) IN (SELECT unnest({lst(_plain)})) THEN 0.0
    WHEN regexp_full_match(w, '\\P{{Nd}}+\\p{{Nd}}{{2,}}') THEN 0.0
    WHEN regexp_full_match(w, '\\p{{Nd}}+\\P{{Nd}}+') THEN 0.1
    ELSE least(0.3 * len(regexp_extract_all(dbl, '\\p{{L}}[01345689]\\p{{L}}'))
      + 0.1 * (len(regexp_extract_all(dbl, '\\p{{L}}\\p{{Nd}}\\p{{L}}')) - len(regexp_extract_all(dbl, '\\p{{L}}[01345689]\\p{{L}}')))
      + CASE WHEN regexp_full_match(w, '\\P{{Nd}}+\\p{{Nd}}') THEN 0.2 ELSE 0.0 END, 1.0) END AS dig,
    lw IN (SELECT unnest({lst(config.BRANDS_WITH_NUMBERS + _plain + config.ALLOWED_WORDS)}))
      OR (regexp_extract(lw, '^([a-z]+)\\p{{Nd}}{{2,}}$', 1) IN (SELECT unnest({lst(_plain)})))
      OR {any_of('lw', [b for b in _plain if len(b) >= 4])} AS known
  FROM wfeat),
wscore AS (
  SELECT w, known, CASE WHEN cyr + lat = 0 THEN 0.0 WHEN cyr = 0 OR lat = 0 THEN dig
    WHEN cyr + lat > 2 AND regexp_matches(w, {q('[' + config.CONFUSABLE_CYRILLIC + config.CONFUSABLE_LATIN + config.CONFUSABLE_DIGITS + ']')})
      THEN greatest(0.6, 2.0 * least(cyr, lat) / (cyr + lat))
    WHEN greatest(dig, 2.0 * least(cyr, lat) / (cyr + lat)) > 0.1
      THEN least(1.5 * greatest(dig, 2.0 * least(cyr, lat) / (cyr + lat)), 1.0)
    ELSE 0.0 END AS score FROM wdig),
words AS (
  SELECT kind, key, sum(score * n) / sum(n) AS word_part
  FROM toks JOIN wscore USING (w) WHERE NOT known AND score > 0 GROUP BY kind, key),
obf AS (
  SELECT kind, key, CASE WHEN c.n < 2 OR NOT regexp_matches(c, {q(W)}) THEN 0.0 ELSE
    least(0.6 * coalesce(word_part, 0)
      + 0.3 * least(0.5 * (length(c) - length(translate(c, {q(''.join(config.INVISIBLE_CHARS))}, ''))), 1.0)
      + 0.1 * least(0.2 * len(regexp_extract_all(c, '[\\p{{Cf}}\\p{{Co}}]')), 1.0), 1.0) END AS score
  FROM cleaned c LEFT JOIN words USING (kind, key))"""


def combine(m: str, s: str) -> str:
    return (f"CASE WHEN {m} > 0.3 AND {s} > 0.3 THEN least({m} + {s}, 1.0) "
            f"WHEN {m} > 0.3 OR {s} > 0.3 THEN greatest({m}, {s}) * 0.8 "
            f"ELSE {m} * 0.55 + {s} * 0.45 END")


SENDERS = "senders AS (SELECT * FROM (VALUES " + ", ".join(
    f"({q(cat)}, {i}, {q(n)})" for cat, names in config.CATEGORY_SENDERS.items()
    for i, n in enumerate(names)) + ") v(cat, ord, name))"

# Address features on distinct (source, category) pairs.
PAIRS = SENDERS + """,
pairs AS (
  SELECT p.source_addr, p.category,
    coalesce(min_by(CASE WHEN lower(p.source_addr) = lower(name) THEN 0.0
      WHEN length(p.source_addr) = length(name)
        AND hamming(lower(p.source_addr), lower(name)) BETWEEN 1 AND 2 THEN 1.0 END, ord)
      FILTER (WHERE lower(p.source_addr) = lower(name) OR CASE WHEN length(p.source_addr) = length(name)
        THEN hamming(lower(p.source_addr), lower(name)) BETWEEN 1 AND 2 ELSE false END), 0.0) AS typosquatting,
    CAST(count(name) > 0 AND NOT coalesce(bool_or(contains(upper(p.source_addr), upper(name))
      OR contains(upper(name), upper(p.source_addr))), false) AS INTEGER) AS source_category_mismatch,
    CASE WHEN count(name) = 0 THEN 0.5 WHEN bool_or(upper(p.source_addr) = upper(name)) THEN 1.0
      WHEN bool_or(contains(upper(p.source_addr), upper(name))) THEN 0.7 ELSE 0.0 END AS sender_legitimacy
  FROM (SELECT DISTINCT source_addr, category FROM msg) p LEFT JOIN senders s ON s.cat = p.category
  GROUP BY p.source_addr, p.category)"""

ROWFEAT = PAIRS + """,
rowfeat AS (
  SELECT m.*, CAST(length(source_addr) AS INTEGER) AS source_addr_length,
    CAST(regexp_full_match(source_addr, '\\p{Nd}+') AS INTEGER) AS source_is_numeric,
    CAST(regexp_full_match(dest_addr, '380[0-9]{9}') AS INTEGER) AS dest_is_valid,
    typosquatting, CAST(hour BETWEEN 0 AND 5 AS INTEGER) AS night_time,
    CAST(day_of_week >= 5 AS INTEGER) AS weekend,
    CAST(hour BETWEEN 9 AND 17 AND day_of_week < 5 AS INTEGER) AS business_hours,
    source_category_mismatch,
    CASE WHEN (category = 'banking' AND hour NOT BETWEEN 8 AND 20)
      OR (category = 'government' AND hour NOT BETWEEN 9 AND 18)
      OR (category = 'medical' AND hour NOT BETWEEN 7 AND 21)
      OR (category = 'delivery' AND hour NOT BETWEEN 6 AND 22) THEN 1.0 ELSE 0.0 END AS time_category_anomaly,
    CAST((length(source_addr) <= 6 AND regexp_matches(source_addr, '\\p{L}') AND regexp_matches(source_addr, '\\p{Nd}'))
      OR len(list_distinct(string_split(source_addr, ''))) < length(source_addr) / 2.0 AS INTEGER) AS unusual_sender_pattern,
    CASE WHEN category IN ('banking', 'government') AND (hour BETWEEN 0 AND 6
      OR (category = 'government' AND day_of_week >= 5)) THEN 1 ELSE 0 END AS category_time_mismatch,
    sender_legitimacy
  FROM msg m JOIN pairs USING (source_addr, category))"""


def activity_sql(window: str, sender: int, recipient: int) -> str:
    over = "OVER (PARTITION BY {a} ORDER BY \"timestamp\" RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)"
    return f"""activity AS (
  SELECT id, count(*) OVER (PARTITION BY source_addr) AS sender_frequency,
    count(*) OVER (PARTITION BY dest_addr) AS recipient_frequency,
    CAST(count(*) {over.format(a='source_addr', w=window)} > {sender} AS INTEGER) AS sender_burst,
    CAST(count(*) {over.format(a='dest_addr', w=window)} > {recipient} AS INTEGER) AS recipient_burst
  FROM msg),
act AS (SELECT *, CAST(sender_frequency > {sender} AS INTEGER) AS high_sender_frequency,
  CAST(recipient_frequency > {recipient} AS INTEGER) AS high_recipient_frequency FROM activity)"""


ACTIVITY = activity_sql(BURST_SQL["window"], BURST_SQL["sender"], BURST_SQL["recipient"])

FEATURES = ", ".join([OBFUSCATION, TEXTFEAT, ROWFEAT, ACTIVITY]) + f""",
feat AS (
  SELECT r.*, f.* EXCLUDE (doc_id), a.* EXCLUDE (id), {combine('od.score', 'os.score')} AS obfuscation_score,
    (encoding_issues + empty_message + excessive_length + source_is_numeric + dest_is_valid) / 5.0 AS protocol_anomaly_score,
    1 AS features_extracted, '1.0.0' AS feature_extraction_version
  FROM rowfeat r JOIN textfeat f USING (doc_id) JOIN act a USING (id)
  JOIN obf od ON od.kind = 'd' AND od.key = CAST(r.doc_id AS VARCHAR)
  JOIN obf os ON os.kind = 's' AND os.key = r.source_addr)"""


def sql(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body
