"""Default lists and parameters.

Every list is a plain Python value that callers may replace; the column functions take them as
arguments.
"""

# --- Fixed values: link shorteners -------------------------------------------------------------
SHORTENERS = ["bit.ly", "tinyurl.com", "clck.ru", "goo.gl", "short.link", "t.co", "ow.ly", "is.gd"]

# --- Fixed values: known senders per category (feature job) ------------------------------------
CATEGORY_SENDERS = {
    "banking": ["PRIVAT24", "MONOBANK", "OSCHADBANK", "PUMB", "ALFA", "OTP", "UKRSIB"],
    "delivery": ["NOVAPOSHTA", "UKRPOSHTA", "JUSTIN", "MEEST", "DHL", "FEDEX"],
    "government": ["DIIA", "GOV.UA", "DPS", "MVS", "MINJUST", "MINZDRAV"],
    "medical": ["HELSI", "DOC.UA", "MEDICS", "LIKI24", "APTEKA911"],
    "retail": ["ROZETKA", "EPICENTR", "ATB", "SILPO", "FORA", "AUCHAN"],
    "authentication": ["GOOGLE", "FACEBOOK", "TWITTER", "INSTAGRAM", "TELEGRAM"],
    "transport": ["UBER", "BOLT", "UKLON", "UZ", "SKYUP", "MAU"],
    "telecom": ["KYIVSTAR", "VODAFONE", "LIFECELL", "LYCAMOBILE"],
}

# --- Fixed values: known senders per category (classifier and labelled data sets) --------------
CLASSIFIER_SENDERS = {
    "banking": ["14949", "10060", "3700", "PRIVAT24", "OSCHADBANK", "MONOBANK", "PUMB", "ABANK"],
    "delivery": ["NOVAPOSHTA", "UKRPOSHTA", "JUSTIN", "MEEST", "DHL", "2400", "3040"],
    "otp": ["Google", "Meta", "Amazon", "AUTH", "VERIFY", "2FA"],
    "shopping": ["ROZETKA", "MAKEUP", "PROM", "FOXTROT", "EPICENTR"],
    "government": ["DIA", "1545", "1648", "GOV", "MOZ", "DMS", "DPSU", "112"],
    "transport": ["UBER", "BOLT", "UKLON", "7788", "TAXI"],
    "medical": ["DOCUA", "MED", "CLINIC", "911", "HEALTH"],
    "marketing": ["PROMO", "SALE", "INFO", "NEWS", "SHOP"],
    "security": ["SECURE", "ALERT", "WARNING", "AUTH"],
    "education": ["UNIV", "EDU", "COURSE", "STUDY"],
    "utilities": ["KYIVSTAR", "VODA", "GAS", "ENERGY", "104"],
    "tourism": ["BOOKING", "HOTEL", "TRAVEL", "TRIP"],
}

# --- Fixed values: suspicious words per language -----------------------------------------------
SUSPICIOUS_WORDS = {
    "uk": ["терміново", "заблоковано", "виграли", "безкоштовно", "увага", "негайно",
           "останній день", "призупинено", "обмежена пропозиція", "підтвердіть",
           "перейдіть за посиланням", "натисніть тут"],
    "ru": ["срочно", "заблокирован", "выиграли", "бесплатно", "внимание", "немедленно",
           "последний день", "приостановлен", "ограниченное предложение"],
    "en": ["urgent", "blocked", "won", "free", "attention", "click here", "immediately",
           "last day", "suspended", "limited offer", "verify"],
}

# --- Fixed values: stems and characters used by the message features ---------------------------
URGENCY_STEMS = ["термінов", "негайно", "зараз", "швидко", "останн", "увага"]
SOCIAL_STEMS = ["виграли", "безкоштов", "подзвон", "перекин", "заблоков", "попередж", "втрат",
                "призупин"]
WEIRD_CHARS = ["�", "◊", "☺", "♦", "♣", "♠", "♥"]

# --- Fixed values: keyword groups of the rule classifiers (checked in this order) --------------
FEATURE_KEYWORDS = [
    ("banking", ["баланс", "карт", "платіж", "рахунок"]),
    ("delivery", ["посилка", "відділення", "доставка"]),
    ("authentication", ["код", "підтвердження", "otp"]),
    ("medical", ["запис", "лікар", "прийом"]),
]
CAPTURE_RULES = [
    ("text", "banking", ["банк", "рахунок", "баланс", "переказ", "грн"]),
    ("source", "banking", ["PRIVAT", "MONO", "OSCHAD", "PUMB"]),
    ("text", "delivery", ["доставка", "посилка", "замовлення"]),
    ("source", "delivery", ["NOVA", "UKRPOSHTA", "JUSTIN"]),
    ("text", "otp", ["код", "code", "пароль", "password"]),
]

# --- Fixed values: inclusive usual hours per category ------------------------------------------
CATEGORY_HOURS = {"banking": (8, 20), "government": (9, 18), "medical": (7, 21),
                  "delivery": (6, 22)}

# --- Fixed values: obfuscation lists -----------------------------------------------------------
INVISIBLE_CHARS = ["​", "‌", "‍", "⁠", "﻿", "‪", "‫", "‬",
                   "‭", "‮", "­", "؜", "ᅟ", "ᅠ", "឴", "឵"]
# Characters that have a look-alike in another alphabet: Cyrillic, Latin, digits.
CONFUSABLE_CYRILLIC = "аеорсухіІАВЕКМНОРСТУХЗЧбБг"
CONFUSABLE_LATIN = "aeopcyxiABEKMHOPCTYX"
CONFUSABLE_DIGITS = "01345689"
BRANDS_WITH_NUMBERS = ["privat24", "monobank24", "otp24", "alfa24", "ukrsib24", "sport24",
                       "auto24", "rabota24", "olx24", "rozetka24", "megasport24", "eldorado24",
                       "foxtrot24", "allo24"]
KNOWN_BRANDS = ["iphone", "iCloud", "ipad", "apple", "samsung", "google", "microsoft", "windows",
                "android", "whatsapp", "telegram", "viber", "facebook", "instagram", "youtube",
                "twitter", "amazon", "netflix", "spotify", "uber", "airbnb", "booking", "paypal",
                "visa", "mastercard", "privat", "monobank", "oschadbank", "raiffeisen", "otp",
                "vodafone", "kyivstar", "lifecell", "ukrtelecom", "ukrposhta", "novaposhta",
                "rozetka", "olx", "prom", "epicentr", "atb", "silpo", "megasport", "sportmaster",
                "eldorado", "foxtrot", "comfy", "citrus", "allo", "moyo", "watsons", "eva", "wifi",
                "wi-fi", "sms", "email", "e-mail", "url", "http", "https", "www", "com", "ua",
                "org", "net", "gov", "edu"]
ALLOWED_WORDS = ["ok", "yes", "no", "stop", "start", "end", "help", "info", "code", "pin", "id",
                 "card", "bank", "shop", "sale", "discount", "free", "new", "hot", "top", "best",
                 "super", "mega", "pro", "plus", "premium", "gold", "silver", "bronze", "vip",
                 "club", "red", "black", "white", "green", "blue", "pink", "gray"]
UKRAINIAN_LETTERS = "абвгґдеєжзиіїйклмнопрстуфхцчшщьюяАБВГҐДЕЄЖЗИІЇЙКЛМНОПРСТУФХЦЧШЩЬЮЯ"
OBFUSCATION_WEIGHTS = {"word": 0.6, "invisible": 0.3, "strange": 0.1}

# --- Fixed values: protocol command and status names -------------------------------------------
COMMANDS = {
    0x00000001: "bind_receiver", 0x80000001: "bind_receiver_resp",
    0x00000002: "bind_transmitter", 0x80000002: "bind_transmitter_resp",
    0x00000003: "query_sm", 0x80000003: "query_sm_resp",
    0x00000004: "submit_sm", 0x80000004: "submit_sm_resp",
    0x00000005: "deliver_sm", 0x80000005: "deliver_sm_resp",
    0x00000006: "unbind", 0x80000006: "unbind_resp",
    0x00000007: "replace_sm", 0x80000007: "replace_sm_resp",
    0x00000008: "cancel_sm", 0x80000008: "cancel_sm_resp",
    0x00000009: "bind_transceiver", 0x80000009: "bind_transceiver_resp",
    0x0000000B: "outbind",
    0x00000015: "enquire_link", 0x80000015: "enquire_link_resp",
    0x00000021: "submit_multi", 0x80000021: "submit_multi_resp",
    0x00000102: "alert_notification",
    0x00000103: "data_sm", 0x80000103: "data_sm_resp",
}
STATUS_CODES = {
    0x00000000: "ESME_ROK", 0x00000001: "ESME_RINVMSGLEN", 0x00000002: "ESME_RINVCMDLEN",
    0x00000003: "ESME_RINVCMDID", 0x00000004: "ESME_RINVBNDSTS", 0x00000005: "ESME_RALYBND",
    0x00000006: "ESME_RINVPRTFLG", 0x00000007: "ESME_RINVREGDLVFLG", 0x00000008: "ESME_RSYSERR",
    0x0000000A: "ESME_RINVSRCADR", 0x0000000B: "ESME_RINVDSTADR", 0x0000000C: "ESME_RINVMSGID",
    0x0000000D: "ESME_RBINDFAIL", 0x0000000E: "ESME_RINVPASWD", 0x0000000F: "ESME_RINVSYSID",
    0x00000011: "ESME_RCANCELFAIL", 0x00000013: "ESME_RREPLACEFAIL", 0x00000014: "ESME_RMSGQFUL",
    0x00000015: "ESME_RINVSERTYP", 0x00000033: "ESME_RINVNUMDESTS", 0x00000034: "ESME_RINVDLNAME",
    0x00000040: "ESME_RINVDESTFLAG", 0x00000042: "ESME_RINVSUBREP",
    0x00000043: "ESME_RINVESMCLASS", 0x00000044: "ESME_RCNTSUBDL", 0x00000045: "ESME_RSUBMITFAIL",
    0x00000048: "ESME_RINVSRCTON", 0x00000049: "ESME_RINVSRCNPI", 0x00000050: "ESME_RINVDSTTON",
    0x00000051: "ESME_RINVDSTNPI", 0x00000053: "ESME_RINVSYSTYP", 0x00000054: "ESME_RINVREPFLAG",
    0x00000055: "ESME_RINVNUMMSGS", 0x00000058: "ESME_RTHROTTLED",
}

# --- Fixed values: detector columns and parameters ---------------------------------------------
SCORING_COLUMNS = [
    "hour", "day_of_week", "message_length", "source_addr_length", "source_is_numeric",
    "dest_is_valid", "message_parts", "encoding_issues", "empty_message", "excessive_length",
    "sender_frequency", "recipient_frequency", "sender_burst", "recipient_burst",
    "high_sender_frequency", "high_recipient_frequency", "suspicious_word_count", "url_count",
    "suspicious_url", "urgency_score", "message_entropy", "obfuscation_score",
    "social_engineering", "night_time", "weekend", "business_hours", "time_category_anomaly",
    "sender_legitimacy", "financial_patterns", "phone_numbers", "source_category_mismatch",
    "category_time_mismatch", "unusual_sender_pattern", "typosquatting",
]
FOREST_FEATURES = ["message_entropy", "obfuscation_score", "suspicious_word_count",
                   "social_engineering", "financial_patterns", "sender_legitimacy",
                   "sender_frequency", "sender_burst", "unusual_sender_pattern", "night_time"]
FOREST_COMPOSITES = {"total_suspicion_score": (
    ["suspicious_word_count", "social_engineering", "financial_patterns"], [0.3, 0.4, 0.3])}
RECONSTRUCTION_FEATURES = ["message_length", "message_entropy", "obfuscation_score",
                           "sender_frequency", "urgency_score", "suspicious_word_count",
                           "unusual_sender_pattern", "sender_legitimacy", "social_engineering",
                           "financial_patterns", "url_count", "suspicious_url", "night_time",
                           "hour"]
FOREST_PARAMS = {"members": 3, "trees": 300, "feature_share": 0.9, "contamination": 0.02,
                 "seed": 42}
CALIBRATION = {"window_size": 2000, "update_frequency": 500, "min_precision": 0.85,
               "percentile": 90.0, "min_batch": 50, "mean_shift": 0.15, "min_move": 0.01}
FEATURE_VERSION = "1.0.0"
INGEST_VERSION = "1.0"
