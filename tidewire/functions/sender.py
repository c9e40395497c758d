"""Sender, recipient and clock features."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import config
from .chars import digit_set
from .text import _col, _flag

SOURCE_STATISTICS = ["source_length", "source_numeric", "source_short", "source_has_digits",
                     "source_known"]
CLOCK_STATISTICS = ["hour", "day_of_week", "is_weekend", "is_night", "is_business_hours",
                    "hour_sin", "hour_cos", "day_sin", "day_cos"]


def _senders(category: Column, lists, case: str) -> Column:
    """The sender list of the row's category as an array, null when there is none."""
    lists = config.CATEGORY_SENDERS if lists is None else lists
    change = {"upper": str.upper, "lower": str.lower}[case]
    table = F.create_map(*[x for cat, names in lists.items() for x in (
        F.lit(cat), F.array(*[F.lit(change(n)) for n in names]))])
    return F.try_element_at(table, category)


def source_is_numeric(source) -> Column:
    return _flag(F.rlike(_col(source), F.lit(f"^[{digit_set()}]+$")))


def dest_is_valid(dest) -> Column:
    return _flag(F.rlike(_col(dest), F.lit("^380[0-9]{9}$")))


def typosquatting(source, category, senders=None) -> Column:
    """1 when a sender of the category differs in one or two characters.

    The list is walked in order and the first exact or near match decides.
    """
    s = F.lower(_col(source))
    chars = F.split(s, F.lit(""))

    def step(found: Column, name: Column) -> Column:
        near = F.size(F.filter(F.zip_with(chars, F.split(name, F.lit("")), lambda a, b: a != b),
                               lambda d: d))
        return F.coalesce(found, F.when(s == name, 0.0).when(
            (F.length(s) == F.length(name)) & near.between(1, 2), 1.0))

    walked = F.aggregate(_senders(_col(category), senders, "lower"),
                         F.lit(None).cast("double"), step)
    return F.when(F.length(s) == 0, 0.0).otherwise(F.coalesce(walked, F.lit(0.0)))


def source_category_mismatch(source, category, senders=None) -> Column:
    s = F.upper(_col(source))
    known = F.exists(_senders(_col(category), senders, "upper"),
                     lambda n: F.contains(s, n) | F.contains(n, s))
    return F.when(F.length(s) == 0, 0).when(known.isNull(), 0).when(known, 0).otherwise(1)


def sender_legitimacy(source, category, senders=None) -> Column:
    s = F.upper(_col(source))
    names = _senders(_col(category), senders, "upper")
    return (F.when((F.length(s) == 0) | (F.length(_col(category)) == 0), 0.0)
            .when(names.isNull(), 0.5)
            .when(F.array_contains(names, s), 1.0)
            .when(F.exists(names, lambda n: F.contains(s, n)), 0.7)
            .otherwise(0.0))


def unusual_sender_pattern(source) -> Column:
    s = _col(source)
    n = F.length(s)
    mixed = ((n <= 6) & F.rlike(s, F.lit(r"\p{L}")) & F.rlike(s, F.lit(f"[{digit_set()}]")))
    repeated = F.size(F.array_distinct(F.split(s, F.lit("")))) < n / 2
    return F.when(n == 0, 0).when(mixed | repeated, 1).otherwise(0)


def time_category_anomaly(category, hour, rules=None) -> Column:
    rules = config.CATEGORY_HOURS if rules is None else rules
    out = None
    for cat, (first, last) in rules.items():
        cond = (_col(category) == cat) & ~_col(hour).between(first, last)
        out = F.when(cond, 1.0) if out is None else out.when(cond, 1.0)
    return out.otherwise(0.0)


def category_time_mismatch(category, hour, day) -> Column:
    c, h, d = _col(category), _col(hour), _col(day)
    return (F.when(~c.isin("banking", "government"), 0)
            .when(h.between(0, 6), 1)
            .when((c == "government") & (d >= 5), 1)
            .otherwise(0))


def time_flags(hour, day, profile: str = "feature") -> dict[str, Column]:
    """Night, weekend and business-hour flags.

    ``ingest``: night is 22-5, business 9-18. ``feature``: night is 0-5, business 9-17.
    """
    h, d = _col(hour), _col(day)
    night = {"ingest": (h >= 22) | (h < 6), "feature": h.between(0, 5)}[profile]
    last = {"ingest": 18, "feature": 17}[profile]
    return {"night_time": _flag(night), "weekend": _flag(d >= 5),
            "business_hours": _flag(h.between(9, last) & (d < 5))}


def clock(ts) -> dict[str, Column]:
    """Hour and weekday with Monday = 0."""
    return {"hour": F.hour(_col(ts)), "day_of_week": F.weekday(_col(ts))}


def time_model_features(ts) -> dict[str, Column]:
    """The nine clock features of the category classifier."""
    c = clock(ts)
    h, d = c["hour"], c["day_of_week"]
    f = time_flags(h, d, "ingest")
    return {"hour": h, "day_of_week": d, "is_weekend": f["weekend"], "is_night": f["night_time"],
            "is_business_hours": f["business_hours"], **cyclic(h, d)}


def cyclic(hour, day) -> dict[str, Column]:
    turn = 2 * F.pi()
    h, d = _col(hour), _col(day)
    return {"hour_sin": F.sin(turn * h / 24), "hour_cos": F.cos(turn * h / 24),
            "day_sin": F.sin(turn * d / 7), "day_cos": F.cos(turn * d / 7)}


def source_model_features(source, senders=None) -> dict[str, Column]:
    """Five of the six sender features of the classifier; the sixth is a fitted index."""
    senders = config.CLASSIFIER_SENDERS if senders is None else senders
    s = F.upper(F.coalesce(_col(source), F.lit("")))
    # the upper-cased address is looked up in the list as written, so mixed-case names never match
    known = sorted({n for names in senders.values() for n in names})
    return {
        "source_length": F.length(s),
        "source_numeric": _flag(F.rlike(F.replace(s, F.lit("+"), F.lit("")),
                                        F.lit(f"^[{digit_set()}]+$"))),
        "source_short": _flag(F.length(s) <= 6),
        "source_has_digits": _flag(F.rlike(s, F.lit(f"[{digit_set()}]"))),
        "source_known": _flag(s.isin(known)),
    }
