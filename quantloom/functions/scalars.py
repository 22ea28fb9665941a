"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HORIZON_DAYS = {"short": 30, "mid": 91, "long": 365}
HORIZON_BARS = {"short": 21, "mid": 63, "long": 252}
NEW_YORK = "America/New_York"


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for null operands or a zero divisor."""
    return F.try_divide(a, b)


def clip(x: Column, lo: float, hi: float) -> Column:
    """x between lo and hi, null for null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def band(x: Column, edges: list[tuple[float, float]], default: float) -> Column:
    """The score of the first edge that x reaches, edges from high to low; null for null."""
    out = F.when(x.isNull(), F.lit(None).cast("double"))
    for edge, score in edges:
        out = out.when(x >= edge, F.lit(float(score)))
    return out.otherwise(F.lit(float(default)))


def letter(score: Column) -> Column:
    return F.when(score >= 0.4, "A").when(score >= 0.15, "B").when(score > -0.15, "C").when(score > -0.4, "D").otherwise("F")


def is_hit(verdict: Column, ret: Column) -> Column:
    """Buy above +2 %, sell below -2 %, hold within 5 %."""
    return F.when(verdict == "buy", ret > 0.02).when(verdict == "sell", ret < -0.02).otherwise(F.abs(ret) <= 0.05)


def by_horizon(values: dict, horizon: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[horizon]


def due_date(created: Column, horizon: Column) -> Column:
    return F.date_add(created, by_horizon(HORIZON_DAYS, horizon))


def daily_rate(annual: Column, ppy: int = 252) -> Column:
    return F.pow(1 + annual, F.lit(1 / ppy)) - 1


def scaled_bars(bars: Column, ppy: Column) -> Column:
    """Bars of a horizon for an asset with ppy bars a year; halves round to even."""
    return F.greatest(F.lit(1), F.bround(bars * ppy / 252, 0).cast("int"))


def slot(now: Column, step: int) -> Column:
    """The weekday 16:40 in New York before (-1) or after (+1) a UTC time, as New York local time."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(NEW_YORK), now.cast("timestamp_ntz"))
    at = F.date_trunc("day", local).cast("timestamp_ntz") + F.expr("interval '16:40:00' hour to second")
    move = (at > local) if step < 0 else (at <= local)
    day = F.when(move, F.date_add(F.to_date(at), step)).otherwise(F.to_date(at))
    over = F.weekday(day) - 4  # 1 on Saturday, 2 on Sunday
    back, ahead = F.date_sub(day, F.greatest(over, F.lit(0))), F.date_add(day, F.when(over > 0, 3 - over).otherwise(0))
    return (back if step < 0 else ahead).cast("timestamp_ntz") + F.expr("interval '16:40:00' hour to second")


def days_until(day: Column, now: Column) -> Column:
    return F.datediff(day, F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(NEW_YORK), now.cast("timestamp_ntz"))))


def signal_word(score: Column) -> Column:
    return F.when(score >= 0.15, "positive").when(score <= -0.15, "negative").otherwise("mixed")


def valid_symbol(raw: Column) -> Column:
    """Letters that are A to Z in upper case by themselves (dotless i and long s, but not sharp s or ligatures, which become two)
    between spaces of any kind; a line end is no end."""
    letter = "A-Za-z0-9\u0131\u017f"
    return raw.rlike(rf"\A\p{{Zs}}*[{letter}][{letter}.\-^=]{{0,14}}\p{{Zs}}*\z")


def normal_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def article_id(symbol: Column, key: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", symbol, key).cast("binary")), 1, 16)


def strip_source(title: Column, source: Column) -> Column:
    """A title without the ` - source` that feeds append."""
    tail = F.concat(F.lit(" - "), source)
    return F.when(title.endswith(tail) & (F.length(source) > 0), F.trim(F.substring(title, F.lit(1), F.length(title) - F.length(tail)))).otherwise(title)


# Legal suffixes, and the phrases of holder notices and quote pages.
LEGAL_SUFFIX = r"(?i),?\s+(inc\.?|incorporated|corporation|corp\.?|co\.?|ltd\.?|plc|holdings?|group|company|n\.v\.|s\.a\.|ag|se)$"
HOLDER = (
    r"(?i)\b(acquired|purchased|bought|sold|sells|buys)\b by\b"
    r"|\b(grows|reduces|trims|boosts|lifts|raises|cuts|lowers|increases|decreases|sells|buys|acquires|takes)\b (its |a |new )?(stake|position|holdings|shares)\b"
    r"|\bshares (acquired|purchased|bought|sold)\b|\bposition (lifted|raised|lowered|trimmed|cut)\b"
)
FIRM = r"(?i)\b(llc|l\.p\.|advisors?|advisory|management|wealth|planning|counsel|financial|capital|partners|investments?|trust|securities|asset)\b"
QUOTE_PAGE = r"(?i)stock price,? (news|quote)|price, news, quote|stock quote|company overview"


def company_name(name: Column, symbol: Column) -> Column:
    """At most three legal suffixes and all quotes removed; the symbol if nothing is left."""
    out = F.coalesce(name, symbol)
    for _ in range(3):
        out = F.regexp_replace(F.trim(out), LEGAL_SUFFIX, "")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(out, '"', "")), F.lit("")), symbol)


def is_junk(title: Column) -> Column:
    """A quote page, or a notice about a holder that is a firm."""
    return title.rlike(QUOTE_PAGE) | (title.rlike(HOLDER) & title.rlike(FIRM))


# Weights of impact and the kinds of event.
IMPACT = {"low": 0.3, "medium": 1.0, "high": 2.0}
EVENTS = ["earnings", "guidance", "analyst", "product", "legal", "mna", "management", "capital", "macro", "price_move", "other"]


def label_weight(relevance: Column, impact: Column, event: Column, age_days: Column) -> Column:
    decay = F.exp(-F.greatest(age_days, F.lit(0.0)) / 7)
    return relevance * by_horizon(IMPACT, impact) * decay * F.when(event == "price_move", 0.3).otherwise(1.0)


def clean_label(relevance: Column, sentiment: Column, impact: Column, event: Column) -> list[Column]:
    return [
        clip(relevance, 0, 1).alias("relevance"), clip(sentiment, -1, 1).alias("sentiment"),
        F.when(impact.isin(*IMPACT), impact).otherwise("low").alias("impact"), F.when(event.isin(*EVENTS), event).otherwise("other").alias("event"),
    ]


def weighted(parts: list[tuple[float, Column]]) -> tuple[Column, Column]:
    """(mean, weight) of the scores that are not null; the mean is null if none is."""
    total = sum((F.when(s.isNotNull(), F.lit(float(w))).otherwise(0.0) for w, s in parts), F.lit(0.0))
    value = sum((F.coalesce(s * w, F.lit(0.0)) for w, s in parts), F.lit(0.0))
    return F.when(total > 0, value / total), total
