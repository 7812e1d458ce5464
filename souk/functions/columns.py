"""Text normalisation, hashes, keys, time differences and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_MARK = "∅"
FIELD_MARK = "\u001f"
ACCENTED, PLAIN = "áàâãäéèêëíìîïóòôõöúùûüç", "aaaaaeeeeiiiiooooouuuuc"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_text(c: Column | str) -> Column:
    """Trimmed, lower-cased, without accents, runs of white space as one space."""
    return F.regexp_replace(F.translate(F.lower(F.trim(col(c))), ACCENTED, PLAIN), r"\s+", " ")


def record_hash(columns: list[str] | list[Column]) -> Column:
    """SHA-256 of the values in the order given; null differs from every text."""
    return F.sha2(F.concat_ws(FIELD_MARK, *[F.coalesce(col(c).cast("string"), F.lit(NULL_MARK)) for c in columns]), 256)


def surrogate_key(*parts: Column | str) -> Column:
    """The first eight bytes of SHA-256 over the parts joined with "|", as a signed number without its sign (its least value: 0)."""
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit(NULL_MARK)) for p in parts]), 256)
    # each expression is used once, so that nothing is hashed or converted twice; only the least value's digits don't fit
    digits = F.ltrim(F.conv(F.substring(digest, 1, 16), 16, -10), F.lit("-"))
    return F.coalesce(digits.try_cast("long"), F.lit(0).cast("long"))


def date_key(c: Column | str) -> Column:
    """yyyymmdd as an int; null for null."""
    d = col(c).cast("date")
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def seconds_between(end: Column, start: Column) -> Column:
    """Whole seconds from start to end, each cut to its second; independent of the session's time zone."""

    def of_day(c: Column) -> Column:
        return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)

    return F.datediff(F.to_date(end), F.to_date(start)).cast("long") * 86400 + of_day(end) - of_day(start)


def divided(a: Column, b: Column, scale: int, kind: str) -> Column:
    """a / b in decimal arithmetic, rounded once and half up; null where b is 0 or null."""
    return F.try_divide(a.cast(f"decimal(28,{scale})"), b.cast("decimal(20,0)")).cast(kind)


def ratio(a: Column, b: Column) -> Column:
    """a / b to six places; null where b is 0 or null."""
    return divided(a, b, 6, "decimal(9,6)")


def mean4(c: Column) -> Column:
    """The mean of the values that aren't null, to four places."""
    return divided(F.sum(c.cast("decimal(18,4)")), F.count(c), 4, "decimal(18,4)")


def money(c: Column) -> Column:
    return c.cast("decimal(28,2)")


def require(df: DataFrame, columns: list[str] | tuple[str, ...], what: str) -> None:
    """Raises unless ``df`` has all the columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what} lacks the columns {', '.join(missing)}")
