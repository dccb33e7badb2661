"""Date parsing and month labels."""

from pyspark.sql import Column, functions as F

from ventara.functions.text import clean, col, lower_trim

# Month names and abbreviations in Spanish and English.
MONTH_WORDS = {
    1: ("ene", "enero", "jan", "january"),
    2: ("feb", "febrero", "february"),
    3: ("mar", "marzo", "march"),
    4: ("abr", "abril", "apr", "april"),
    5: ("may", "mayo"),
    6: ("jun", "junio", "june"),
    7: ("jul", "julio", "july"),
    8: ("ago", "agosto", "aug", "august"),
    9: ("sep", "sept", "septiembre", "september"),
    10: ("oct", "octubre", "october"),
    11: ("nov", "noviembre", "november"),
    12: ("dic", "diciembre", "dec", "december"),
}

# Accepted day formats with the shape of their texts.
DAY_FORMATS = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
}


def _month_lookup() -> Column:
    pairs = [F.lit(x) for number, words in MONTH_WORDS.items() for word in words for x in (word, number)]
    return F.create_map(*pairs)


def parse_year(x) -> Column:
    digits = F.regexp_replace(clean(x), "[^0-9]", "")
    year = F.when(F.length(digits) == 4, digits.cast("int"))
    return F.when(year.between(1900, 2100), year)


def parse_month(x) -> Column:
    text = lower_trim(x)
    number = F.when(text.rlike("^[0-9]{1,9}$"), text.try_cast("int"))
    return F.coalesce(F.when(number.between(1, 12), number), F.try_element_at(_month_lookup(), text))


def month_start(year, month) -> Column:
    """First day of a year and month, NULL when either is missing."""
    return F.when(col(year).isNotNull() & col(month).isNotNull(), F.make_date(col(year), col(month), F.lit(1)))


def parse_month_text(x) -> Column:
    """First day of a text such as 'Enero 2024' or '2024/03 (cierre)'."""
    words = F.filter(F.split(lower_trim(x), r"[-/()\s]+"), lambda w: w != "")
    year = F.get(F.filter(F.transform(words, parse_year), lambda y: y.isNotNull()), 0)
    month = F.get(F.filter(F.transform(words, parse_month), lambda m: m.isNotNull()), 0)
    return month_start(year, month)


def parse_date(x) -> Column:
    """Day of a text in one of the formats, else the first day of a month text.

    A format is tried only on texts of its shape: a failing parse raises inside the JVM, which
    costs far more than the comparison.
    """
    text = F.substring(F.trim(col(x).cast("string")), 1, 10)
    day = F.lit(None).cast("date")
    for fmt, shape in reversed(DAY_FORMATS.items()):
        day = F.when(text.rlike(shape), F.try_to_date(text, fmt)).otherwise(day)
    return F.coalesce(day, F.when(text != "", parse_month_text(x)))


def period_of(x) -> Column:
    return F.date_format(col(x), "yyyy-MM")


def week_of(x) -> Column:
    """ISO week label, e.g. 2025-W01."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), col(x)), F.weekofyear(col(x)))


def serial_to_date(x) -> Column:
    """Workbook serial day number to a date."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(col(x)).cast("int"))
