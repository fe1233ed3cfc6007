"""Text expressions: addresses, names and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() takes for white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Labels for what is missing, and the date styles of course labels.
NO_AREA = "Sin área"
NO_DATE = "Fecha no disponible"
NOT_RECORDED = "No Registrar"
DAY_FIRST = "dd/MM/yyyy"
YEAR_FIRST = "yyyy/MM/dd"
# How dates are written in texts, in the order they are tried; months go first where both fit.
DATE_FORMATS = (
    "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss",
    "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "MMM d, yyyy", "d MMMM yyyy", "MMMM d, yyyy",
)


def strip(text: Column) -> Column:
    """Trim all Unicode white space; Spark's own trim takes off blanks only."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def normal_email(text: Column) -> Column:
    return F.lower(strip(text))


def email_of_line(line: Column, drop_cr: bool = True) -> Column:
    return normal_email(F.translate(line, "\r\n", "") if drop_cr else line)


def email_of_recipient(entry: Column) -> Column:
    """`Name <address>` or a bare address, as a mail client copies them."""
    address = F.rtrim(strip(F.substring_index(entry, "<", -1)), F.lit(">"))
    return normal_email(F.translate(address, "\r\n", ""))


def shown(col: str) -> Column:
    """Text as a label shows it: a missing value reads None."""
    return F.coalesce(F.col(col), F.lit("None"))


def course_label(name: str, start: str, end: str, date_format: str) -> Column:
    dates = F.concat(F.date_format(start, date_format), F.lit(" - "), F.date_format(end, date_format))
    return F.concat(shown(name), F.lit(" ("), F.coalesce(dates, F.lit(NO_DATE)), F.lit(")"))


def parse_date(text: str | Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The date that a text holds, in the first of the formats that fits all of it; none gives null."""
    held = strip(F.col(text) if isinstance(text, str) else text)
    return F.coalesce(*[F.try_to_date(held, f) for f in formats])


def yes_no(flag: str) -> Column:
    return F.when(F.col(flag), "Si").otherwise("No")


def is_blank(col: str) -> Column:
    """Missing, or text with nothing in it: what a form takes for not filled in."""
    return F.col(col).isNull() | (F.col(col).cast("string") == "")
