"""Display functions of the reports, as JVM-side column expressions (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values shown by the reference: category labels, link phrases, the money prefix,
# the open invoice statuses and the default health note of a new student.
TEAM = "Coletivo"
INDIVIDUAL = "Individual"
LINK_PHRASES = {
    "enrollment": " na turma ",
    "teaches": " ministra ",
    "qualified": " apto em ",
    "guardianship": " tem responsavel ",
    "student_plan": " no plano ",
}
MONEY_PREFIX = "R$ "
OPEN_STATUSES = ("Pendente", "Atrasada")
DEFAULT_HEALTH_NOTE = "Apto"
DATE_PATTERN = "dd/MM/yyyy"
# Any character but the white space of Unicode and the four separators U+001C to U+001F.
NOT_WHITE = r"[^\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def brl(amount: str | Column) -> Column:
    """Brazilian money text: 1270 -> 'R$ 1.270,00'; NULL -> ''. Formats the decimal value itself, so no cents are
    lost in large sums, then swaps the grouping and decimal marks."""
    us = F.format_number(_c(amount).cast("decimal(38,2)"), 2)
    return F.coalesce(F.concat(F.lit(MONEY_PREFIX), F.translate(us, ",.", ".,")), F.lit(""))


def br_date(d: str | Column) -> Column:
    """Day/month/year text; NULL stays NULL."""
    return F.date_format(_c(d), DATE_PATTERN)


def label(ident: str | Column, name: str | Column) -> Column:
    """'<id> - <name>'; NULL when either part is NULL (SQL CONCAT semantics)."""
    return F.concat(_c(ident).cast("string"), F.lit(" - "), _c(name))


def link_label(kind: str, left: str | Column, right: str | Column) -> Column:
    return F.concat(_c(left), F.lit(LINK_PHRASES[kind]), _c(right))


def category(is_team: str | Column) -> Column:
    """'Coletivo' only for a TRUE flag; FALSE and NULL both read 'Individual'."""
    return F.when(_c(is_team) == F.lit(True), F.lit(TEAM)).otherwise(F.lit(INDIVIDUAL))


def non_blank(name: str | Column) -> Column:
    """Has a character that isn't white space (Unicode)."""
    return F.coalesce(_c(name).rlike(NOT_WHITE), F.lit(False))
