"""Dates and source names from filenames and texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import match, nfkc, nullif_empty, strip

#: Month names and their short forms.
MONTHS = {"january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12}
#: Filename beginnings and the newspaper they stand for.
ALIASES = {"the economist usa": "经济学人", "the economist": "经济学人", "bloomberg businessweek usa": "彭博商业周刊", "bloomberg businessweek": "彭博商业周刊"}
#: What the parts of a date's form look like; those in brackets are read.
PARTS = {"year": r"(\d{4})", "month": r"(\d{1,2})", "day": r"(\d{1,2})", "name": f"({'|'.join(MONTHS)})", "mark": "[-_/]", "dash": "[-_]", "blank": r"\s+", "comma": ",", "perhaps-comma": ",?", "edge": r"\b", "end": "$"}


@dataclass(frozen=True)
class Form:
    """A way to write a date: its parts in order."""

    parts: tuple[str, ...]

    @classmethod
    def of(cls, words: str) -> Form:
        return cls(tuple(words.split()))

    @property
    def regex(self) -> str:
        return "(?iU)" + "".join(PARTS[p] for p in self.parts)

    def part(self, text: Column, name: str) -> Column:
        read = [p for p in self.parts if PARTS[p].startswith("(")]
        return match(text, self.regex, read.index(name) + 1)

    def date(self, text: Column, year: Column | None = None) -> Column:
        """The date as yyyy-MM-dd, '' if it is none; a form without a day means the first."""
        month = month_number(self.part(text, "name")) if "name" in self.parts else self.part(text, "month")
        day = self.part(text, "day") if "day" in self.parts else F.lit("1")
        return iso_date(self.part(text, "year") if year is None else year, month, day)


NUMBERS = Form.of("year mark month mark day")
WRITTEN = Form.of("edge name blank day perhaps-comma blank year edge")
IN_TEXT = Form.of("edge name blank day comma blank year edge")
MONTH_ONLY = Form.of("edge name blank year edge")
NO_YEAR = Form.of("dash month dash day end")


def stem(filename: Column) -> Column:
    """The name without folders and its last suffix."""
    base = F.element_at(F.split(filename, "/"), -1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")


def month_number(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(str(x)) for kv in MONTHS.items() for x in kv]), F.lower(name))


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """yyyy-MM-dd, '' where the parts are no date."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.coalesce(F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd"), F.lit(""))


def filename_date(filename: Column, epoch_ms: Column, fallback_year: int) -> Column:
    """ISO, written, month and year, or month and day; the first form that is there decides."""
    s = stem(nfkc(F.element_at(F.split(filename, "/"), -1)))
    year = F.coalesce(F.date_format(F.from_utc_timestamp(F.timestamp_millis(epoch_ms.try_cast("bigint")), "Asia/Shanghai"), "yyyy"), F.lit(str(fallback_year)))
    found = F.lit("")
    for form, given in reversed(((NUMBERS, None), (WRITTEN, None), (MONTH_ONLY, None), (NO_YEAR, year))):
        found = F.when(s.rlike(form.regex), form.date(s, given)).otherwise(found)
    return found


def publication_date(issue_date: Column, filename: Column, epoch_ms: Column, fallback_year: int, markdown: Column) -> Column:
    """struct(date, error): issue date, filename, then the text's written or ISO date.

    An ISO or written form that is no date is an error; a month and day that is none falls through.
    """
    s, text = stem(filename), F.coalesce(markdown, F.lit(""))
    steps = [
        (F.coalesce(issue_date, F.lit("")) != "", issue_date, F.lit(False)),
        (s.rlike(NUMBERS.regex), NUMBERS.date(s), F.lit(True)),
        (filename_date(filename, epoch_ms, fallback_year) != "", filename_date(filename, epoch_ms, fallback_year), F.lit(False)),
        (text.rlike(IN_TEXT.regex), IN_TEXT.date(text), F.lit(True)),
        (text.rlike(NUMBERS.regex), NUMBERS.date(text), F.lit(True)),
    ]
    out = F.struct(F.lit("").alias("date"), F.lit("no publication date").alias("error"))
    for there, value, strict in reversed(steps):
        out = F.when(there, F.struct(value.alias("date"), F.when(strict & (value == ""), F.lit("invalid date")).otherwise(F.lit("")).alias("error"))).otherwise(out)
    return out


def source_name(filename: Column) -> Column:
    """Edition names, then the longest alias, then the stem without a valid date."""
    s = stem(filename)
    folded = nfkc(s)
    edition = F.regexp_replace(folded, "^【译】", "").rlike(r"(?iU)^TE[-_]\d{4}[-_]\d{1,2}[-_]\d{1,2}[-_]PDF[-_]WEB$")
    low = F.lower(strip(folded))
    alias = F.coalesce(*[F.when(low.startswith(k), F.lit(ALIASES[k])) for k in sorted(ALIASES, key=len, reverse=True)])
    full = Form.of("dash year dash month dash day end")
    head = lambda form: F.coalesce(nullif_empty(strip(F.regexp_replace(F.regexp_replace(s, form.regex, ""), "[-_ ]+$", ""))), s)
    return (
        F.when(edition, F.lit("经济学人"))
        .when(alias.isNotNull(), alias)
        .when(full.date(s) != "", head(full))
        .when(NO_YEAR.date(s, F.lit("2000")) != "", head(NO_YEAR))
        .otherwise(s)
    )


def stored_timestamp(c: Column) -> Column:
    """Either stored form, null for anything else."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss")))
