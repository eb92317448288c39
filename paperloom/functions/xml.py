"""Reading XML and HTML records as Spark columns. Broken XML gives nulls or empty lists and never fails a job; name spaces are left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "ignoreNamespace": "true"}


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def record(c: Column | str, schema: str) -> Column:
    """The record as a struct of ``schema``, in which repeated elements are arrays, attributes have an underscore before their name
    and the text of an element with attributes is ``_VALUE``. What stands in one element stays together. Null if it is no XML."""
    got = F.from_xml(_column(c), f"{schema}, _corrupt STRING", _OPTIONS)
    return F.when(got["_corrupt"].isNull(), got)


def well_formed(c: Column | str) -> Column:
    """Whether it is XML; false for null and empty text."""
    return F.coalesce(F.from_xml(_column(c), "_corrupt STRING", _OPTIONS)["_corrupt"].isNull() & (F.trim(_column(c)) != ""), F.lit(False))


def tree(c: Column | str, attributes: bool = False) -> Column:
    """Any record as a variant, without a schema: an element's children by name, repeated ones as an array, text where there are no
    children. With ``attributes`` these come too, with an underscore, and the text beside them is ``_VALUE``. Null if it is no XML."""
    return F.when(well_formed(c), F.from_xml(_column(c), "variant", {"ignoreNamespace": "true", "excludeAttribute": str(not attributes).lower()}))


def texts(c: Column | str, path: str) -> Column:
    """What an XPath finds; an empty list if there is nothing or it is no XML."""
    return F.coalesce(F.when(well_formed(c), F.xpath(_column(c), F.lit(path))), F.array().cast("array<string>"))


def first_text(c: Column | str, path: str) -> Column:
    """The text of the first element of a path up to its first child; null if there is none."""
    return F.get(texts(c, f"({path})[1]/text()[1]"), F.lit(0))


def tag(c: Column, name: str) -> Column:
    """The text of the first element of a name, tags and all; empty if there is none."""
    return F.regexp_extract(c, rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)


def year_between(c: Column, least: int = 1990, most: int = 2025) -> Column:
    """The first year element in the range; null otherwise."""
    number = F.nullif(F.regexp_extract(c, r"<Year>(\d{4})</Year>", 1), F.lit("")).cast("int")
    return F.when(number.between(least, most), number)


def authors(c: str) -> Column:
    """First and last names of all authors that have both, in order; groups and authors with one name only are left out."""
    of = lambda name: texts(c, f"//Author[ForeName[1]/text() and LastName[1]/text()]/{name}[1]/text()[1]")
    return F.array_join(F.zip_with(of("ForeName"), of("LastName"), lambda a, b: F.concat_ws(" ", a, b)), "; ")


def body_text(c: str) -> Column:
    """All text inside the body, joined by blanks."""
    return F.trim(F.regexp_replace(F.array_join(texts(c, "//body//text()"), " "), r"\s+", " "))


def first_texts(c: str, path: str) -> Column:
    """The first text of each element of a path, if it begins with text; what follows an inner element is left out."""
    return texts(c, f"{path}/node()[1][self::text()]")


def full_text(c: str) -> Column:
    """Title, paragraphs of the abstract and of the body, joined by blank lines; empty if there are none."""
    return F.array_join(F.concat(*[first_texts(c, p) for p in ("//article-title", "//abstract//p", "//body//p")]), "\n\n")
