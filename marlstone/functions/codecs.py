"""The thirteen scalar types: how each is named in XML, read from text, written as text, and how wide it is at most.

A reader is a function from a string column to a typed one; a writer goes back. Readers return null for null and raise
for text that isn't of the type. Models may replace any of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from marlstone.functions.text import escape

GUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
DATE_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSS"
_BLANK = " \t\r\n"


def checked(text: Column, value: Column, what: str) -> Column:
    """``value``, or an error that names the text if only the value is null."""
    return F.when(text.isNotNull(), F.coalesce(value, F.raise_error(F.concat(F.lit(f"not a valid {what}: "), text))))


def reader(parse: Callable[[Column], Column], what: str, sure: str | None = None) -> Callable[[Column], Column]:
    """A reader that raises where ``parse`` gives null; it keeps ``parse``, so that a document can be judged without raising.

    ``sure``: a pattern for texts, not all there may be, for which a cast gives the value.
    """

    def read(c: Column) -> Column:
        return checked(c, parse(c), what)

    read.parse, read.what, read.sure = parse, what, sure
    return read


def _number(kind: str, sql: str, low: int | None = None, high: int | None = None):
    def parse(c: Column) -> Column:
        s = F.btrim(c, F.lit(_BLANK))
        whole = F.when(s.rlike(r"^[+-]?[0-9]+$"), s) if sql.startswith("decimal") else c  # casts to integers take nothing else but blanks around
        v = whole.try_cast(sql)
        if low is not None:
            v = F.when(v.between(F.expr(f"CAST('{low}' AS {sql})"), F.expr(f"CAST('{high}' AS {sql})")), v)
        return v

    digits = len(str(high)) - 1 if high else {"tinyint": 2, "smallint": 4, "int": 9, "bigint": 18}[sql]
    return reader(parse, kind, f"{'' if low == 0 else '-?+'}[0-9]{{1,{digits}}}")


def _boolean(c: Column) -> Column:
    s = F.lower(F.btrim(c, F.lit(_BLANK)))
    return F.when(c == "true", F.lit(True)).when(c == "false", F.lit(False)).when(s == "true", F.lit(True)).when(s == "false", F.lit(False))


def _guid(c: Column) -> Column:
    s = F.lower(F.btrim(c, F.lit(_BLANK + "{}")))
    s = F.when(s.rlike("^[0-9a-f]{32}$"), F.regexp_replace(s, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).otherwise(s)
    return F.when(s.rlike(GUID), s)


def _date(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANK)).try_cast("timestamp")


def decimal_reader(precision: int = 28, scale: int = 10) -> Callable[[Column], Column]:
    """Decimals of a fixed scale. Text with more decimals than that, zeros at its end aside, raises: nothing is rounded."""
    fraction = rf"\.[0-9]{{1,{scale}}}0*" if scale else r"\.0+"

    def parse(c: Column) -> Column:
        blank = f"[{_BLANK}]*+"
        return F.when(c.rlike(rf"\A{blank}[+-]?(?:[0-9]+\.?|[0-9]*{fraction}){blank}\z"), c).try_cast(f"decimal({precision},{scale})")  # which takes blanks around

    fits = 0 < precision - scale <= 18 and scale <= 10  # the usual decimal, which an absent one's default has
    return reader(parse, "decimal", f"-?+[0-9]{{1,{precision - scale}}}+" + (rf"(?:\.[0-9]{{1,{scale}}}+)?+" if scale else "") if fits else None)


def as_is(c: Column) -> Column:
    """A writer for text that is XML already."""
    return c


def date_writer(pattern: str = DATE_PATTERN) -> Callable[[Column], Column]:
    return lambda c: F.date_format(c, pattern)


def plain(c: Column) -> Column:
    return c.cast("string")


@dataclass(frozen=True)
class Scalar:
    name: str  # in XML
    sql: str
    read: Callable[[Column], Column]
    write: Callable[[Column], Column] = plain
    width: int | None = None  # None: the length of the text
    zero: object = 0  # value of an absent member


_ALL = (
    Scalar("dateTime", "timestamp", reader(_date, "dateTime"), date_writer(), 33, "0001-01-01 00:00:00"),
    Scalar("guid", "string", reader(_guid, "guid", GUID[1:-1]), F.lower, 36, "00000000-0000-0000-0000-000000000000"),
    Scalar("boolean", "boolean", reader(_boolean, "boolean", "(?:true|false)"), plain, 5, False),
    Scalar("byte", "tinyint", _number("byte", "tinyint"), plain, 4),
    Scalar("unsignedByte", "smallint", _number("unsignedByte", "smallint", 0, 255), plain, 3),
    Scalar("short", "smallint", _number("short", "smallint"), plain, 6),
    Scalar("unsignedShort", "int", _number("unsignedShort", "int", 0, 65535), plain, 5),
    Scalar("int", "int", _number("int", "int"), plain, 11),
    Scalar("unsignedInt", "bigint", _number("unsignedInt", "bigint", 0, 4294967295), plain, 10),
    Scalar("long", "bigint", _number("long", "bigint"), plain, 21),
    Scalar("unsignedLong", "decimal(20,0)", _number("unsignedLong", "decimal(20,0)", 0, 18446744073709551615), plain, 20),
    Scalar("decimal", "decimal(28,10)", decimal_reader(), plain, 30),
    Scalar("string", "string", lambda c: c, escape, None, None),
)
SCALARS = {s.name: s for s in _ALL}


@dataclass(frozen=True)
class Codecs:
    """Readers and writers by type name that take the place of the usual ones; a date pattern for writing."""

    readers: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    writers: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    date_pattern: str = DATE_PATTERN

    def read(self, name: str, c: Column) -> Column:
        return self.readers.get(name, SCALARS[name].read)(c)

    def problem(self, name: str, c: Column) -> Column:
        """Why the text isn't of the type, null if it is; nothing is known about a reader of one's own that has no ``parse``."""
        read = self.readers.get(name, SCALARS[name].read)
        if not hasattr(read, "parse"):
            return F.lit(None).cast("string")
        return F.when(c.isNotNull() & read.parse(c).isNull(), F.concat(F.lit(f"not a valid {read.what}: "), c))

    def sure(self, name: str, text: str) -> str | None:
        """The reader's pattern for texts that a cast reads; ``text`` for strings, None if there is none."""
        if name == "string":
            return None if name in self.readers else text
        return getattr(self.readers.get(name, SCALARS[name].read), "sure", None)

    def write(self, name: str, c: Column) -> Column:
        if name in self.writers:
            return self.writers[name](c)
        return date_writer(self.date_pattern)(c) if name == "dateTime" else SCALARS[name].write(c)
