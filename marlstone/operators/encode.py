"""Typed nested columns to compact XML text, as one generated expression for each model and root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marlstone.functions import text
from marlstone.functions.codecs import SCALARS
from marlstone.plans import wire
from marlstone.plans.model import Enum, Many, Member, Model, Ref


def tagged(tag: str, body: Column, head: str = "") -> Column:
    return F.concat(F.lit(f"<{tag}{head}>"), body, F.lit(f"</{tag}>"))


class Encoder:
    """``plain_base``: a concrete base among derived types is written without a type; False drops it."""

    def __init__(self, model: Model, plain_base: bool = True, depth: int = wire.DEPTH):
        self.model, self.plain_base, self.depth = model.check(), plain_base, depth

    def scalar(self, kind: str, c: Column) -> Column:
        return self.model.codecs.write(kind.rstrip("?"), c)

    def value(self, kind: object, tag: str, c: Column, seen: tuple[str, ...]) -> Column:
        """An element named ``tag``; what has no value is an empty element, or nothing for a record."""
        if isinstance(kind, Ref):
            return self.subject(kind.subject, tag, c, seen)
        body = c if isinstance(kind, Enum) else self.scalar(kind, c)
        return tagged(tag, F.coalesce(body, F.lit("")))

    def member(self, m: Member, c: Column, seen: tuple[str, ...]) -> Column:
        if isinstance(m.kind, Many):
            tag = wire.item_tag(m.kind.item)
            items = F.transform(c, lambda x: F.coalesce(self.value(m.kind.item, tag, x, seen), F.lit("")))
            return F.when(c.isNull(), F.lit("")).otherwise(tagged(m.name, F.array_join(items, "")))
        out = self.value(m.kind, m.name, c, seen)
        if m.scalar == "string" or isinstance(m.kind, Ref):
            return F.when(c.isNull(), F.lit("")).otherwise(F.coalesce(out, F.lit("")))
        return out

    def body(self, name: str, c: Column, seen: tuple[str, ...]) -> Column:
        seen = (*seen, name)
        parts = [self.member(m, c[m.name], seen) for m in self.model.members(name) if wire.fits(m.kind, seen, self.depth)]
        return F.concat(*parts) if parts else F.lit("")

    def subject(self, name: str, tag: str, c: Column, seen: tuple[str, ...] = ()) -> Column:
        s = self.model.subjects[name]
        if not s.derived:
            return F.when(c.isNotNull(), tagged(tag, self.body(name, c, seen)))
        out = F
        for d in s.derived:
            out = out.when(c[wire.TYPE] == d, tagged(tag, self.body(d, c, seen), f' xmlns:xsi="{text.XSI}" xsi:type="{d}"'))
        if not s.abstract:
            mine = tagged(tag, self.body(name, c, seen)) if self.plain_base else F.lit("")
            out = out.when(c.isNotNull() & (c[wire.TYPE].isNull() | (c[wire.TYPE] == name)), mine)
        return out.when(c.isNotNull(), F.raise_error(F.concat(F.lit(f"not a {name}: "), F.coalesce(c[wire.TYPE], F.lit("no type")))))

    # -- estimates: the length that a buffer should have, without writing

    def width(self, kind: object, c: Column, seen: tuple[str, ...]) -> Column:
        if isinstance(kind, Enum):
            return F.length(c)
        name = kind.rstrip("?")
        if name == "string":
            return F.length(c) + text.special_overhead(c)
        if name == "boolean":
            return F.when(c, 4).otherwise(5)
        return F.lit(SCALARS[name].width)

    def estimate(self, kind: object, tag: str, c: Column, seen: tuple[str, ...]) -> Column:
        around = 2 * len(tag) + 5
        if isinstance(kind, Ref):
            return self.estimate_subject(kind.subject, tag, c, seen)
        if isinstance(kind, Many):
            inner = wire.item_tag(kind.item)
            items = F.transform(c, lambda x: F.coalesce(self.estimate(kind.item, inner, x, seen), F.lit(0)).cast("long"))
            return F.when(c.isNotNull(), around + F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x))
        size = F.when(c.isNotNull(), self.width(kind, c, seen)).otherwise(0)
        return around + size

    def estimate_subject(self, name: str, tag: str, c: Column, seen: tuple[str, ...] = ()) -> Column:
        s, inner = self.model.subjects[name], (*seen, name)

        def total(of: str, head: int) -> Column:
            out = F.lit(2 * len(tag) + 5 + head)
            for m in self.model.members(of):
                if wire.fits(m.kind, inner, self.depth):
                    size = F.coalesce(self.estimate(m.kind, m.name, c[m.name], inner), F.lit(0))
                    out = out + (F.when(c[m.name].isNull(), 0).otherwise(size) if m.scalar == "string" else size)
            return out

        if not s.derived:
            return F.when(c.isNotNull(), total(name, 0))
        out = F
        for d in s.derived:
            out = out.when(c[wire.TYPE] == d, total(d, len(f' xmlns:xsi="{text.XSI}" xsi:type="{d}"')))
        return out.when(c.isNotNull(), total(name, 0))


def encoded(c: Column, model: Model, root: str, prolog: bool = False, plain_base: bool = True, depth: int = wire.DEPTH) -> Column:
    """The document of a struct column, with a prolog if asked for; null from null.

    ``depth``: how often a record may hold itself in that column. ``encode`` sees the column's type and finds it out.
    """
    model.root(root)
    out = Encoder(model, plain_base, depth).subject(root, root, c)
    return F.concat(F.lit(text.PROLOG), out) if prolog else out


def utf8(c: Column, model: Model, root: str, prolog: bool = False, depth: int = wire.DEPTH) -> Column:
    return F.encode(encoded(c, model, root, prolog, depth=depth), "UTF-8")


def estimated(c: Column, model: Model, root: str, prolog: bool = False, depth: int = wire.DEPTH) -> Column:
    """An estimate of the document's length in characters from the widths of its types; not an upper bound for quotes."""
    model.root(root)
    return (Encoder(model, depth=depth).estimate_subject(root, root, c) + (len(text.PROLOG) if prolog else 0)).cast("long")


def encode(df: DataFrame, column: str, model: Model, root: str, into: str = "xml", prolog: bool = False) -> DataFrame:
    """``df`` with the documents of a struct column, however deep it is."""
    model.check().root(root)
    return df.withColumn(into, encoded(F.col(column), model, root, prolog, depth=wire.depth_of(model, root, df.schema[column].dataType)))
