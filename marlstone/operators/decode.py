"""XML text to typed nested columns.

One ``from_xml`` per document with all leaves as strings, so that a bad leaf is an error of its own and text keeps its
blanks; guards and readers are built around its result. The wire schema holds only what the caller asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marlstone.functions import text
from marlstone.functions.codecs import SCALARS
from marlstone.operators.plain import Plain
from marlstone.plans import wire
from marlstone.plans.model import Enum, Many, Member, Model, ModelError, Ref

OPTIONS = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false", "mode": "FAILFAST", "attributePrefix": "_", "wildcardColName": wire.ANY}
_CORRUPT = "__corrupt"
_BLANK = " \t\r\n"


def normalised(c: Column, model: Model) -> Column:
    """Without bodyless children, with numeric references, and list items tagged by a derived name under their base's."""
    plain = text.named_entities(c)  # which neither makes nor takes a tag
    out = F.when(text.may_be_bodyless(c), text.drop_bodyless(plain)).otherwise(plain)
    listed = {m.kind.item.subject for s in model.subjects for m in model.members(s) if isinstance(m.kind, Many) and isinstance(m.kind.item, Ref)}
    for base in model.subjects.values():
        apart = wire.own_tags(model, base.name, False)
        names = [d for d in base.derived if d != base.name and d not in apart]
        if names and base.name in listed:
            out = text.retagged(out, base.name, names)
    return out


def _default(m: Member, given: object, sql: str) -> Column:
    if given is not None:
        return F.lit(given).cast(sql)
    if m.default is not None:
        return F.lit(m.default).cast(sql)
    zero = None if m.nullable or m.scalar is None else SCALARS[m.scalar].zero
    return F.lit(zero).cast(sql)


class Decoder:
    """``split``: derived tags of lists are fields of their own. ``raw_dates``: beside each dateTime member X, its text as X_raw."""

    def __init__(self, model: Model, strict_items: bool = True, depth: int = wire.DEPTH, split: bool = False, raw_dates: bool = False):
        self.model, self.strict, self.depth, self.split, self.raw_dates = model.check(), strict_items, depth, split, raw_dates
        self.ready: dict[str, Column] = {}  # lists of the root that may have been read without a wire struct; null where they weren't

    def _text(self, kind: str, c: Column) -> Column:
        """A blank text of a type that may be null is null."""
        return F.when(F.btrim(c, F.lit(_BLANK)) != "", c) if kind.endswith("?") and kind != "string?" else c

    def value(self, kind: object, c: Column, want: dict | None, seen: tuple[str, ...], in_list: bool) -> Column:
        if isinstance(kind, Ref):
            return self.subject(kind.subject, c, want, seen, in_list)
        if isinstance(kind, Enum):
            s = F.btrim(c, F.lit(_BLANK))
            return F.when(c.isNull(), F.lit(None)).when(s.isin(*kind.members), s).otherwise(F.raise_error(F.concat(F.lit(f"not a member of {kind.name}: "), c)))
        return self.model.codecs.read(kind.rstrip("?"), self._text(kind, c))

    def member(self, m: Member, c: Column, want: dict | None, seen: tuple[str, ...], given: object) -> Column:
        if isinstance(m.kind, Many):
            items = self._items(m, c, want, seen)
            return F.when(c.isNotNull(), F.coalesce(self.ready[m.name], items) if len(seen) == 1 and m.name in self.ready else items)
        if isinstance(m.kind, Ref):
            return self.value(m.kind, c, want, seen, False)
        sql = "string" if isinstance(m.kind, Enum) else SCALARS[m.scalar].sql
        fallback = F.lit(given if given is not None else m.default or m.kind.members[0]) if isinstance(m.kind, Enum) else _default(m, given, sql)
        got = self.value(m.kind, c, want, seen, False)
        return got if m.scalar == "string" and given is None and m.default is None or m.nullable and given is None else F.coalesce(got, fallback)

    def _each(self, m: Member, c: Column, f) -> Column:
        """``f`` over a list's items, those under a derived tag of their own after the others; an empty array for none."""
        kind = m.kind.item
        if isinstance(kind, Enum):  # whatever its tag
            return F.coalesce(F.transform(c[wire.ANY], f), F.array())
        out = F.transform(c[wire.item_tag(kind)], f)
        for d in wire.own_tags(self.model, kind.subject, self.split) if isinstance(kind, Ref) else []:
            more = F.transform(c[d], self._of_type(d, f))
            out = F.when(c[d].isNull(), out).otherwise(F.concat(F.coalesce(out, F.array()), more))
        return F.coalesce(out, F.array())

    @staticmethod
    def _of_type(d: str, f):
        return lambda x: f(x.withField(wire.TYPE, F.lit(d)))  # one argument: a second would be an index

    def _items(self, m: Member, c: Column, want: dict | None, seen: tuple[str, ...]) -> Column:
        out = self._each(m, c, lambda x: self.value(m.kind.item, x, want, seen, True))
        if isinstance(m.kind.item, Enum) or not self.strict:
            return out
        return F.when(F.size(c[wire.ANY]) > 0, F.raise_error(F.lit(f"{m.name}: an item that is not a {wire.item_tag(m.kind.item)}"))).otherwise(out)

    def subject(self, name: str, c: Column, want: dict | None, seen: tuple[str, ...], in_list: bool) -> Column:
        """A typed struct from a wire struct; null from null."""
        s, inner = self.model.subjects[name], (*seen, name)
        members = wire.wanted(self.model.union(name), want)
        fields = []
        for m in members:
            if wire.fits(m.kind, inner, self.depth):
                fields.append(self.member(m, c[m.name], wire.below(want, m.name), inner, s.factory.get(m.name)).alias(m.name))
                if self.raw_dates and m.scalar == "dateTime":
                    fields.append(c[m.name].alias(f"{m.name}_raw"))
        deep = [m.name for m in members if not wire.fits(m.kind, inner, self.depth)]

        def sound(value: Column) -> Column:
            for d in deep:
                value = F.when(c[d].isNotNull(), F.raise_error(F.lit(f"{name}.{d}: deeper than {self.depth}"))).otherwise(value)
            return value

        if not s.derived:
            return F.when(c.isNotNull(), sound(F.struct(*fields)))
        which = self._which(name, c)
        known = which.isin(*self.model.concrete(name))
        out = F.when(c.isNotNull() & known, sound(F.struct(which.alias(wire.TYPE), *fields)))
        if in_list and self.strict or len(seen) == 0:
            out = out.when(c.isNotNull(), F.raise_error(F.concat(F.lit(f"not a {name}: "), F.coalesce(self._local(c), F.lit("no type")))))
        return out

    @staticmethod
    def _local(c: Column) -> Column:
        return F.substring_index(c[wire.TYPE], ":", -1)

    def _which(self, name: str, c: Column) -> Column:
        return F.coalesce(F.nullif(self._local(c), F.lit("")), F.lit(None if self.model.subjects[name].abstract else name))

    # -- judging without raising: why a document can't be decoded, null if it can

    def _judge(self, kind: object, want: dict | None, seen: tuple[str, ...]):
        return lambda x: self.problem(kind, x, want, seen, True)

    def problem(self, kind: object, c: Column, want: dict | None, seen: tuple[str, ...], in_list: bool) -> Column:
        if isinstance(kind, Enum):
            return F.when(c.isNotNull() & ~F.btrim(c, F.lit(_BLANK)).isin(*kind.members), F.concat(F.lit(f"not a member of {kind.name}: "), c))
        if isinstance(kind, str):
            return self.model.codecs.problem(kind.rstrip("?"), self._text(kind, c))
        name, inner = kind.subject, (*seen, kind.subject)
        found = []
        if self.model.subjects[name].derived and (in_list and self.strict or not seen):
            found.append(F.when(~F.coalesce(self._which(name, c).isin(*self.model.concrete(name)), F.lit(False)), F.concat(F.lit(f"not a {name}: "), F.coalesce(self._local(c), F.lit("no type")))))
        for m in wire.wanted(self.model.union(name), want):
            x, sub = c[m.name], wire.below(want, m.name)
            if not wire.fits(m.kind, inner, self.depth):
                found.append(F.when(x.isNotNull(), F.lit(f"{name}.{m.name}: deeper than {self.depth}")))
            elif isinstance(m.kind, Many):
                bad = self._each(m, x, self._judge(m.kind.item, sub, inner))
                found.append(F.try_element_at(F.filter(bad, lambda y: y.isNotNull()), F.lit(1)))
                if self.strict and not isinstance(m.kind.item, Enum):
                    found.append(F.when(F.size(x[wire.ANY]) > 0, F.lit(f"{m.name}: an item that is not a {wire.item_tag(m.kind.item)}")))
            else:
                found.append(self.problem(m.kind, x, sub, inner, False))
        return F.when(c.isNotNull(), F.coalesce(F.lit(None).cast("string"), *found))

    def _allowed(self, root: str) -> set[str]:
        return {*self.model.concrete(root), *([root] if self.model.root(root).derived else [])}

    def _is_root(self, xml: Column, root: str) -> Column:
        allowed = self._allowed(root)
        plain = F.startswith(xml, F.lit(f"<{root}>")) if root in allowed else F.lit(False)  # spares most documents the patterns
        return plain | text.precise_type(xml).isin(*sorted(allowed))

    def _rooted(self, raw: Column, xml: Column, root: str) -> Column:
        if not self.model.subjects[root].derived:
            return raw
        return F.when(raw.isNotNull(), raw.withField(wire.TYPE, F.coalesce(F.nullif(self._local(raw), F.lit("")), text.precise_type(xml))))

    def document(self, raw: Column, xml: Column, root: str, want: dict | None) -> Column:
        """The typed root, if the document is one; an error otherwise."""
        typed = self.subject(root, self._rooted(raw, xml, root), want, (), False)
        return F.when(xml.isNull(), F.lit(None)).when(self._is_root(xml, root), typed).otherwise(F.raise_error(F.concat(F.lit(f"not a {root} document: "), text.precise_type(xml))))

    def document_problem(self, raw: Column, xml: Column, root: str, want: dict | None) -> Column:
        inside = self.problem(Ref(root), self._rooted(raw, xml, root), want, (), False)
        return (
            F.when(xml.isNull(), F.lit(None).cast("string"))
            .when(raw[_CORRUPT].isNotNull() | raw.isNull(), F.lit("not well-formed"))
            .when(~self._is_root(xml, root), F.concat(F.lit(f"not a {root} document: "), text.precise_type(xml)))
            .otherwise(inside)
        )


def decode(
    df: DataFrame, column: str, model: Model, root: str, into: str = "decoded", paths: list[str] | None = None, strict_items: bool = True,
    options: dict | None = None, depth: int = wire.DEPTH, bad: str | None = None, raw_dates: bool = False, plain_form: bool = True,
) -> DataFrame:
    """``df`` with the documents of ``column`` decoded into a struct column.

    ``paths``: dotted member paths, all if None; no other member is parsed, and one that the model doesn't have raises. A
    document of another type, an item of an unknown type or under another tag, a leaf that isn't of its type and a
    record that holds itself more than ``depth`` times raise; a null document gives null. With ``bad``, nothing raises:
    a document that can't be decoded gives null, and that column says why (null for all others). Readers of one's own
    without a ``parse`` can't be judged and raise as ever. ``raw_dates``: beside each dateTime X, its text as X_raw, in which the
    seventh digit of a second is kept. ``plain_form``: documents in plain form are read without the XML parser.
    """
    if df.sparkSession.conf.get("spark.sql.caseSensitive") != "true":
        raise ModelError("element names are compared by case: use a session of sources.xmlio.session, or set spark.sql.caseSensitive")
    d = Decoder(model, strict_items, depth, raw_dates=raw_dates)
    model.root(root)
    want = wire.known(model, root, wire.tree(paths))
    schema = wire.struct(model, root, want, depth=depth)
    xml, keep = F.col(column), [c for c in df.columns if c not in (into, bad)]
    if not schema.fields and bad is None:
        return df.withColumn(into, F.when(xml.isNull(), F.lit(None)).when(text.precise_type(xml) == root, F.struct()).otherwise(F.raise_error(F.lit(f"not a {root} document"))))
    mode = {} if bad is None else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    if bad is not None:
        schema = schema.add(_CORRUPT, "string")
    raw = F.from_xml(normalised(xml, model), schema.simpleString(), {**OPTIONS, **mode, **(options or {})})
    short, even = Plain(model, root), []
    if short.fit and plain_form and not options and len(schema.fields):
        more = [] if bad is None else [F.lit(None).cast("string").alias(_CORRUPT)]
        raw = F.when(short.test(xml), short.read(xml, want, *more)).otherwise(raw)
        even = [x for x in short.even if x in schema.names]
    # the parsed struct is a column of its own, so that it is made once however many members are read from it
    out = df.withColumn("__raw", raw)
    if even:
        types = out.select(d.subject(root, F.col("__raw"), want, (), False).alias(into)).schema[into].dataType
        test = short.test_even(xml)
        ready = F.when(test, F.struct(*(short.items(xml, types[x].dataType.elementType).alias(x) for x in even)))
        out = df.withColumns({"__raw": F.when(test, short.read(xml, want, *more, empty={x: schema[x].dataType for x in even})).otherwise(raw), "__ready": ready})
        d.ready = {x: F.col("__ready")[x] for x in even}
    if bad is None:
        return out.withColumn(into, d.document(F.col("__raw"), xml, root, want)).select(*keep, into)
    out = out.withColumn(bad, once(d.document_problem(F.col("__raw"), xml, root, want)))
    return out.withColumn(into, F.when(F.col(bad).isNull(), d.document(F.col("__raw"), xml, root, want))).select(*keep, into, bad)


def once(c: Column) -> Column:
    """``c``, kept by the optimizer as a column that is computed once and not copied into what reads it.

    Generators and filters would otherwise take copies of the whole decoding expression, one for each field read.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


def explode_items(df: DataFrame, column: str, path: str, keep: list[str] | None = None, outer: bool = False) -> DataFrame:
    """A row for each item of a decoded list; struct items become columns."""
    f = F.explode_outer if outer else F.explode
    keep = keep or []
    out = df.select(*keep, once(F.col(f"{column}.{path}")).alias("__items")).select(*keep, f("__items").alias("item"))
    return out.select(*keep, "item.*") if out.schema["item"].dataType.typeName() == "struct" else out


def items_are(xml: Column, path: str, tag: str) -> Column:
    """True if every child of the element at ``path`` is named ``tag``."""
    return F.xpath_int(xml, F.lit(f"count({path}/*[name()!='{tag}'])")) == 0
