"""A short way for documents in plain form.

A document is plain if it is made of its model's own elements alone: no attributes, comments, CDATA sections, references
but the commonest, or unknown elements, and every name stands for one member only. One pattern recognises that; then each value lies
between its tags and is cut out by position. Whatever isn't plain goes to the XML parser, with the same result.

A plain document is *even* if nothing stands between its elements, its members are in the model's order, each once at most, and its
lists of simple records hold all their members, in texts that are of their types for sure: what an encoder writes of rows without nulls.
Then the values of each member of such a list are read in one pass, as typed arrays, with nothing left to be guarded.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

from marlstone.functions.text import PROLOG
from marlstone.plans import wire
from marlstone.plans.model import Enum, Many, Model, Ref

_WS = "[ \\t\\r\\n]*+"
#: text characters that stand for themselves, the commonest first
_C = "[\\x3F-\\uD7FF\\x27-\\x3B\\x20-\\x25=\\n\\t\\uE000-\\uFFFD\\x{10000}-\\x{10FFFF}]"
_REFS = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&"))  # that of & goes last
_REF = f"(?:{'|'.join(r for r, _ in _REFS)})"
#: text that the parser gives back as it stands but for those references; what begins with white space, and may be nothing else, isn't
_TEXT = f"(?![ \\t\\n]){_C}*(?:{_REF}{_C}*)*+"


class Plain:
    """``fit`` is False for models that have no plain form: with derived types, recursion, or a name used twice."""

    def __init__(self, model: Model, root: str):
        self.model, self.root, self.tags = model, root, [root]
        self.fit = self._collect(root, ()) and len(set(self.tags)) == len(self.tags)
        #: the root's lists that are read as typed arrays from an even document
        self.even = [m.name for m in model.members(root) if isinstance(m.kind, Many) and isinstance(m.kind.item, Ref) and self._sure(m.kind.item)] if self.fit else []

    def _collect(self, name: str, seen: tuple[str, ...]) -> bool:
        s = self.model.subjects[name]
        if s.derived or name in seen:
            return False
        for m in self.model.members(name):
            self.tags.append(m.name)
            kind = m.kind
            if isinstance(kind, Many):
                kind = kind.item
                self.tags.append(wire.item_tag(kind))
            if isinstance(kind, Ref) and not self._collect(kind.subject, (*seen, name)):
                return False
        return True

    def _sure(self, kind: object) -> str | None:
        """A pattern for texts that surely are of a type; for a record, that of all its members in their order. None if there is none."""
        if isinstance(kind, Many):
            return None
        if isinstance(kind, Ref):
            parts = [(m.name, self._sure(m.kind)) for m in self.model.members(kind.subject)]
            return None if any(p is None for _, p in parts) else "".join(f"<\\Q{t}\\E>{p}</\\Q{t}\\E>" for t, p in parts) or None
        if isinstance(kind, Enum):
            return f"(?:{'|'.join(f'{chr(92)}Q{x}{chr(92)}E' for x in kind.members)})" if all(re.fullmatch(r"[\w.-]+", x) for x in kind.members) else None
        return self.model.codecs.sure(kind.rstrip("?"), _TEXT)

    def _even_element(self, tag: str, kind: object) -> str:
        if isinstance(kind, Many):
            inner = wire.item_tag(kind.item)
            item = f"<\\Q{inner}\\E>{self._sure(kind.item)}</\\Q{inner}\\E>" if tag in self.even else self._even_element(inner, kind.item)
            body = f"(?:{item})*+"
        elif isinstance(kind, Ref):
            body = "".join(f"(?:{self._even_element(m.name, m.kind)})?+" for m in self.model.members(kind.subject))
        else:
            body = _TEXT
        return f"<\\Q{tag}\\E>{body}</\\Q{tag}\\E>"

    def test_even(self, x: Column) -> Column:
        return x.rlike(f"\\A(?:\\Q{PROLOG}\\E)?+{self._even_element(self.root, Ref(self.root))}\\z")

    def items(self, x: Column, to: T.StructType) -> Column:
        """The typed records of an even document's list, as an array. No other element has a name of theirs, and no text has a tag."""
        arrays = []
        for f in to.fields:
            if isinstance(f.dataType, T.StructType):
                got = self.items(x, f.dataType)
            else:
                got = F.regexp_extract_all(x, F.lit(f"<\\Q{f.name}\\E>([^<]*+)"), F.lit(1))
                if isinstance(f.dataType, T.StringType):
                    got = F.when(F.contains(x, F.lit("&")), F.transform(got, self._leaf)).otherwise(got)
                else:
                    got = got.cast(T.ArrayType(f.dataType))
            arrays.append(got.alias(f.name))
        return F.arrays_zip(*arrays)

    def _element(self, tag: str, kind: object) -> str:
        if isinstance(kind, Many):
            inner = [self._element(wire.item_tag(kind.item), kind.item)]
        elif isinstance(kind, Ref):
            inner = [self._element(m.name, m.kind) for m in self.model.members(kind.subject)]
        else:
            return f"<\\Q{tag}\\E>{_TEXT}</\\Q{tag}\\E>"
        body = f"(?:{_WS}(?:{'|'.join(inner)}))*+{_WS}" if inner else ""  # possessive: no stack however many there are
        return f"<\\Q{tag}\\E>{body}</\\Q{tag}\\E>"

    def test(self, x: Column) -> Column:
        return x.rlike(f"\\A{_WS}(?:\\Q{PROLOG}\\E)?{_WS}{self._element(self.root, Ref(self.root))}{_WS}\\z")

    def _value(self, kind: object, tag: str, x: Column, want: dict | None) -> Column:
        """The wire value of an element in a text that holds it."""
        if isinstance(kind, Ref):
            fields = self._fields(kind.subject, x, want)
            return F.struct(*fields) if fields else F.lit("")
        if isinstance(kind, Many):
            tag = wire.item_tag(kind.item)
            parts = F.split(x, f"</\\Q{tag}\\E>")
            items = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.substring_index(p, f"<{tag}>", -1))
            items = F.transform(items, lambda p: self._value(kind.item, tag, p, want))
            none = F.lit(None).cast("array<string>")
            return F.struct(items.alias(wire.ANY)) if isinstance(kind.item, Enum) else F.struct(items.alias(tag), none.alias(wire.ANY))
        return self._leaf(x)

    @staticmethod
    def _leaf(x: Column) -> Column:
        out = x
        for ref, c in _REFS:
            out = F.replace(out, F.lit(ref), F.lit(c))
        return F.when(F.contains(x, F.lit("&")), out).otherwise(x)

    def _fields(self, name: str, x: Column, want: dict | None, empty: dict[str, T.DataType] | None = None) -> list[Column]:
        out = []
        for m in wire.wanted(self.model.union(name), want):
            if m.name in (empty or {}):
                none = F.struct(*(F.array().cast(f.dataType).alias(f.name) for f in empty[m.name].fields))
                out.append(F.when(F.contains(x, F.lit(f"<{m.name}>")), none).alias(m.name))
                continue
            body = F.substring_index(F.substring_index(x, f"<{m.name}>", -1), f"</{m.name}>", 1)
            out.append(F.when(F.contains(x, F.lit(f"<{m.name}>")), self._value(m.kind, m.name, body, wire.below(want, m.name))).alias(m.name))
        return out

    def read(self, x: Column, want: dict | None, *more: Column, empty: dict[str, T.DataType] | None = None) -> Column:
        """The wire struct of a plain document. ``empty``: lists, with their wire types, that are left empty where they are."""
        return F.struct(*self._fields(self.root, x, want, empty), *more)
