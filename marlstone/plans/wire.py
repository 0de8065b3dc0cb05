"""Schemas: how a subject looks on the wire, all leaves strings, and as typed columns. Both are cut down to what is asked for."""

from __future__ import annotations

from pyspark.sql import types as T

from marlstone.functions.codecs import SCALARS
from marlstone.plans.model import Enum, Many, Member, Model, ModelError, Ref

#: how often a subject may hold itself, unless the caller says otherwise; what lies deeper raises
DEPTH = 3
TYPE = "_type"
#: children of a list that have another name than its items
ANY = "xs_any"


def tree(paths: list[str] | None) -> dict | None:
    """Dotted paths as nested dicts; None takes everything."""
    if paths is None:
        return None
    out: dict = {}
    for p in paths:
        at = out
        for x in p.split("."):
            at = at.setdefault(x, {})
    return out


def known(model: Model, name: str, want: dict | None) -> dict | None:
    """``want``, or an error if it names a member that the model doesn't have."""
    for k, sub in (want or {}).items():
        m = next((m for m in model.union(name) if m.name == k), None)
        if m is None:
            raise ModelError(f"{name} has no member {k}")
        kind = m.kind.item if isinstance(m.kind, Many) else m.kind
        if isinstance(kind, Ref):
            known(model, kind.subject, sub)
        elif sub:
            raise ModelError(f"{name}.{k} has no members")
    return want


def wanted(members: list[Member], want: dict | None) -> list[Member]:
    return members if not want else [m for m in members if m.name in want]


def below(want: dict | None, name: str) -> dict | None:
    return (want or {}).get(name) or None


def item_tag(kind: object) -> str:
    return kind.rstrip("?") if isinstance(kind, str) else kind.name if isinstance(kind, Enum) else kind.subject


def fits(kind: object, seen: tuple[str, ...], depth: int) -> bool:
    """False for a member that would hold its own type more than ``depth`` times."""
    kind = kind.item if isinstance(kind, Many) else kind
    return not isinstance(kind, Ref) or seen.count(kind.subject) < depth


def depth_of(model: Model, name: str, data: T.StructType, seen: tuple[str, ...] = ()) -> int:
    """How often a subject holds itself in a typed schema."""
    seen = (*seen, name)
    best = seen.count(name)
    for m in model.union(name):
        kind = m.kind.item if isinstance(m.kind, Many) else m.kind
        if isinstance(kind, Ref) and m.name in data.names:
            inner = data[m.name].dataType
            inner = inner.elementType if isinstance(inner, T.ArrayType) else inner
            if isinstance(inner, T.StructType):
                best = max(best, depth_of(model, kind.subject, inner, seen))
    return best


def own_tags(model: Model, base: str, split: bool) -> list[str]:
    """Derived names that are fields of their own in a list of ``base``: those that name a member somewhere, too; all if ``split``."""
    names = [d for d in model.subjects[base].derived if d != base]
    if split:
        return names
    taken = {m.name for s in model.subjects.values() for m in s.members}
    return [d for d in names if d in taken]


def struct(model: Model, name: str, want: dict | None = None, seen: tuple[str, ...] = (), depth: int = DEPTH, split: bool = False) -> T.StructType:
    """A member that lies too deep is a string, so that it is noticed."""
    seen = (*seen, name)
    fields = [T.StructField(TYPE, T.StringType())] if model.subjects[name].derived else []
    for m in wanted(model.union(name), want):
        fields.append(T.StructField(m.name, leaf(model, m.kind, below(want, m.name), seen, depth, split) if fits(m.kind, seen, depth) else T.StringType()))
    return T.StructType(fields)


def leaf(model: Model, kind: object, want: dict | None, seen: tuple[str, ...], depth: int, split: bool) -> T.DataType:
    if isinstance(kind, Ref):
        inner = struct(model, kind.subject, want, seen, depth, split)
        return inner if inner.fields else T.StringType()
    if isinstance(kind, Many):
        any_ = T.StructField(ANY, T.ArrayType(T.StringType()))
        if isinstance(kind.item, Enum):  # whatever its items are called
            return T.StructType([any_])
        item = T.ArrayType(leaf(model, kind.item, want, seen, depth, split))
        tags = [item_tag(kind.item), *(own_tags(model, kind.item.subject, split) if isinstance(kind.item, Ref) else [])]
        return T.StructType([*(T.StructField(t, item) for t in tags), any_])
    return T.StringType()


def typed(model: Model, name: str, want: dict | None = None, seen: tuple[str, ...] = (), depth: int = DEPTH) -> T.StructType:
    """The schema that decoding gives and encoding takes."""
    seen = (*seen, name)
    fields = [T.StructField(TYPE, T.StringType())] if model.subjects[name].derived else []

    def of(kind, sub):
        if isinstance(kind, Ref):
            return typed(model, kind.subject, sub, seen, depth)
        if isinstance(kind, Many):
            return T.ArrayType(of(kind.item, sub))
        return T.StringType() if isinstance(kind, Enum) else T._parse_datatype_string(SCALARS[kind.rstrip("?")].sql)

    for m in wanted(model.union(name), want):
        if fits(m.kind, seen, depth):
            fields.append(T.StructField(m.name, of(m.kind, below(want, m.name))))
    return T.StructType(fields)
