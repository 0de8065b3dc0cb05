"""The registry of record types: subjects, their members, who derives from whom. Everything is checked here, once."""

from __future__ import annotations

from dataclasses import dataclass, field

from marlstone.functions.codecs import SCALARS, Codecs


class ModelError(ValueError):
    """A registry that can't be used."""


@dataclass(frozen=True)
class Enum:
    name: str
    members: tuple[str, ...]


@dataclass(frozen=True)
class Ref:
    subject: str


@dataclass(frozen=True)
class Many:
    """A list or an array."""

    item: object  # a scalar's name, Enum or Ref


@dataclass(frozen=True)
class Member:
    name: str
    kind: object  # a scalar's name, with ? if it may be null; Enum; Ref; Many
    ignored: bool = False
    default: object = None

    @property
    def nullable(self) -> bool:
        return isinstance(self.kind, str) and self.kind.endswith("?")

    @property
    def scalar(self) -> str | None:
        return self.kind.rstrip("?") if isinstance(self.kind, str) else None


@dataclass
class Subject:
    name: str
    members: tuple[Member, ...] = ()
    base: str | None = None  # members of the base follow its own
    abstract: bool = False
    root: bool = False
    factory: dict = field(default_factory=dict)  # defaults of absent members
    derived: list[str] = field(default_factory=list)


class Model:
    """Subjects by name. ``subject`` and ``derive`` register, ``check`` resolves all references."""

    def __init__(self, codecs: Codecs | None = None):
        self.codecs = codecs or Codecs()
        self.subjects: dict[str, Subject] = {}

    def subject(self, name: str, *members, base: str | None = None, abstract: bool = False, root: bool = False, factory: dict | None = None) -> Model:
        if name in self.subjects:
            raise ModelError(f"{name} is registered twice")
        got = tuple(m if isinstance(m, Member) else Member(*m) for m in members)
        if len({m.name for m in got}) < len(got):
            raise ModelError(f"{name} has two members of one name")
        self.subjects[name] = Subject(name, got, base, abstract, root, dict(factory or {}))
        return self

    def derive(self, base: str, name: str) -> Model:
        for x in (base, name):
            if x not in self.subjects:
                raise ModelError(f"{x} is not registered")
        if self.subjects[name].abstract:
            raise ModelError(f"{name} is abstract and can't stand for {base}")
        self.subjects[base].derived.append(name)
        return self

    def check(self) -> Model:
        for s in self.subjects.values():
            if s.abstract and not s.derived:
                raise ModelError(f"{s.name} is abstract and nothing derives from it")
            if s.base is not None and s.base not in self.subjects:
                raise ModelError(f"{s.name}: unknown base {s.base}")
            for m in self.members(s.name):
                self._kind(s.name, m.kind, True)
            for k in s.factory:
                if k not in {m.name for m in self.members(s.name)}:
                    raise ModelError(f"{s.name} has no member {k} to give a default")
            types: dict[str, object] = {}
            for m in self.union(s.name):
                if types.setdefault(m.name, m.kind) != m.kind:
                    raise ModelError(f"{s.name} and what derives from it disagree on {m.name}")
        return self

    def _kind(self, owner: str, kind: object, outer: bool) -> None:
        if isinstance(kind, str):
            if kind.rstrip("?") not in SCALARS:
                raise ModelError(f"{owner}: unknown type {kind}")
        elif isinstance(kind, Ref):
            if kind.subject not in self.subjects:
                raise ModelError(f"{owner}: {kind.subject} is not registered")
        elif isinstance(kind, Many) and outer:
            self._kind(owner, kind.item, False)
        elif not isinstance(kind, Enum):
            raise ModelError(f"{owner}: {kind!r} can't be a member")

    def members(self, name: str) -> list[Member]:
        """Own members first, then those of the base, without ignored ones; an own member hides a base's."""
        out, seen = [], set()
        at: str | None = name
        while at is not None:
            if at not in self.subjects:
                raise ModelError(f"{at} is not registered")
            out += [m for m in self.subjects[at].members if not m.ignored and m.name not in seen]
            seen |= {m.name for m in self.subjects[at].members}
            at = self.subjects[at].base
        return out

    def union(self, name: str) -> list[Member]:
        """Members of a subject and of all that derive from it, each once."""
        out: dict[str, Member] = {}
        for s in [*self.subjects[name].derived, name]:
            for m in self.members(s):
                out.setdefault(m.name, m)
        return list(out.values())

    def concrete(self, name: str) -> list[str]:
        s = self.subjects[name]
        return [*s.derived, *([] if s.abstract else [name])]

    def root(self, name: str) -> Subject:
        s = self.subjects.get(name)
        if s is None or not s.root:
            raise ModelError(f"{name} is not a root")
        return s
