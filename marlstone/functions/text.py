"""Column functions on XML text: escaping, entities, fragments. All stay inside the JVM."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

XSI = "http://www.w3.org/2001/XMLSchema-instance"
PROLOG = '<?xml version="1.0" encoding="utf-8"?>'
#: inside a character class: what is written as a numeric reference, and what XML 1.0 can't hold at all
_REFERRED = "\\r\\u00A0-\\u00FF\\x{10000}-\\x{10FFFF}"
_FORBIDDEN = "\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF"
_CDATA = r"<!\[CDATA\[.*?\]\]>"
_ATTRS = r"""(?:\s+[^\s=<>/]+\s*=\s*(?:"[^"]*"|'[^']*'))*\s*"""
_BEFORE_ROOT = r"(?s)^\s*(?:<\?.*?\?>\s*)?(?:<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*"


def escape(c: Column) -> Column:
    """Text as element content: the five markup characters, carriage returns, U+00A0 to U+00FF and what lies beyond U+FFFF as references.

    Characters that XML 1.0 can't hold (most control characters, U+FFFE, U+FFFF) raise an error that says so.
    """
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for raw, ref in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(ref))

    # one more in front, so that each part begins with a character to refer to; its reference is cut off again
    parts = F.regexp_extract_all(F.concat(F.lit("\r"), out), F.lit(f"[{_REFERRED}][^{_REFERRED}]*"), F.lit(0))
    written = F.transform(parts, lambda p: F.concat(F.lit("&#"), F.ascii(p).cast("string"), F.lit(";"), F.substring(p, 2, 2**31 - 1)))
    slow = F.substring(F.array_join(written, ""), len("&#13;") + 1, 2**31 - 1)
    wrong = F.raise_error(F.lit("text holds a character that XML 1.0 cannot"))
    return F.when(~c.rlike(f"[{_REFERRED}{_FORBIDDEN}]"), out).when(c.rlike(f"[{_FORBIDDEN}]"), wrong).otherwise(slow)


def special_overhead(c: Column) -> Column:
    """Four characters for each of ``< > & ` "``: what a length estimate adds for escaping."""
    return F.lit(4) * F.length(F.regexp_replace(c, '[^<>&`"]', ""))


def outside(c: Column, change, comments: bool = False) -> Column:
    """``change`` applied to what lies outside CDATA sections (and comments, if asked for)."""
    kept = f"{_CDATA}|<!--.*?-->" if comments else _CDATA
    parts = F.regexp_extract_all(c, F.lit(f"(?s){kept}|<[^<]*+|[^<]++"), F.lit(0))
    starts = ("<![CDATA[", "<!--") if comments else ("<![CDATA[",)

    def each(p: Column) -> Column:
        keep = F.startswith(p, F.lit(starts[0]))
        for s in starts[1:]:
            keep = keep | F.startswith(p, F.lit(s))
        return F.when(keep, p).otherwise(change(p))

    return F.array_join(F.transform(parts, each), "")


def named_entities(c: Column) -> Column:
    """Named HTML references, of which XML knows five, as numeric ones; CDATA sections are left alone."""
    known = {k: v for k, v in name2codepoint.items() if k not in ("amp", "lt", "gt", "quot", "apos")}
    table = F.expr("map(" + ", ".join(f"'{k}', '&#{v};'" for k, v in sorted(known.items())) + ")")

    def each(part: Column) -> Column:
        name = F.regexp_extract(part, "^([A-Za-z][A-Za-z0-9]*);", 1)
        ref = F.try_element_at(table, name)
        return F.when(ref.isNotNull(), F.concat(ref, F.substring(part, F.length(name) + 2, F.length(part)))).otherwise(F.concat(F.lit("&"), part))

    def numeric(x: Column) -> Column:
        parts = F.split(x, "&")
        return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), each), ""))

    some = F.contains(c, F.lit("&")) & c.rlike("&(?!amp;|lt;|gt;|quot;|apos;)[A-Za-z][A-Za-z0-9]*;")
    return F.when(some, F.when(has_cdata(c), outside(c, numeric)).otherwise(numeric(c))).otherwise(c)


def retagged(c: Column, base: str, names: list[str]) -> Column:
    """Elements named by a derived type as elements of the base with a type attribute. CDATA sections and comments are left alone."""
    alt = "|".join(names)

    def change(x: Column) -> Column:
        x = F.regexp_replace(x, rf"<({alt})(?=[\s>])", f'<{base} xmlns:xsi="{XSI}" xsi:type="$1"')
        return F.regexp_replace(x, f"</(?:{alt})\\s*>", f"</{base}>")

    return F.when(c.rlike(rf"<(?:{alt})[\s>]"), F.when(F.contains(c, F.lit("<!")), outside(c, change, True)).otherwise(change(c))).otherwise(c)


def may_be_bodyless(c: Column) -> Column:
    """False for most documents, without a pattern: no tag ends in a slash and none is marked nil."""
    out = F.contains(c, F.lit("/>")) | F.contains(c, F.lit(":nil"))
    for blank in " \t\r\n":
        out = out | F.contains(c, F.lit(f"/{blank}"))
    return out


def drop_bodyless(c: Column) -> Column:
    """Remove child elements without a body and those marked nil; a root without a body gets an empty one.

    Comments, CDATA sections and quoted attribute values are left alone.
    """
    nil = rf"""<([^\s/>!?]+)(?:\s+[^\s=<>/]+\s*=\s*(?:"[^"]*"|'[^']*'))*?\s+[\w.-]+:nil\s*=\s*["']true["']{_ATTRS}>\s*</\2>"""
    some = rf"(?s)(<!\[CDATA\[.*?\]\]>|<!--.*?-->)|{nil}|<[^\s/>!?]+{_ATTRS}/>"
    root = F.regexp_replace(c, rf"({_BEFORE_ROOT}<([^\s/>!?]+){_ATTRS})/>", "$1></$2>")
    return F.when(may_be_bodyless(c), F.regexp_replace(root, some, "$1")).otherwise(c)


def cut_head(c: Column) -> Column:
    """Without the prolog, the comments before the root, and the white space around them."""
    body = F.regexp_replace(c, r"(?s)^\s*<\?xml.*?\?>", "")
    body = F.regexp_replace(body, r"(?s)^\s*(?:<!--.*?-->\s*)*", "")
    return F.regexp_replace(body, r"\s+$", "")


def leading_comment_length(c: Column) -> Column:
    """Length of the comments that a text begins with, and of what stands before and between them."""
    return F.length(F.regexp_extract(c, r"(?s)^(?:[^<]*<!--.*?-->)*", 0))


def has_comment(c: Column) -> Column:
    return F.contains(c, F.lit("<!--"))


def has_cdata(c: Column) -> Column:
    return F.contains(c, F.lit("<![CDATA["))


def root_head(c: Column) -> Column:
    """The root's start tag."""
    return F.regexp_extract(c, rf"{_BEFORE_ROOT}(<[^\s/>!?]+{_ATTRS}/?>)", 1)


def root_name(c: Column) -> Column:
    return F.regexp_extract(c, rf"{_BEFORE_ROOT}<(?:[^\s/>!?:]+:)?([^\s/>!?:]+)", 1)


def xsi_type(c: Column) -> Column:
    """The local name in the root's ``type`` attribute, whatever its prefix; '' if it has none."""
    return F.regexp_extract(root_head(c), r"""\s[^\s=<>/:]+:type\s*=\s*["'](?:[^"':]*:)?([^"':]*)["']""", 1)


def precise_type(c: Column) -> Column:
    """What the root is: its type attribute, else its name."""
    t = xsi_type(c)
    return F.when(t != "", t).otherwise(root_name(c))


def attributes(c: Column) -> Column:
    """Attributes of the root: array of (prefix, name, value), in order."""
    found = F.regexp_extract_all(root_head(c), F.lit(r"""(\s[^\s=<>/]+\s*=\s*(?:"[^"]*"|'[^']*'))"""), 1)

    def each(a: Column) -> Column:
        full = F.trim(F.regexp_extract(a, r"^\s([^\s=]+)", 1))
        return F.struct(
            F.when(F.contains(full, F.lit(":")), F.substring_index(full, ":", 1)).otherwise("").alias("prefix"),
            F.substring_index(full, ":", -1).alias("name"),
            F.regexp_extract(a, r"""(?s)=\s*["'](.*)["']$""", 1).alias("value"),
        )

    return F.transform(found, each)


def find_attribute(c: Column, prefix: str | None = None, name: str | None = None, value: str | None = None) -> Column:
    """The first attribute of the root that has what is asked for, as a struct; null if none has."""
    ask = lambda a: F.lit(True) & (a["prefix"] == prefix if prefix is not None else F.lit(True)) & (a["name"] == name if name is not None else F.lit(True)) & (a["value"] == value if value is not None else F.lit(True))
    return F.try_element_at(F.filter(attributes(c), ask), F.lit(1))


def xsi_prefix(c: Column) -> Column:
    """The prefix that the root binds to the schema-instance namespace; null if it binds none."""
    return find_attribute(c, prefix="xmlns", value=XSI)["name"]


def first_child(c: Column) -> Column:
    """(name, text) of the root's first child.

    A root whose children are mere texts, without attributes, references or a colon in a name, is recognised as a whole by one pattern;
    any other document is parsed, once.
    """
    ws, name, chars = "[ \\t\\r\\n]*+", "[A-Za-z_][A-Za-z0-9_.-]*+", "[\\x3F-\\uD7FF\\x27-\\x3B\\x20-\\x25=\\n\\t\\uE000-\\uFFFD\\x{10000}-\\x{10FFFF}]*"
    start = f"\\A(?:\\Q{PROLOG}\\E)?+{ws}<({name})>{ws}"
    flat = f"{start}(?:<({name})>{chars}</\\2>{ws})++</\\1>{ws}\\z"
    cut = [F.regexp_extract(c, f"{start}<({name})>([^<]*+)", i) for i in (2, 3)]
    parsed = F.xpath_string(c, F.lit("concat(name(/*/*[1]), ' ', /*/*[1])"))  # a name holds no blank

    def both(x: Column) -> Column:
        return F.struct(F.substring_index(x, " ", 1).alias("name"), F.substr(x, F.instr(x, " ") + 1).alias("text"))

    # the text is an item of an array, so that it is parsed once and not for each use
    return F.when(c.rlike(flat), F.struct(cut[0].alias("name"), cut[1].alias("text"))).otherwise(F.transform(F.array(parsed), both)[0])


def inner(c: Column) -> Column:
    """The root's body as it stands."""
    return F.regexp_extract(c, rf"(?s){_BEFORE_ROOT[4:]}<[^\s/>!?]+{_ATTRS}>(.*)</[^<>]*>\s*(?:<!--.*?-->\s*)*$", 1)
