"""Personal data: fixed patterns, and more spans by weak supervision.

The four base kinds are defined by patterns and checks and always stay. Looser patterns propose more candidates:
secrets, obfuscated e-mail addresses, national numbers, IBANs, telephone numbers without a plus. Labelers vote on each
candidate: its strict format, gazetteers (top-level domains, country codes with their lengths, key prefixes), the words
before it, a checksum or its entropy, and its borders. Expectation-maximisation over the counts of vote patterns of the whole
corpus estimates, for each kind, how reliable each labeler is. A logistic span classifier is trained on the posteriors; it sees
the votes and features of the span and its surroundings (length, digits, entropy, case, the character before it), and decides
which candidates are added. Only counts of signatures (votes and features) reach the driver: at most 3**5 * 216 for each kind,
whatever the corpus.

Null texts are empty; empty texts have no spans. Rows are judged one by one, repeated rows alike; a null doc_id stays null.
Patterns have no upper bound on what they take and time is linear in the text, however long. Candidates never overlap a base
span or each other: that which starts first goes, at one start the longer, at one length the kind listed first. Positions
count code points, the end excluded. An empty table gives an empty result. Extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from marlstone.llm.session import cut, prepare, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "ssn", "iban")
LABELERS = 5
ACCEPT = 0.5
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: a start inside a run of digits matches only where the run's start does, so such starts needn't be tried
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > last and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", lo, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
                out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


#: (kind, pattern, text in lower case that must be there)
_MORE = (
    (
        "secret",
        re.compile(r"(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z])(?=[A-Z])))(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth)(?:[_-][A-Za-z0-9]+)*+\b[\x20\"']*+[:=][\x20]*+[\"']?([A-Za-z0-9+/_=-]{8,}+)", re.I),
        ("token", "secret", "passw", "pwd", "key", "auth"),
    ),
    ("secret", re.compile(r"(?<![A-Za-z0-9])((?:ghp_|sk-|AKIA|xox[bap]-)[A-Za-z0-9_-]{12,}+)"), ("ghp_", "sk-", "akia", "xox")),
    (
        "email",
        re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9][A-Za-z0-9._%+-]*+\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z]{2,}+)+)(?![A-Za-z0-9])", re.I),
        ("[at]", "(at)", "[dot]", "(dot)", " dot "),
    ),
)
_DIGITS = (
    ("ssn", re.compile(r"(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")),
    ("phone", re.compile(r"(?<![0-9+.-])(\([0-9]{3}\)[\x20-]?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|00[1-9][0-9]{0,2}[\x20-][0-9]{2,4}(?:[\x20-][0-9]{2,4}){2,3})(?![0-9])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?)(?![A-Za-z0-9])")),
)
#: fixed values: top-level domains, and the length of an IBAN by country
_TLD = frozenset("com org net edu gov mil int io ai app dev co me tv info biz name pro de fr es uk us eu ch it nl at be bg br ca cn cz dk ee fi gr hr hu ie in jp kr lt lu lv mx no nz pl pt ro ru se si sk tr ua za au".split())
_IBAN = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24}
_WORDS = {
    "secret": re.compile(r"token|secret|passw|key|auth|credential", re.I),
    "ssn": re.compile(r"ssn|social|security", re.I),
    "iban": re.compile(r"iban|account|bank|konto|cuenta|compte", re.I),
    "email": re.compile(r"mail|contact|write|reach", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax|contact", re.I),
}


def _entropy(s: str) -> float:
    n = Counter(s)
    return -sum(c / len(s) * math.log2(c / len(s)) for c in n.values())


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(kind: str, text: str, lo: int, hi: int) -> str:
    """One sign for each labeler: + for, - against, 0 no opinion."""
    s, before, after = text[lo:hi], text[max(0, lo - 40) : lo], text[hi : hi + 1]
    digits = sum(c.isdigit() for c in s)
    if kind == "secret":
        form = "+" if re.fullmatch(r"[0-9a-f]{32,}|[A-Za-z0-9+/_=-]{20,}", s) else "-" if len(s) < 12 else "0"
        place = "+" if s.startswith(("ghp_", "sk-", "AKIA", "xox")) else "-" if s.isalpha() and s.islower() else "0"
        check = "+" if digits and _entropy(s) > 3 else "-" if not digits or _entropy(s) < 2.2 else "0"
    elif kind == "email":
        form = "+" if "[" in s or "(" in s else "0"
        place = "+" if s.rsplit(None, 1)[-1].rsplit("]", 1)[-1].rsplit(")", 1)[-1].lower() in _TLD else "-"
        check = "0"
    elif kind == "phone":
        form = "+" if 10 <= digits <= 15 else "-"
        place = "+" if s.startswith("(") or s.startswith("00") else "0"
        check = "-" if len({c for c in s if c.isdigit()}) < 3 else "+"
    elif kind == "ssn":
        form = "-" if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else "+"
        place, check = "0", "-" if len({c for c in s if c.isdigit()}) < 3 else "+"
    else:
        size = len(s.replace(" ", ""))
        form = "+" if 15 <= size <= 34 else "-"
        place = "+" if _IBAN.get(s[:2]) == size else "-"
        check = "+" if _mod97(s) else "-"
    context = "+" if _WORDS[kind].search(before) else "0" if kind == "secret" else "-"
    border = "-" if (before[-1:].isalnum() or after.isalnum()) else "+"
    return form + place + context + check + border


#: levels of each feature
LEVELS = (4, 3, 3, 3, 2)


def features(text: str, lo: int, hi: int) -> str:
    """A digit for each feature of a span: length, share of digits, entropy, the character before it, mixed case."""
    s, before = text[lo:hi], text[lo - 1 : lo] if lo else ""
    digits = sum(c.isdigit() for c in s) / len(s)
    bits = _entropy(s)
    return "".join(
        str(x)
        for x in (
            (len(s) >= 10) + (len(s) >= 20) + (len(s) >= 40),
            (digits > 0) + (digits >= 0.5),
            (bits >= 2.5) + (bits >= 3.5),
            1 if before in ("=", ":", '"', "'") else 2 if before.isalnum() else 0,
            int(any(c.isupper() for c in s) and any(c.islower() for c in s)),
        )
    )


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, signature) of spans beside the base ones, none overlapping another."""
    found = []
    low = text.lower()
    for kind, pattern, needs in _MORE:
        if any(x in low for x in needs):
            found += [(m.start(1), m.end(1), kind) for m in pattern.finditer(text)]
    if _DIGIT.search(text):
        for kind, pattern in _DIGITS:
            found += [(m.start(1), m.end(1), kind) for m in pattern.finditer(text)]
    if not found:
        return []
    taken = sorted((a, b) for _, a, b in base)
    starts, tops = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    out, last = [], 0
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
        k = bisect_left(starts, b)  # base spans that begin before this one ends
        if a >= last and not (k and tops[k - 1] > a):
            out.append((kind, a, b, f"{votes(kind, text, a, b)}|{features(text, a, b)}"))
            last = b
    return out


def reliabilities(counts: dict[tuple[str, str], int], rounds: int = 200) -> dict[tuple[str, str], float]:
    """Posterior of each (kind, votes) by EM: labelers vote independently given the truth; an abstention says nothing.

    For each kind, a labeler has two chances to vote for a span: if it is one, starting from 0.7, and if it isn't, starting
    from 0.3, both with the weight of 20 votes; so one that always votes the same says nothing. The first is never the lower,
    which says which of the two classes is meant. Each kind has a prior.
    """
    keys = sorted(counts)
    if not keys:
        return {}
    n = np.array([counts[k] for k in keys], float)
    v = np.array([[{"+": 1, "-": -1, "0": 0}[c] for c in x] for _, x in keys])
    kinds = sorted({k for k, _ in keys})
    kind = np.array([kinds.index(k) for k, _ in keys])
    true, false = np.full((len(kinds), LABELERS), 0.7), np.full((len(kinds), LABELERS), 0.3)
    prior = np.full(len(kinds), 0.5)
    by_kind = np.zeros((len(kinds), len(keys)))
    by_kind[kind, np.arange(len(keys))] = n
    for _ in range(rounds):
        says = lambda c: (np.where(v == 1, np.log(c)[kind], 0) + np.where(v == -1, np.log(1 - c)[kind], 0)).sum(1)
        p = 1 / (1 + np.exp(np.clip(np.log(1 - prior)[kind] + says(false) - np.log(prior)[kind] - says(true), -500, 500)))
        for chance, weight, start in ((true, p, 14), (false, 1 - p, 6)):
            chance[:] = (by_kind @ ((v == 1) * weight[:, None]) + start) / (by_kind @ ((v != 0) * weight[:, None]) + 20)
        wrong = true < false
        true[wrong] = false[wrong] = ((true + false) / 2)[wrong]
        np.clip(true, 0.01, 0.99, out=true)
        np.clip(false, 0.01, 0.99, out=false)
        prior = np.clip((by_kind @ p + 1) / (by_kind.sum(1) + 2), 0.05, 0.95)
    return dict(zip(keys, p.tolist(), strict=True))


def classifier(counts: dict[tuple[str, str], int], steps: int = 400) -> dict[tuple[str, str], float]:
    """Logistic regression on kind, votes and span features, fitted to the posteriors.

    Signatures of a kind weigh by their share of that kind, so a larger corpus of the same make gives the same classifier.
    """
    marginal: dict[tuple[str, str], int] = {}
    for (kind, sign), c in counts.items():
        k = (kind, sign.split("|")[0])
        marginal[k] = marginal.get(k, 0) + c
    soft = reliabilities(marginal)
    keys = sorted(counts)
    if not keys:
        return {}
    size = Counter()
    for (kind, _), c in counts.items():
        size[kind] += c
    first = np.concatenate([[0], np.cumsum(LEVELS)]) + len(KINDS) + 2 * LABELERS
    x = np.zeros((len(keys), int(first[-1])))
    for i, (kind, sign) in enumerate(keys):
        v, _, f = sign.partition("|")
        x[i, KINDS.index(kind)] = 1
        for j, c in enumerate(v):
            x[i, len(KINDS) + 2 * j] = c == "+"
            x[i, len(KINDS) + 2 * j + 1] = c == "-"
        for j, c in enumerate(f):
            x[i, first[j] + int(c)] = 1
    y = np.array([soft[k, v.split("|")[0]] for k, v in keys])
    n = np.array([200 * counts[k] / size[k[0]] for k in keys])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (y - p)) - 0.1 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip(keys, (1 / (1 + np.exp(-x @ w))).tolist(), strict=True))


_SPAN = "array<struct<kind:string,s:int,e:int,votes:string>>"
_SPAN_PA = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("votes", pa.string())]))


def _spans_of(text: str | None) -> list[dict]:
    base = base_spans(text or "")
    return [{"kind": k, "s": s, "e": e, "votes": None} for k, s, e in base] + [{"kind": k, "s": s, "e": e, "votes": v} for k, s, e, v in candidates(text or "", base)]


def _scan(batches):
    for b in batches:
        rows = [_spans_of(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, _SPAN_PA)], names=["doc_id", "found"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, found: base spans (votes null) and candidates with their signatures."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, f"doc_id long, found {_SPAN}")


def learn(found: DataFrame) -> dict[tuple[str, str], float]:
    """The span classifier, from the signatures of all documents' candidates."""
    each = found.select(F.explode("found").alias("x")).where("x.votes is not null")
    rows = each.groupBy("x.kind", "x.votes").count().collect()  # at most 3**5 * 216 for each kind
    return classifier({(r[0], r[1]): r[2] for r in rows})


def _digest(model: dict[tuple[str, str], float], accept: float):
    order = {k: i for i, k in enumerate(KINDS)}
    good = {k for k, p in model.items() if p >= accept}

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for found in b.column(1).to_pylist():
                base = [x for x in found if x["votes"] is None]
                every = base + [x for x in found if x["votes"] is not None and (x["kind"], x["votes"]) in good]
                say = lambda xs: ",".join(f"{x['kind']}:{x['s']}:{x['e']}" for x in sorted(xs, key=lambda x: (order[x["kind"]], x["s"])))
                n = Counter(x["kind"] for x in base)
                for c, v in zip(cols, [*(n[k] for k in BASE), hashlib.sha256(say(base).encode()).hexdigest(), say(every)], strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return run


def find(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = cut(scan(docs))
    return found.mapInArrow(_digest(learn(found), accept), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with spans (start, end, kind) replaced; of overlapping ones, that which starts first names all."""
    out, at = [], 0
    for s, e, k in sorted(spans):
        if e <= at:
            continue
        out += [text[at : max(s, at)], f"<{k.upper()}>"] if s >= at else []
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in angle brackets, and n_chars brought up to date.

    Texts are searched once: the spans found are written beside their rows, the classifier is learned from them, and the
    rows are read again to be redacted.
    """
    prepare(docs.sparkSession)
    spans = "found"
    while spans.lower() in {c.lower() for c in docs.columns}:
        spans += "_"
    at = docs.columns.index("text")

    def search(batches):
        for b in batches:
            yield b.append_column(spans, pa.array([_spans_of(t) for t in b.column(at).to_pylist()], _SPAN_PA))

    rows = cut(docs.mapInArrow(search, T.StructType([*docs.schema.fields, T.StructField(spans, T._parse_datatype_string(_SPAN))])))
    good = {k for k, p in learn(rows.select(F.col(spans).alias("found"))).items() if p >= accept}

    def run(batches):
        for b in batches:
            new = []
            for text, found in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                some = [(x["s"], x["e"], x["kind"]) for x in found if x["votes"] is None or (x["kind"], x["votes"]) in good]
                new.append(redacted(text, some) if some else text)
            b = pa.RecordBatch.from_arrays(b.columns[:-1], schema=pa.schema(list(b.schema)[:-1]))
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    out = rows.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def op7(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents", True))
