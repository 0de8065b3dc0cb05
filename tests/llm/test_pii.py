import hashlib
import re

import pytest

from marlstone.llm import pii

TEXTS = [
    None, "", "plain words only", "a@b.com x@y.z.org, @no.com a@b a@@b.com a@b@c.de q@-.x",
    "1.2.3.4.5 10.0.0.256 0255.001.2.3 1.2.3 999.1.1.1.1.1.1.1 12.34.56.78",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 x 41111111111111112222 5500005555555559 1 2 3 4",
    "+1 (132) 555-1352 Bebe +12 +123456789012345678 +49.30.123456( +1 (",
    "é 🙂 a.b+c%d@mail.example.com 🙂 8.8.8.8", "x" * 3000 + "@" + "y" * 3000 + ".com", "1" * 5000 + " 1.1.1.1", "9.9.9.9" + "0" * 40,
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ssn 123-45-6789 iban DE89 3704 0044 0532 0130 00',
    "write to jane [at] mail [dot] com or call 212-555-0147 now", "%+-@a-.b", "a@b.c@d.e.f",
]


def by_patterns(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.findall("[0-9]", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    import random

    r = random.Random(2)
    texts = [t or "" for t in TEXTS] + ["".join(r.choices("ab@.-+ 0123456789()%", k=60)) for _ in range(3000)]
    for t in texts:
        assert pii.base_spans(t) == by_patterns(t), t


def test_query_columns(spark):
    rows = [(i, t, 5) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], 5), (3, TEXTS[3], 5)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string, found int").repartition(3)).collect()
    assert len(got) == len(rows)
    by = dict(zip(range(len(TEXTS)), TEXTS))
    for r in got:
        if r.doc_id is None:
            continue
        base = by_patterns(by[r.doc_id] or "")
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in base) for k in pii.BASE]
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))
    spans = {r.doc_id: r.spans for r in got}
    assert "secret:" in spans[11] and "ssn:" in spans[11] and "iban:" in spans[11]
    assert "email:9:" in spans[12] and "phone:" in spans[12]


def test_em_recovers_labelers():
    import numpy as np

    r = np.random.default_rng(0)
    right, counts, truth = [0.95, 0.9, 0.85, 0.8, 0.7], {}, {}
    for _ in range(4000):
        t = r.random() < 0.6
        v = "".join("+" if (r.random() < q) == t else "-" for q in right)
        counts["secret", v] = counts.get(("secret", v), 0) + 1
        truth["secret", v] = truth.get(("secret", v), 0) + t
    p = pii.reliabilities(counts)
    hits = sum(n if (p[k] > 0.5) == (truth[k] / n > 0.5) else 0 for k, n in counts.items())
    assert hits > 0.95 * 4000
    assert pii.classifier({}) == {}


def test_redact(spark):
    df = spark.createDataFrame([(1, "mail a@b.com now", "en", 16), (2, None, "en", None), (3, "clean", "x", 5)], "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[1].text == "mail <EMAIL> now" and got[1].n_chars == 16 and got[2].text is None and got[3].text == "clean"
    assert pii.redact(df.limit(0)).count() == 0 and pii.find(df.limit(0)).count() == 0


@pytest.mark.parametrize("big", [400_000])
def test_long_texts_take_linear_time(big):
    import time

    t = time.time()
    for x in ("a" * big + " a@b.cc", "1" * big, "1." * big, "+1" + " " * big, "a@" * big):
        pii.base_spans(x)
        pii.candidates(x, [])
    assert time.time() - t < 20


def test_spans_have_no_longest_length():
    for n in (8, 513, 1200, 50_000):
        secret = "aZ3" * n
        text = f"x secret={secret} y"
        assert [(k, text[a:b]) for k, a, b, _ in pii.candidates(text, [])] == [("secret", secret)]
        text = f"see ghp_{secret}."
        assert [(k, text[a:b]) for k, a, b, _ in pii.candidates(text, [])] == [("secret", f"ghp_{secret}")]
        name, host = "n" * n, "h" * n
        text = f"to {name} [at] {host} [dot] com."
        assert [(k, text[a:b]) for k, a, b, _ in pii.candidates(text, [])] == [("email", f"{name} [at] {host} [dot] com")]


@pytest.mark.parametrize("key", ["access_token", "client_secret", "AWS_SECRET_ACCESS_KEY", "api-key", "dbPassword", "secret_key", "AUTH_TOKEN_V2", "pwd", "token"])
def test_names_of_secrets(key):
    text = f"set {key}: 'q8Zr51kWm0pXc7' here"
    assert [(k, text[a:b]) for k, a, b, _ in pii.candidates(text, [])] == [("secret", "q8Zr51kWm0pXc7")]


def test_overlaps_against_brute_force():
    import random

    r = random.Random(6)
    parts = ["123-45-6789", "212-555-0147", "token=abcdefgh12345678", "4111 1111 1111 1111", "a@b.com", "DE89 3704 0044 0532 0130 00", "0044 20 7946 0958", "1.2.3.4", "secret: 123-45-6789", " ", "x", "-"]
    for _ in range(400):
        text = "".join(r.choices(parts, k=12))
        base = pii.base_spans(text)
        found = []
        for kind, pattern, *_ in (*pii._MORE, *pii._DIGITS):
            found += [(m.start(1), m.end(1), kind) for m in pattern.finditer(text)]
        taken, want = [(a, b) for _, a, b in base], []
        for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1], pii.KINDS.index(x[2]))):
            if not any(a < d and c < b for c, d in taken):
                want.append((kind, a, b))
                taken.append((a, b))
        assert [x[:3] for x in pii.candidates(text, base)] == want


def test_many_spans_take_linear_time():
    import time

    took = []
    for n in (4000, 32_000):
        text = "call 212-555-0147 or token=abcdefgh12345678 " * n
        t = time.time()
        assert len(pii.candidates(text, pii.base_spans(text))) == 2 * n
        took.append(time.time() - t)
    assert took[1] < 24 * took[0]


def test_classifier_does_not_depend_on_size():
    counts = {("secret", "+++++|22211"): 5, ("secret", "-0--+|10001"): 7, ("phone", "+0+++|21110"): 11, ("phone", "--0-+|00100"): 3}
    small, big = pii.classifier({k: 100 * c for k, c in counts.items()}), pii.classifier({k: 10**8 * c for k, c in counts.items()})
    assert all(abs(small[k] - big[k]) < 0.03 and (small[k] > 0.5) == (big[k] > 0.5) for k in counts)
    assert small["secret", "+++++|22211"] > 0.5 > small["secret", "-0--+|10001"]


def planted(seed, n=1500):
    """Texts with spans that are meant, and with others that only look alike. Returns (texts, meant spans)."""
    import random

    r = random.Random(seed)
    hexa = lambda k: "".join(r.choices("0123456789abcdef", k=k))
    digits = lambda k: "".join(r.choices("0123456789", k=k))
    texts, meant = [], []
    for i in range(n):
        kind = r.randrange(8)
        if kind == 0:
            head, span, ok = r.choice(["token = ", "api_key: ", "client_secret="]), hexa(40), True
        elif kind == 1:
            head, span, ok = "the secret: ", r.choice(["everybody", "somewhere", "naturally", "diligence"]), False
        elif kind == 2:
            head, span, ok = "her ssn is ", f"{r.randint(1, 665):03}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", True
        elif kind == 3:
            head, span, ok = "part no ", f"000-00-{digits(4)}", False
        elif kind == 4:
            head, span, ok = "call me at phone ", f"{r.randint(200, 989)}-{r.randint(200, 999)}-{digits(4)}", True
        elif kind == 5:
            head, span, ok = "write to mail ", f"jane{i} [at] example [dot] com", True
        elif kind == 6:
            bban = digits(18)
            check = 98 - int(bban + "131400") % 97
            head, span, ok = "bank account iban ", f"DE{check:02}{bban}", True
        else:
            head, span, ok = "serial ", f"XK{digits(2)}{''.join(r.choices('ABCDEFGHJK0123456789', k=16))}", False
        texts.append(f"It was said {head}{span} and then more.")
        meant.append((len("It was said " + head), len("It was said " + head + span)) if ok else None)
    return texts, meant


def test_precision_and_recall_on_planted_spans(spark):
    texts, meant = planted(3)
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    spans = {r.doc_id: {tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x} for r in got}
    hit = sum(m is not None and m in spans[i] for i, m in enumerate(meant))
    wrong = sum(len(s - {meant[i]}) for i, s in spans.items())
    recall, precision = hit / sum(m is not None for m in meant), hit / (hit + wrong)
    print(f"recall {recall:.3f} precision {precision:.3f}")
    assert recall > 0.95 and precision > 0.9
