import hashlib
import math
import random
import re

from cases import ODD, odd
from pyspark.sql import functions as F

from geoloom.llm import pii as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(d):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def _slow(text):
    out = []
    for k, kind in enumerate(P.KINDS):
        for m in re.finditer(PLAIN[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and _luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), m.end(), k))
    return sorted(out)


TEXTS = [
    "mail a.b+c@x-y.co.uk. or a@b.c_x@d.e and q@@w.e, foo@bar, é@é.com x@y.z.",
    "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 and 001.02.3.4 or 1.2.3 10.0.0.255",
    "card 4111 1111 1111 1111, 4111-1111-1111-1111 and 41111111111111112 5 4 3 4111  1111 4111 1111 1111 1111 2",
    "call +1 (171) 555-2028 or +49.30.1234567- +1 +12345678901234567 ++1 222 333 4444)",
    "😀 +1 (171) 555-2028 😀 a@b.cd 9807915762804490",
    "1" * 20000 + "." + "a" * 20000 + "@" + "b." * 5000 + " " + "1 " * 9000,
]


def _frame(spark, texts):
    return odd(spark, list(enumerate(texts)))


def test_base_spans_against_plain_patterns(spark):
    rows = P.personal_data(_frame(spark, TEXTS)).collect()
    for r in rows:
        assert [tuple(x) for x in r.base] == _slow(TEXTS[r.doc_id]), TEXTS[r.doc_id][:80]


def test_contexts_discover_unseen_identifiers(spark):
    known = [f"word{i} customer mail: user{i}@site.example.com and more" for i in range(6)]
    hidden = ["see customer mail: user77@intranet for it", "no customer post: user78@intranet for it", "the customer mail: nobody here"]
    rows = {r.doc_id: r for r in P.personal_data(_frame(spark, known + hidden)).collect()}
    text = hidden[0]
    at = text.index("user77")
    assert [tuple(x) for x in rows[6].spans] == [(at, at + len("user77@intranet"), 0)] and rows[6].base == []
    assert rows[7].spans == [] and rows[8].spans == [] and all(rows[i].spans == rows[i].base for i in range(6))


def _shape(v):
    d = re.sub("[^0-9]", "", v)
    card = "c" if 14 <= len(d) <= 19 and not re.search("[^0-9 -]", v) and _luhn(d) else ""
    phone = "p" if 10 <= len(d) <= 15 else ""
    return re.sub("[0-9]", "9", re.sub(r"[^\W\d_]+", "a", v)) + "|" + card + phone


def _instance(text, s, e, before, after):
    v = text[s:e]
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", before.lower()) if w][-2:]
    head = [w for w in re.split(r"[ \t\n\x0b\f\r]+", after.lower()) if w][:1]
    out = [("shape", _shape(v))]
    if words:
        out += [("two", " ".join(words), "@" in v), ("last", words[-1], _shape(v))]
    if head:
        out.append(("first", head[0], _shape(v)))
    return v, out


def _plain(texts):
    """The whole method in plain Python: for each text its base and all spans."""
    found = []
    for text in texts:
        text, seeds, cands = text or "", [], []
        base = _slow(text)
        for k, kind in enumerate(P.KINDS):
            ends = [m.span() for m in re.finditer(PLAIN[kind], text)]
            for i, (s, e) in enumerate(ends):
                if (s, e, k) in base:
                    before, after = text[ends[i - 1][1] if i else 0 : s], text[e : ends[i + 1][0] if i + 1 < len(ends) else None]
                    seeds.append((k, *_instance(text, s, e, before, after)))
        toks = [m.span() for m in re.finditer(r"(?<![^ \t\n\x0b\f\r])[^ \t\n\x0b\f\r0-9@]*[0-9@][^ \t\n\x0b\f\r]*", text)]
        for i in range(len(toks)):
            for m in range(1, P.RUN + 1):
                part = toks[i : i + m]
                if len(part) < m or any(text[a[1] : b[0]] != " " for a, b in zip(part, part[1:], strict=False)):
                    continue
                whole = text[part[0][0] : part[-1][1]]
                lead = len(re.match(r"(?:[\W_](?<![+@]))*", whole)[0])
                v = re.sub(r"[\W_]+$", "", whole[lead:])
                s, e = part[0][0] + lead, part[0][0] + lead + len(v)
                if len(v) < P.SIGNS or any(x < e and y > s for x, y, _ in base):
                    continue
                before, after = text[toks[i - 1][1] if i else 0 : toks[i][0]], text[part[-1][1] : toks[i + m][0] if i + m < len(toks) else None]
                cands.append((s, e, *_instance(text, s, e, before, after)))
        found.append((base, seeds, cands))
    edges, seed = {}, {}
    for _, seeds, cands in found:
        for k, v, pats in seeds:
            for q in pats:
                edges.setdefault(q, {}).setdefault(v, set()).add(k)
            seed.setdefault(v, set()).add(k)
        for *_, v, pats in cands:
            for q in pats:
                edges.setdefault(q, {}).setdefault(v, set())
    score = {v: [float(k in ks) for k in range(4)] for v, ks in seed.items()}
    conf = {}
    for _ in range(P.ROUNDS):
        conf = {q: [round(sum(score.get(v, [0] * 4)[k] for v in vs) / len(vs), 9) for k in range(4)] for q, vs in edges.items()}
        of = {}
        for q, vs in edges.items():
            for v in vs:
                of.setdefault(v, []).append(conf[q])
        score = {v: [max(float(k in seed.get(v, ())), 1 - math.prod(max(1 - c[k], 1e-9) for c in cs)) for k in range(4)] for v, cs in of.items()}
    trust = {}
    for q, c in conf.items():
        able = [(c[k], -k) for k in range(4) if c[k] >= P.TRUST and sum(k in ks for ks in edges[q].values()) >= P.SUPPORT]
        if able:
            trust[q] = max((x, sum(-j in ks for ks in edges[q].values()), j) for x, j in able)
    out = []
    for base, _, cands in found:
        extra = set()
        for s, e, _, pats in cands:
            best = [(trust[q][0], trust[q][2]) for q in pats if q in trust]
            if best:
                extra.add((s, e, -max(best)[1]))
        out.append((base, sorted(base + list(extra))))
    return out


def _card(rng):
    d = [rng.randint(1, 9)] + [rng.randint(0, 9) for _ in range(14)]
    return next(x for x in ("".join(map(str, [*d, c])) for c in range(10)) if _luhn(x))


def _planted(seed):
    """Texts with identifiers that base patterns find, and (text number, start, end, kind) of those that they miss."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 7)))
    phone = lambda: f"+{rng.randint(1, 9)} ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    ip = lambda: ".".join(str(rng.randint(10, 255)) for _ in range(4))
    texts, hidden = [], []
    for _ in range(30):
        texts += [f"{word()} write to {word()}{rng.randint(1, 99)}@{word()}.org, {word()}", f"{word()} {word()} {phone()} {word()}"]
        texts += [f"{word()} paid by card {_card(rng)}. {word()}", f"from host {ip()} {word()}", f"{word()} {rng.randint(10**15, 10**16)} {word()} 3.{rng.randint(10, 99)}"]
    for kind, made in ((0, lambda: ("please write to ", f"{word()}@localhost", ".")), (3, lambda: (f"{word()} ", phone(), f" {ip()} {word()}")), (2, lambda: (f"{word()} ", _card(rng), f" {_card(rng)} {word()}")), (1, lambda: ("login from host ", f"{rng.randint(1, 9)}ab:{rng.randint(1000, 9999)}:cd", " today"))):
        for _ in range(5):
            a, b, c = made()
            hidden.append((len(texts), len(a), len(a) + len(b), kind))
            texts.append(a + b + c)
    return texts, hidden


def test_discovery_of_all_kinds(spark):
    texts, hidden = _planted(1)
    want = _plain(texts)
    rows = {r.doc_id: r for r in P.personal_data(_frame(spark, texts)).collect()}
    for i, (base, spans) in enumerate(want):
        assert [tuple(x) for x in rows[i].base] == base and [tuple(x) for x in rows[i].spans] == spans, texts[i]
    extra = {(i, *x) for i, (base, spans) in enumerate(want) for x in spans if x not in base}
    second = {(i, e + 1, e + 17, 2) for i, _, e, k in hidden if k == 2}
    assert set(hidden) <= extra  # recall: all four kinds
    assert extra <= set(hidden) | second  # precision


def test_copies_do_not_make_a_pattern(spark):
    texts = ["customer mail: user1@site.example.com"] * 50 + ["customer mail: user77@intranet"]
    rows = {r.doc_id: r for r in P.personal_data(_frame(spark, texts)).collect()}
    assert rows[50].spans == [] and len(rows) == 51


def test_mask(spark):
    df = _frame(spark, ["call +1 (171) 555-2028 or a@b.cd now"]).select("doc_id", "text")
    out = df.join(P.personal_data(df), "doc_id").select(P.mask(F.col("text"), F.col("spans")).alias("m")).first()
    assert out.m == "call [phone] or [email] now"


def test_odd_rows(spark):
    rows = P.personal_data(odd(spark)).collect()
    assert len(rows) == len(ODD) and P.personal_data(odd(spark, [])).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    plain = dict(zip(ids, _plain([texts[i] for i in ids]), strict=True))
    for r in P.op9_pii(spark, sf).collect():
        want, spans = plain[r.doc_id]
        assert r.spans == ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, e, k in spans)
        written = ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, e, k in want)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for *_, k in want) for j in range(4)]
        assert set(written.split(",")) - {""} <= set(r.spans.split(","))
