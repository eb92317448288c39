"""Base spans against plain regular expressions, and terms on a corpus made for it."""

import hashlib
import math
import random
import re
from collections import Counter

import xxhash

from paperloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def ok(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {
        "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")),
        "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15,
    }[kind]


def spans(text):
    found = [(m.start(), list(PLAIN).index(k), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if ok(k, m[0])]
    return [(list(PLAIN)[k], a, b) for a, k, b in sorted(found)]


def made(seed):
    rnd = random.Random(seed)
    parts = ["a.b@c.de", "x@y.z_q@w.v", "@", "é", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "79927398713000", "+1 (555) 555-3296",
             "+1", "+12", "++1 2 3 4 5 6 7 8 9 0", "word", " ", "\n", "12", "-", "a@b", "a@b.", "a@b.c.", "5500005555555559", "0" * 14, "𝔘"]
    return "".join(rnd.choice(parts) + rnd.choice(["", " ", " "]) for _ in range(rnd.randrange(60)))


def test_base_equals_plain_patterns(spark):
    rows = [(i, made(i)) for i in range(400)] + [(1000, None), (1001, ""), (1002, "a" * 200_000), (1003, "1" * 100_000), (1003, "1" * 100_000), (1004, "a@" + "b." * 50_000 + "c"), (None, "q@w.er")]
    got = pii.counts(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    want = []
    for i, t in rows:
        s = spans(t) if not (t and len(t) > 90_000) else ([("email", 0, len(t))] if "@" in t else [])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        want.append((i, *[sum(x[0] == k for x in s) for k in PLAIN], hashlib.sha256(line.encode()).hexdigest(), line))
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    assert sorted((tuple(r)[:-2] for r in got), key=key) == sorted((w[:-1] for w in want), key=key)
    every = {(r["doc_id"], x) for r in got for x in r["spans"].split(",") if x}
    assert {(w[0], x) for w in want for x in w[-1].split(",") if x} <= every  # terms may be added


def test_terms_that_reveal(spark):
    rnd = random.Random(3)
    plain = [f"w{i}" for i in range(300)]
    line = lambda: " ".join(rnd.choices(plain, k=25))
    rows = [(i, f"{line()} Zanzibarian {rnd.choice(plain)} boss@corp.example.com {line()}") for i in range(6)]
    rows += [(10 + i, f"{line()} {rnd.choice(plain)} other{i}@corp.example.com {line()}") for i in range(6)] + [(100 + i, line()) for i in range(60)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["spans"] for r in pii.counts(found).collect()}
    for i, t in rows[:6]:
        assert f"drop:{t.index('Zanzibarian')}:{t.index('Zanzibarian') + 11}" in got[i]
    assert all("drop" not in got[i] and "term" not in got[i] for i, _ in rows[6:])
    clean = {r["doc_id"]: r["text"] for r in found.select("doc_id", pii.sanitised().alias("text")).where("text IS NOT NULL").collect()}
    assert "Zanzibarian" not in clean[0] and "[EMAIL]" in clean[0] and "@" not in clean[0]


def test_copies_do_not_hide_a_term(spark):
    rnd = random.Random(4)
    line = lambda: " ".join(f"w{rnd.randrange(300)}" for _ in range(25))
    texts = [f"{line()} Zanzibarian w{i} boss@corp.example.com {line()}" for i in range(4)]
    rows = [(10 * i + k, t) for i, t in enumerate(texts) for k in range(8)] + [(100 + i, line()) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["term"]: r["disclosure"] for r in pii.revealing(docs, pii.base(docs), pii.Thresholds(support=3)).collect()}
    assert abs(got["zanzibarian"] - 1.0) < 1e-9
    # Copies of two windows are no evidence.
    few = docs.where("doc_id < 20 OR doc_id >= 100")
    assert pii.revealing(few, pii.base(few), pii.Thresholds(support=3)).count() == 0


def plain_disclosures(rows, t):
    """form: disclosure by entity, from the definitions."""
    strip = lambda w: re.sub(r"^[^\w]+|[^\w]+$", "", w.lower())
    forms = lambda w: [w, *(w[:n] + "*" for n in pii.FORMS if len(w) > n)]
    signed = lambda x: (h := xxhash.xxh64_intdigest(x.encode(), seed=42)) - (h >> 63 << 64)
    sketch = lambda w: (min(map(signed, w)), min(signed("*" + x) for x in w))
    around, total, n_term = {}, sum(len(x) for _, x in rows), Counter()
    for _, text in rows:
        n_term.update(f for w in text.split() if strip(w) for f in forms(strip(w)))
        for k, a, b in spans(text):
            left = text[max(0, a - t.window) : a]
            left = re.sub(r"^\S+", "", left) if a > t.window else left
            words = (left + " " + re.sub(r"\S+$", "", text[b : b + t.window])).split()
            around.setdefault(f"{pii.KINDS.index(k)}:{text[a:b].lower()}", []).append([strip(w) for w in words if strip(w)])
    out = {}
    for e, wins in around.items():
        rate = len(wins) / total
        for f in {f for w in wins for x in w for f in forms(x)}:
            if len({sketch(w) for w in wins if any(f in forms(x) for x in w)}) >= t.support:
                p = min(1.0, sum(f in forms(x) for w in wins for x in w) / n_term[f])
                out[e, f] = math.log2(p / rate) / -math.log2(rate)
    return out


def test_disclosures_equal_their_definition(spark):
    rnd = random.Random(7)
    line = lambda: " ".join(rnd.choice("abc") + rnd.choice(["x", "yyyyyy", "zzz,", "(q)"]) + str(rnd.randrange(9)) for _ in range(12))
    rows = [(i, f"{line()} Melissa{rnd.choice(['', ',', '.'])} {rnd.choice('abc')}q {rnd.choice(['p@q.rs', 't@u.vw', '1.2.3.4'])} {line()}") for i in range(40)] + [(100 + i, f"{line()} melinda {line()}") for i in range(400)]
    docs, t = spark.createDataFrame(rows, "doc_id long, text string"), pii.Thresholds()
    got = {(r["entity"], r["form"]): r["disclosure"] for r in pii.disclosures(docs, pii.base(docs), t).collect()}
    want = plain_disclosures(rows, t)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # "melissa" is only beside entities, its general form "meli*" is also in 400 other texts.
    told = {(r["entity"], r["term"]): r["to"] for r in pii.revealing(docs, pii.base(docs), pii.Thresholds(generalise=0.7)).collect()}
    near = {e for e, f in want if f == "melissa" and want[e, f] >= 0.7}
    assert near
    for e in near:
        assert told[e, "melissa"] == ("meli*" if want[e, "meli*"] < 0.7 else "me*" if want[e, "me*"] < 0.7 else None)
    found = pii.find(docs, pii.Thresholds(generalise=0.7))
    texts = {r["doc_id"]: r["text"] for r in found.select("doc_id", pii.sanitised().alias("text")).collect()}
    assert "[EMAIL]" in "".join(x or "" for x in texts.values()) and texts[100] is None and "meli" in "".join(x or "" for x in texts.values())


def test_many_matches_and_clashing_columns(spark):
    many = "x 1.2.3.4 " * 3000
    df = spark.createDataFrame([(1, many, "s", 3)], "doc_id long, text string, spans string, n_email int")
    r = pii.counts(pii.find(df)).first()
    assert r["n_ip"] == 3000 and r["spans"].split(",")[2999] == f"ip:{2999 * 10 + 2}:{2999 * 10 + 9}" and r["sanitised"] == "x [IP] " * 3000


def test_empty_table(spark):
    assert pii.counts(pii.find(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
