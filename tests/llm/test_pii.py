import hashlib
import random
import re

import pytest

from stintworks.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


TRICKY = [
    "a@b.c_d@e.f a@b.c@d.e .x@y.z -a@b-c.d.e. a@b a@@b.c a%+@b..c", "1.2.3.4.5.6.7.8 1.2.3.256 01.002.0003.00255 1.2.3 999.1.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111 1111 1111 1112 0000000000000000 1 2 3 4", "+1 (017) 555-7713 +12 +1((((( +49.30.1234567- ++1 2345678",
    "🙂🙂 é john@x.org 🙂 +33 1 23 45 67 89 日本 10.0.0.1", "mail: Maria Lopez (at) here, call +1 212 555 0000, ssn 123-45-6789 000-12-3456",
    "Maria Garcia and John Smith of James Town", "DE89 3704 0044 0532 0130 00 is my iban", "joe (at) mail (dot) com", "5500005555555559 6011 0009 9013 9424", "", None,
]


def noise(seed, n):
    rng = random.Random(seed)
    letters = "ab1.@+- 234567890()_%\n🙂é"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def test_base_like_brute_force(make_docs, edge_rows):
    texts = TRICKY + noise(1, 400) + [r[1] for r in edge_rows]
    out = {r["doc_id"]: r for r in pii.summarize(pii.find_pii(make_docs(list(enumerate(texts))))).collect()}
    assert len(out) == len(texts)
    for i, text in enumerate(texts):
        spans = base_spans(text)
        told = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        r = out[i]
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE], text
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest(), text
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in pii.BASE] == (told.split(",") if told else [])
        order = [pii.KINDS.index(s.split(":")[0]) for s in r["spans"].split(",") if s]
        assert order == sorted(order)


def test_long_runs_take_linear_time(make_docs):
    """A plain search would start again at every character of such runs."""
    n = 300_000
    rows = [(1, "a" * n), (2, "1" * n), (3, "a." * (n // 2) + "@"), (4, "a@" + "b." * (n // 2) + "c"), (5, "+1" + "(" * n), (6, "1 " * (n // 2)), (7, "1." * (n // 2)), (8, "-" * n)]
    out = {r["doc_id"]: r for r in pii.summarize(pii.find_pii(make_docs(rows))).collect()}
    assert out[4]["n_email"] == 1 and out[7]["n_ip"] == len(base_spans(rows[6][1])) and out[1]["spans"] == ""


def test_further_kinds_are_found_where_the_evidence_agrees(make_docs):
    rng = random.Random(2)
    rows = [(i, f"Dear {rng.choice(pii.GIVEN_NAMES)} Miller, your ssn: {rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)} is safe") for i in range(60)]
    rows += [(100 + i, f"part{rng.randint(100, 999)}-00-{rng.randint(1000, 9999)}x") for i in range(60)]
    out = {r["doc_id"]: r["spans"] for r in pii.summarize(pii.find_pii(make_docs(rows))).collect()}
    assert all("ssn:" in out[i] and "person:" in out[i] for i in range(60)) and not any("ssn:" in out[100 + i] for i in range(60))


def test_estimation_finds_reliable_labelers():
    """Votes drawn from known reliabilities: the posterior orders the patterns by their true odds."""
    rng = random.Random(3)
    right = [0.95, 0.9, 0.6, 0.85, 0.55]
    counts, truth = {}, {}
    for _ in range(20000):
        y = rng.random() < 0.4
        p = "".join("2" if (rng.random() < q) == y else "0" for q in right)
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, []).append(y)
    chance = pii.estimate({"k": counts})["k"]
    error = [abs(chance[p] - sum(ys) / len(ys)) for p, ys in truth.items() if len(ys) > 100]
    assert max(error) < 0.15


def test_empty_table(make_docs):
    assert pii.summarize(pii.find_pii(make_docs([]))).collect() == []
    assert [r["spans"] for r in pii.summarize(pii.find_pii(make_docs([(1, None), (2, "words")]))).collect()] == ["", ""]


def test_main_path_has_no_python(make_docs, edge_rows):
    plan = pii.voted(make_docs(edge_rows))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("kind", pii.BASE)
def test_base_patterns_find_what_the_plain_ones_find(spark, kind):
    plain = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}[kind]
    texts = [t for t in TRICKY if t] + noise(7, 500)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    from pyspark.sql import functions as F

    for r in rows.select("i", F.regexp_extract_all("t", F.lit(pii.PATTERNS[kind]), F.lit(0)).alias("m")).collect():
        assert r["m"] == [m[0] for m in plain.finditer(texts[r["i"]])], texts[r["i"]]


def test_texts_with_very_many_matches(make_docs):
    """Places stay right across the lists that matches are gathered in, and the work does not grow with their square."""
    rng = random.Random(8)
    rows = []
    for doc_id, count in enumerate([255, 256, 257, 513, 50_000]):
        parts, spans, at = [], [], 0
        for k in range(count):
            gap, mail = "é" * rng.randrange(3) + " ", f"a{k}@host.example"
            spans.append(("email", at + len(gap), at + len(gap) + len(mail)))
            parts += [gap, mail]
            at += len(gap) + len(mail)
        rows.append((doc_id, "".join(parts), spans))
    found = {r["doc_id"]: r["spans"] for r in pii.find_pii(make_docs([(i, t) for i, t, _ in rows])).collect()}
    for doc_id, _, spans in rows:
        assert [(s["kind"], s["start"], s["end"]) for s in found[doc_id] if s["kind"] == "email"] == spans
