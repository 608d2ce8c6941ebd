"""Personal data: base spans against the patterns themselves, and what the votes add."""

import hashlib
import random
import re

from corpusloom.llm import pii_votes

DDL = "doc_id long, text string, spans string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            s = m.group()
            d = re.sub("[^0-9]", "", s)
            if kind == "ip" and any(int(p) > 255 for p in s.split(".")):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            if kind == "card":
                tot = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1]))
                if not 16 <= len(d) <= 19 or tot % 10:
                    continue
            out.setdefault(kind, []).append(f"{kind}:{m.start()}:{m.end()}")
    return out


def texts():
    rng = random.Random(4)
    out = [None, "", "a@b.com.c@d.e", "x@@y.z x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.1.1", "é a.b+c@exa-mple.co.uk, +1 (743) 555-3824.", "4111 1111-1111 1111 x", "9" * 4000 + ".1.1.1"]
    out += ["".join(rng.choices("ab.@1 -+%(\n", k=300)) for _ in range(150)]
    out += ["".join(rng.choices("0123456789 -.+()", k=200)) for _ in range(100)]
    return out


def test_base_spans(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in pii_votes.digests(spark.createDataFrame(rows + rows[5:6], DDL)).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        want = brute(t or "")
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [len(want.get(k, [])) for k in PATTERNS], t
        line = ",".join(x for k in PATTERNS for x in want.get(k, []))
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), t
        assert set(line.split(",")) - {""} <= set(got[i].spans.split(","))


def test_votes_add_spans_and_leave_clean_texts(spark):
    good = ["Please call her, social security 219-09-9999, thanks. ", "Signed by Mr. Peter Miller today. ", "Bank account iban DE89 3704 0044 0532 0130 00. ", "write to anna (at) example (dot) com now. "]
    bad = "version 4.12 and the order 12-345 of the day, part 000-00-0000 was plain. "
    docs = [(i, good[i % 4] + "mail a%d@b.org, ip 10.1.2.%d. " % (i, i), "") for i in range(80)] + [(100 + i, bad, "") for i in range(40)]
    got = {r.doc_id: {s["kind"] for s in r.spans} for r in pii_votes.find(spark.createDataFrame(docs, DDL)).collect()}
    for i in range(80):
        assert ("ssn", "name", "iban", "masked_email")[i % 4] in got[i]
    assert all(not got[100 + i] for i in range(40))


def test_reliabilities():
    """Two good labelers and one that guesses."""
    rng = random.Random(0)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.4
        say = lambda acc: (1 if y else -1) if rng.random() < acc else (-1 if y else 1)
        key = ("name", (say(0.95), say(0.9), rng.choice([-1, 0, 1]), say(0.9)))
        counts[key] = counts.get(key, 0) + 1
    p = pii_votes.fit_votes(counts)
    assert p["name", (1, 1, -1, 1)] > 0.95 and p["name", (-1, -1, 1, -1)] < 0.05


def test_empty(spark):
    assert pii_votes.digests(spark.createDataFrame([], DDL)).count() == 0
