"""Personal data by weak supervision.

Candidates are spans of a few shapes.  Labelers look at each: its format and check digits, gazetteers
(top-level domains, calling codes, card issuers, given names), and the words before it.  Each votes for
or against, or abstains.  Expectation-maximisation over the counts of vote patterns, which are taken over
all documents, estimates how reliable every labeler is and how likely each pattern means personal data.
These likelihoods are the labels of the final span classifier (logistic regression on shape and context
features, fitted on a bounded sample of candidates); it decides on every candidate.

The base kinds (email, ip, card, phone) are defined by pattern and check alone, so their spans always
stand.  The classifier adds spans of the other kinds (ssn, iban, ipv6, masked_email, name).

Null and empty texts have no spans.  Rows may repeat; each gets its own result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batch_of, documents, written

BASE = ("email", "ip", "card", "phone")
MORE = ("ssn", "iban", "ipv6", "masked_email", "name")
KINDS = BASE + MORE
#: Candidates on which the classifier is fitted, at most; those with the smallest hashes.
SAMPLE = 20_000

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IPV6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_MASKED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,64}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,64})+")
_NAME = re.compile(r"(?<!\w)(?:Mrs|Mr|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señora|Señor)\.? [A-ZÀ-Þ][a-zß-ÿ]+(?: [A-ZÀ-Þ][a-zß-ÿ]+)?")
_TITLES = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Madame", "Monsieur", "Señor")

TOP_DOMAINS = frozenset("com org net edu gov io co de fr es it nl uk us eu ch at be info biz example".split())
CALLING_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "420")
GIVEN_NAMES = frozenset("Anna Maria Peter Paul John Mary James Robert Linda David Susan Thomas Karl Hans Klaus Julia Laura Marie Jean Pierre Jose Juan Carlos Carmen Ana Luis Michael Sarah Emma Lukas".split())
FOR_WORDS = frozenset("mail email e-mail contact write reply tel phone telephone call mobile fax card visa mastercard credit ip host address addr server ssn social security iban account bank name signed dear born telefon kontakt karte konto téléphone appelez courriel carte compte teléfono correo tarjeta cuenta".split())
AGAINST_WORDS = frozenset("version order invoice isbn issn sku part serial section chapter figure page ratio total sum score number no nr id ticket build release".split())
LABELERS = ("format", "gazetteer", "context", "neighbours")


# ------------------------------------------------------------------ base spans


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their at signs."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        if at >= last:
            s = at
            while s > last and text[s - 1] in _LOCAL:
                s -= 1
            m = _EMAIL.match(text, s) if s < at else None
            if m:
                out.append(m.span())
                last = m.end()
        at = text.find("@", at + 1)
    return out


def _ip_ok(s: str) -> bool:
    parts = [p.lstrip("0") or "0" for p in s.split(".")]
    return all(len(p) <= 3 and int(p) <= 255 for p in parts)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _card_ok(s: str) -> bool:
    d = _digits(s)
    return 16 <= len(d) <= 19 and luhn(d)


def _phone_ok(s: str) -> bool:
    return 8 <= len(_digits(s)) <= 15


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ssn_ok(s: str) -> bool:
    return s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"


CHECKS = {"ip": _ip_ok, "card": _card_ok, "phone": _phone_ok, "iban": _iban_ok, "ssn": _ssn_ok}


def matches(text: str) -> list[tuple[str, int, int, bool]]:
    """Every candidate of every kind: (kind, start, end, whether its check holds)."""
    out = [("email", s, e, True) for s, e in emails(text)]

    def add(kind, pattern):
        check = CHECKS.get(kind)
        out.extend((kind, *m.span(), check is None or check(m.group())) for m in pattern.finditer(text))

    add("ip", _IP)
    add("card", _CARD)
    if "+" in text:
        add("phone", _PHONE)
    add("ssn", _SSN)
    add("iban", _IBAN)
    if text.count(":") >= 7:
        add("ipv6", _IPV6)
    if "(at)" in text or "[at]" in text:
        add("masked_email", _MASKED)
    if any(t in text for t in _TITLES):
        add("name", _NAME)
    return out


# ------------------------------------------------------------------ labelers and features


def _words_before(text: str, start: int) -> list[str]:
    return re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", text[max(0, start - 40) : start].lower())[-4:]


def votes(text: str, kind: str, start: int, end: int, ok: bool) -> list[int]:
    """1 for, -1 against, 0 abstains, by labeler."""
    span = text[start:end]
    gazetteer = 0
    if kind in ("email", "masked_email"):
        gazetteer = 1 if re.split(r"[.) \]]", span)[-1].lower() in TOP_DOMAINS else 0
    elif kind == "phone":
        gazetteer = 1 if _digits(span).startswith(CALLING_CODES) else -1
    elif kind == "card":
        gazetteer = 1 if span[0] in "3456" else -1
    elif kind == "ip":
        gazetteer = -1 if span.startswith(("0.", "127.", "255.")) else 0
    elif kind == "name":
        gazetteer = 1 if any(w in GIVEN_NAMES for w in span.split()) else 0
    before = _words_before(text, start)
    context = 1 if any(w in FOR_WORDS for w in before) else -1 if any(w in AGAINST_WORDS for w in before) else 0
    around = text[max(0, start - 1) : start] + text[end : end + 1]
    neighbours = -1 if any(c.isalnum() or c in "_/=#$%&*-" for c in around) else 1 if around.strip(" \n.,;:()\"'<>") == "" else 0
    return [1 if ok else -1, gazetteer, context, neighbours]


FEATURES = len(KINDS) + 12


def features(text: str, kind: str, start: int, end: int, ok: bool) -> list[float]:
    span = text[start:end]
    n = len(span)
    digits = sum("0" <= c <= "9" for c in span)
    before = _words_before(text, start)
    kinds = [float(kind == k) for k in KINDS]
    return kinds + [
        1.0,
        float(ok),
        min(n, 40) / 40,
        digits / n,
        sum(c.isupper() for c in span) / n,
        sum(not c.isalnum() for c in span) / n,
        len(set(span)) / n,
        float(any(w in FOR_WORDS for w in before)),
        float(any(w in AGAINST_WORDS for w in before)),
        float(start == 0 or text[start - 1].isspace()),
        float(end == len(text) or text[end] in " \n.,;:)"),
        float(digits == 0),
    ]


def fit_votes(patterns: dict[tuple[str, tuple[int, ...]], int], rounds: int = 50) -> dict:
    """Likelihood of personal data for each (kind, votes), by expectation-maximisation.

    Labelers are independent given the class.  Every kind has its own share of positives; reliabilities
    (the chance of each vote in each class) are common to all kinds.  Starts from the majority vote.
    """
    keys = list(patterns)
    if not keys:
        return {}
    count = np.array([patterns[k] for k in keys], float)
    vote = np.array([k[1] for k in keys]) + 1
    kind = np.array([KINDS.index(k[0]) for k in keys])
    p = 1 / (1 + np.exp(-(vote - 1).sum(axis=1)))
    for _ in range(rounds):
        share = np.array([(count * p)[kind == k].sum() + 1 for k in range(len(KINDS))]) / np.array([count[kind == k].sum() + 2 for k in range(len(KINDS))])
        log = [np.log(1 - share[kind]), np.log(share[kind])]
        for c, weight in enumerate((count * (1 - p), count * p)):
            for j in range(vote.shape[1]):
                table = np.bincount(vote[:, j], weights=weight, minlength=3) + 1.0
                if c:  # a labeler is never taken for its opposite
                    table[2] = max(table[2], table[0])
                else:
                    table[0] = max(table[0], table[2])
                log[c] = log[c] + np.log(table / table.sum())[vote[:, j]]
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -40, 40)))
    return dict(zip(keys, p))


def fit_classifier(x: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression with soft labels, by gradient steps on all rows."""
    w = np.zeros(FEATURES)
    if not len(x):
        return w
    for _ in range(rounds):
        w -= 2.0 * (x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -40, 40))) - y) / len(x) + ridge * w)
    return w


# ------------------------------------------------------------------ the operator


def find(docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """doc_id and spans (array of kind, start, end, base, score) of every row.

    Offsets are code points, ends exclusive.  ``sample`` bounds the candidates used for fitting.
    """
    return _map_spans(docs, sample, threshold, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean,score:double>>", _plain)


def digests(docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row."""
    return _map_spans(docs, sample, threshold, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", _digest)


def _plain(doc, spans: list[tuple]) -> dict:
    return {"doc_id": doc, "spans": [dict(zip(("kind", "start", "end", "base", "score"), s)) for s in spans]}


def _digest(doc, spans: list[tuple]) -> dict:
    base = [s for s in spans if s[3]]
    line = lambda some: ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in some)
    return {"doc_id": doc} | {f"n_{k}": sum(s[0] == k for s in base) for k in BASE} | {"base_sha256": hashlib.sha256(line(base).encode()).hexdigest(), "spans": line(spans)}


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and its candidates: kind, start, end, ok, votes, x."""
    rows = documents(docs)
    ddl = "doc_id long, found array<struct<kind:string,start:int,end:int,ok:boolean,votes:array<int>,x:array<double>>>"
    schema = rows.sparkSession.createDataFrame([], ddl).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                found = []
                for kind, s, e, ok in matches(text):
                    # short digit runs are nobody's card
                    if kind == "card" and not ok and e - s < 12:
                        continue
                    found.append({"kind": kind, "start": s, "end": e, "ok": ok, "votes": votes(text, kind, s, e, ok), "x": features(text, kind, s, e, ok)})
                out.append(found)
            for i in range(0, len(out), 2000):
                yield batch_of(schema, {"doc_id": batch.column(0).slice(i, 2000).to_pylist(), "found": out[i : i + 2000]})

    return rows.mapInArrow(scan, schema)


def _map_spans(docs: DataFrame, sample: int, threshold: float, ddl: str, make) -> DataFrame:
    found = written(candidates(docs), "candidates")
    each = found.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.*")
    # as many rows as there are vote patterns: kinds times three to the power of the labelers at most
    counted = each.groupBy("kind", "votes").count().collect()
    likely = fit_votes({(r["kind"], tuple(r.votes)): r["count"] for r in counted})
    order = [F.xxhash64("doc_id", "kind", "start", "end"), "doc_id", "kind", "start", "end", "votes", "x"]
    taken = each.orderBy(*order).limit(sample).select("kind", "votes", "x").collect()
    x = np.array([r.x for r in taken]).reshape(-1, FEATURES)
    weights = fit_classifier(x, np.array([likely[r["kind"], tuple(r.votes)] for r in taken])).tolist()
    schema = found.sparkSession.createDataFrame([], ddl).schema

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [make(d, _decided(cs, weights, threshold)) for d, cs in zip(docs_, lists)]
            if out:
                yield batch_of(schema, {n: [r[n] for r in out] for n in schema.names})

    return found.mapInArrow(decide, schema)


def _decided(found: list[dict], weights: list[float], threshold: float) -> list[tuple]:
    """Base spans that pass their check, and classified spans of other kinds that do not overlap them."""
    score = lambda c: 1 / (1 + math.exp(-max(-40.0, min(40.0, sum(a * b for a, b in zip(weights, c["x"]))))))
    base = [(c["kind"], c["start"], c["end"], True, score(c)) for c in found if c["kind"] in BASE and c["ok"]]
    added: list[tuple] = []
    for c in (c for c in found if c["kind"] in MORE and c["ok"]):
        if (p := score(c)) >= threshold and not any(s < c["end"] and c["start"] < e for _, s, e, *_ in base + added):
            added.append((c["kind"], c["start"], c["end"], False, p))
    return sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))
