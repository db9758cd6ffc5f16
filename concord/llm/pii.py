"""Personal data by weak supervision.

Four base kinds (email, ip, card, phone) are found by their fixed rules and always stay. Further candidates (secrets, social security
numbers, names, local phone numbers) are put to four labelers, each of which sees something the others don't: the
layout of the candidate's own characters, a gazetteer (given names, names that secrets are assigned to and their issuers' prefixes, area codes and
numbers that are never given out), the words before it without the name it is assigned to, and a check of the characters' distribution.
Each votes yes, no, or abstains. Expectation-maximisation over the counts of all vote patterns of the corpus's candidates (a table whose size the
labelers bound, not the corpus) estimates each labeler's rates of yes and no, each kind's share of true ones, and so a probability for each pattern;
base spans are no evidence in it. On these probabilities, weighted by the counts, a logistic span classifier is fitted over votes, kind, length, digits,
capitals, entropy and the characters around the span. A candidate that reaches THRESHOLD is added; none overlaps a base span.

Two passes: the first writes a row for each document with its spans and candidates, the second reads only that.

Null and empty texts have no spans. Places are in code points. Rows repeat as they came; columns besides doc_id and text are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty, written

BASE = ("email", "ip", "card", "phone")
MORE = ("secret", "ssn", "name", "local_phone")
KINDS = BASE + MORE
THRESHOLD, CONTEXT = 0.5, 40
ROUNDS, STEPS = 100, 400

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

SECRET = re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+(?![A-Za-z0-9_/+=-])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+] )(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
NAME = re.compile(r"\b(?:[Mm]y name is|[Ss]igned by|[Cc]ontact|Mr\.?|Mrs\.?|Ms\.?|Dr\.?) ([A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20}){0,2})")

#: Given names; names that secrets are assigned to, and that other long values are; issuers' prefixes; area codes that aren't given out; words that announce personal data, and that speak against it.
GIVEN = frozenset(
    "james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen christopher lisa daniel nancy matthew betty anthony sandra mark ashley donald emily steven kimberly paul andrew donna joshua michelle "
    "kenneth carol kevin amanda brian melissa george deborah timothy stephanie ronald rebecca jason laura edward helen jeffrey sharon ryan cynthia jacob kathleen gary amy nicholas angela eric anna jonathan ruth peter maria jean marie pierre michel nathalie isabelle philippe sophie "
    "hans klaus jürgen wolfgang ursula monika petra sabine jose josé carmen juan ana luis antonio manuel francisco dolores pilar josefa rosa".split()
)
SECRET_NAMES = frozenset("token secret password passwd pwd passphrase key apikey api_key api-key access_key secret_key private_key auth authorization bearer credential credentials clave contraseña passwort schlüssel motdepasse".split())
OTHER_NAMES = frozenset("sha sha1 sha256 md5 hash checksum commit revision rev etag digest uuid guid id build version nonce integrity file path url".split())
PREFIXES = ("ghp_", "gho_", "ghs_", "github_pat_", "sk-", "sk_live_", "pk_live_", "AKIA", "ASIA", "AIza", "xoxb-", "xoxp-", "glpat-", "eyJ")
NO_AREA = frozenset("000 100 110 111 200 300 400 500 555 600 700 900 911 999".split())
CUES = re.compile(r"(?i)\b(?:login|log in|secrets?|credentials?|account|ssn|social|security|tel|phone|call|dial|fax|mobile|reach|name is|signed|contact|regards|sincerely|from|to|dear|author|employee|patient|customer)\b[^\w]*(?:\w+\W+){0,2}$")
AGAINST = re.compile(r"(?i)\b(?:isbn|order|invoice|version|commit|sha|md5|checksum|hash|figure|table|page|licen[cs]e|part|model|serial|item|street|saint|avenue|lake|mount)\b[^\w]*(?:\w+\W+){0,1}$")
ASSIGNED = re.compile(r"([\w-]{1,30})[\"'`]?[ \t]*(?:=>|:=|[=:])[ \t]*[\"'`]?$|\b(bearer|token|key|password)[ \t]+[\"'`]?$", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in BASE, start, end), sorted. Matches are leftmost and don't overlap within a kind; those that fail their check are dropped."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            floor = found.end()
            out.append((0, start, floor))
        at = text.find("@", max(at + 1, floor))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in (s.count(c) for c in set(s)))


#: Votes: 0 no, 1 yes, 2 abstains.
LABELERS = ("shape", "gazetteer", "context", "check")


TURN = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")

#: Prior counts of (no, yes, abstain) for false and true candidates: that labelers are better than chance, and a gazetteer's entry the best of them.
PRIOR = np.array([[[3, 1, 2], [6, 0.5, 4], [3, 1, 4], [4, 2, 1]], [[1, 3, 2], [0.2, 6, 4], [1, 3, 4], [1, 5, 1]]])


def _assigned(before: str) -> tuple[str, str]:
    """The name that what follows is assigned to, lower-cased ("" if none), and what stands before it."""
    m = ASSIGNED.search(before)
    return ((m[1] or m[2]).lower().rsplit(".", 1)[-1], before[: m.start()]) if m else ("", before)


def _context(before: str) -> int:
    return 0 if AGAINST.search(before) else 1 if CUES.search(before) else 2


def votes(kind: int, text: str, start: int, end: int) -> tuple[int, int, int, int]:
    name, own, before = KINDS[kind], text[start:end], text[max(0, start - CONTEXT) : start]
    shape = gazetteer = check = 2
    if name == "secret":
        known, before = _assigned(before)
        joined = [x for x in re.split(r"[-_/+.]", own.rstrip("=")) if x]
        shape = 0 if len(joined) > 2 and all(x.isalpha() or x.isdigit() for x in joined) else 1 if len(joined) == 1 and (re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", own) or re.search("[a-z]", own) and re.search("[A-Z]", own)) else 2
        gazetteer = 1 if own.startswith(PREFIXES) or known in SECRET_NAMES or known.rsplit("_", 1)[-1] in SECRET_NAMES else 2
        check = int(_entropy(own) >= 2.8 and len(TURN.findall(own)) >= 3)  # random characters turn from letters to digits and back often
    elif name == "ssn":
        shape = 0 if len(set(_digits(own))) == 1 or _digits(own) in ("123456789", "987654321") else 2
        gazetteer = int(own[:3] not in ("000", "666") and own[0] != "9" and own[4:6] != "00" and own[7:] != "0000")
        check = 1 if start == 0 or not text[start - 1].isalpha() else 0
    elif name == "name":
        parts = own.lower().split()
        gazetteer = 1 if parts[0] in GIVEN else 2
        shape = 1 if len(parts) >= 2 else 2
        check = int(all(re.search("[aeiouy]", p) and not re.search("[^aeiouy]{5}", p) for p in parts))
    else:
        digits = _digits(own)
        shape = 1 if own[0] == "(" or len(set(re.findall(r"[ .-]", own))) == 1 else 0
        gazetteer = 0 if digits[:3] in NO_AREA or digits[0] in "01" else 2
        check = int(digits[3] not in "01" and len(set(digits)) > 2)
    return shape, gazetteer, _context(before), check


#: Sizes of what a pattern is made of, after the kind: votes, and bands of length, digits, capitals, entropy, and the characters before and after.
BANDS = (3, 3, 3, 3, 5, 4, 3, 4, 4, 3)


def pattern(kind: int, text: str, start: int, end: int) -> int:
    """Kind, votes and bands as one number below len(KINDS) times the product of BANDS."""
    own, n = text[start:end], end - start
    before, after = text[start - 1 : start], text[end : end + 1]
    bands = (
        *votes(kind, text, start, end),
        min(4, max(0, n.bit_length() - 3)),
        min(3, 4 * len(_digits(own)) // n),
        min(2, 3 * sum(c.isupper() for c in own) // n),
        min(3, max(0, int(_entropy(own)) - 1)),
        0 if before in ("", " ", "\n", "\t") else 1 if before in "=:" else 2 if before in "\"'`(<" else 3,
        0 if after in ("", " ", "\n", "\t") else 1 if after in "\"'`)>,.;" else 2,
    )
    code = kind
    for band, size in zip(bands, BANDS, strict=True):
        code = code * size + band
    return code


def split(code: int) -> tuple[int, list[int]]:
    """Kind and bands of a pattern; the first bands are the votes."""
    out = []
    for size in reversed(BANDS):
        out.append(code % size)
        code //= size
    return code, out[::-1]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) of what isn't base and overlaps no base span. What is assigned to the name of a digest, a revision or an id is none."""
    found = []
    for m in SECRET.finditer(text):
        start = m.start() + m.group().rstrip("=").rfind("=") + 1  # without the name it is assigned to
        own = text[start : m.end()]
        if _assigned(text[max(0, start - CONTEXT) : start])[0] not in OTHER_NAMES and len(own) >= 16 and (any("0" <= c <= "9" for c in own) or own.startswith(PREFIXES)) and not own.isdigit():
            found.append((4, start, m.end()))
    found += [(5, m.start(), m.end()) for m in SSN.finditer(text)]
    found += [(6, m.start(1), m.end(1)) for m in NAME.finditer(text)]
    found += [(7, m.start(), m.end()) for m in LOCAL_PHONE.finditer(text)]
    taken = sorted([(a, b) for _, a, b in base])
    out = []
    starts = [a for a, _ in taken]
    for kind, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
        k = int(np.searchsorted(starts, b)) if taken else 0
        if not any(x < b and a < y for x, y in taken[max(0, k - 8) : k]) and not (out and out[-1][2] > a):
            out.append((kind, a, b))
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


SPANS = "array<struct<kind:int,start:int,end:int,pattern:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.int32())]))


def _found(batches):
    for batch in batches:
        base_rows, more_rows = [], []
        for text in batch["text"].to_pylist():
            base = base_spans(text)
            base_rows.append([{"kind": k, "start": a, "end": b} for k, a, b in sorted(base)])
            more_rows.append([{"kind": k, "start": a, "end": b, "pattern": pattern(k, text, a, b)} for k, a, b in candidates(text, base)])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(base_rows, _SPAN_TYPE), pa.array(more_rows, _SPAN_TYPE)], ["doc_id", "base", "more"])


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and more: spans, the latter with their patterns, as a table in the shared folder."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return written(rows.mapInArrow(_found, f"doc_id long, base {SPANS}, more {SPANS}"), "pii-spans")


def reliabilities(counts: dict[int, int], rounds: int = ROUNDS) -> tuple[dict[int, float], np.ndarray]:
    """Probability of each pattern, and each labeler's rates of (no, yes, abstain): classes (false, true) x kinds x labelers x 3. A labeler is as good as it is with a kind, and each kind has its own share of true ones."""
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    told = [split(c) for c in codes]
    kind = np.array([k for k, _ in told], int)
    v = np.array([x[: len(LABELERS)] for _, x in told], int).reshape(len(codes), len(LABELERS))
    one = np.eye(3)[v]  # patterns x labelers x 3
    rates = np.repeat((PRIOR / PRIOR.sum(axis=2, keepdims=True))[:, None], len(KINDS), axis=1)
    prior, p = np.full(len(codes), 0.5), np.full(len(codes), -1.0)
    for _ in range(rounds):
        logs = np.log([1 - prior, prior]) + np.einsum("ijk,cijk->ci", one, np.log(rates)[:, kind])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if not len(p) or np.abs(new - p).max() < 1e-9:
            break
        p = new
        prior = ((np.bincount(kind, p * n, len(KINDS)) + 1) / (np.bincount(kind, n, len(KINDS)) + 2))[kind]
        for c, weight in enumerate(((1 - p) * n, p * n)):
            for k in range(len(KINDS)):
                rates[c, k] = np.einsum("i,ijk->jk", weight * (kind == k), one) + PRIOR[c]
        rates /= rates.sum(axis=3, keepdims=True)
    return dict(zip(codes, np.maximum(p, 0.0).tolist(), strict=True)), rates


def _features(code: int) -> np.ndarray:
    kind, bands = split(code)
    return np.concatenate([[1.0], np.eye(len(KINDS))[kind], *(np.eye(size)[band] for band, size in zip(bands, BANDS, strict=True))])


def classifier(counts: dict[int, int], truth: dict[int, float], steps: int = STEPS) -> dict[int, float]:
    """Score of each pattern that occurs: logistic regression on soft labels, weighted by the logarithm of the counts so that no kind drowns the others."""
    codes = sorted(counts)
    if not codes:
        return {}
    x = np.array([_features(c) for c in codes])
    weight = np.log1p(np.array([counts[c] for c in codes], float))
    weight /= weight.sum()
    y, w = np.array([truth[c] for c in codes]), np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (weight * (p - y)) + 1e-3 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(codes, (1 / (1 + np.exp(-x @ w))).tolist(), strict=True))


def fit(found: DataFrame) -> dict[int, float]:
    """The score of each pattern of the corpus's candidates."""
    every = found.select(F.explode("more").alias("s")).groupBy("s.pattern").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["pattern"]: r["n"] for r in every.collect()}  # at most the number of patterns
    return classifier(counts, reliabilities(counts)[0])


def _told(batches, scores, threshold):
    for batch in batches:
        n: list[list[int]] = [[] for _ in BASE]
        sha, every, more_n = [], [], []
        for base, more in zip(batch["base"].to_pylist(), batch["more"].to_pylist(), strict=True):
            own = [(s["kind"], s["start"], s["end"]) for s in base]
            added = [(s["kind"], s["start"], s["end"]) for s in more if scores.get(s["pattern"], 0.0) >= threshold]
            for k, column in enumerate(n):
                column.append(sum(s[0] == k for s in own))
            sha.append(hashlib.sha256(_joined(own).encode()).hexdigest())
            every.append(_joined(own + added))
            more_n.append(len(added))
        names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added", "private"]
        private = pa.array([bool(x) for x in every], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.int64()) for c in n), pa.array(sha, pa.string()), pa.array(every, pa.string()), pa.array(more_n, pa.int64()), private], names)


def private(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added (spans that the method adds), private (there is any span)."""
    found = spans(docs)
    schema = f"doc_id long, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string, n_added long, private boolean"
    return found.mapInArrow(partial(_told, scores=fit(found), threshold=threshold), schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private(spark.read.parquet(f"{sf_dir}/documents.parquet"))
