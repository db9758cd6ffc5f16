import hashlib
import random
import re

from conftest import odd_rows

from concord.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: [int(c) for c in m.group() if c in "0123456789"]

    def luhn(d):
        odd, even = d[::-1][::2], d[::-1][1::2]
        return (sum(odd) + sum(sum(divmod(2 * x, 10)) for x in even)) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return out


def texts():
    rng = random.Random(1)
    parts = ["a", "b.c", "@", "@x.y", "@x", ".", "-", "+", "+1", "12", "255", "256", "007", ".1.2.3", " ", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1112", "é", "\n", "٣", "%"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(6000)]


def test_base_kinds():
    for text in texts():
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == plain(text), text


def test_long_runs_are_linear():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "a@" * 100_000, "=" * 200_000):
        pii.candidates(text, pii.base_spans(text))


def code_of(kind, *bands):
    code = kind
    for band, size in zip([*bands, *[0] * len(pii.BANDS)], pii.BANDS, strict=False):
        code = code * size + band
    return code


def test_patterns_are_read_back():
    rng = random.Random(3)
    for _ in range(200):
        kind, bands = rng.randrange(len(pii.KINDS)), [rng.randrange(n) for n in pii.BANDS]
        assert pii.split(code_of(kind, *bands)) == (kind, bands)


def test_reliabilities_find_the_better_labelers():
    rng = random.Random(2)
    counts = {}
    for _ in range(5000):
        true = rng.random() < 0.4
        v = [int(true if rng.random() < good else not true) if rng.random() < 0.9 else 2 for good in (0.95, 0.9, 0.6, 0.9)]
        code = code_of(4, *v)
        counts[code] = counts.get(code, 0) + 1
    p, rates = pii.reliabilities(counts)
    assert rates[1, 4, 0, 1] > 0.8 and rates[1, 4, 2, 1] < 0.7
    assert p[code_of(4, 1, 1, 0, 1)] > 0.9 and p[code_of(4, 0, 0, 1, 0)] < 0.1


def planted(n=400, seed=4):
    """Texts, each with its personal data of the added kinds, among others that only look like it."""
    rng = random.Random(seed)
    hexed = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    mixed = lambda k: "".join(rng.choices("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=k))
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda: "".join(rng.choices("aeioubcdlmnrst", k=rng.randint(2, 8)))
    ssn = lambda: f"{rng.randint(101, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
    phone = lambda: f"({rng.randint(212, 299)}) {rng.randint(222, 999)}-{rng.randint(1000, 9999)}"
    given, family = ["Maria", "James", "Anna", "Thomas"], ["Miller", "Garcia", "Novak", "Laurent"]
    true = {
        "secret": [lambda: ("password=", hexed(18)), lambda: ('token = "', hexed(40)), lambda: ("api_key: ", mixed(32)), lambda: ("", "AKIA" + "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZ234567", k=16)))],
        "ssn": [lambda: ("SSN ", ssn()), lambda: ("social security number ", ssn()), lambda: ("", ssn())],
        "name": [lambda: ("My name is ", f"{rng.choice(given)} {rng.choice(family)}"), lambda: ("Signed by ", f"{rng.choice(given)} {rng.choice(family)}")],
        "local_phone": [lambda: ("call ", phone()), lambda: ("", phone())],
    }
    decoys = [lambda: f"commit: {hexed(40)}", lambda: f"sha256={hexed(64)}", lambda: "see the-long-name-of-some-file-2024", lambda: f"part 000-{digits(2)}-{digits(4)}", lambda: f"order 987-65-{digits(4)}", lambda: f"item 000.{digits(3)}-{digits(4)}", lambda: "/usr/local/share/some/where/12"]
    rows = []
    for i in range(n):
        before, after = " ".join(word() for _ in range(rng.randint(3, 12))) + " ", " " + " ".join(word() for _ in range(4))
        if i % 2:
            rows.append((before + rng.choice(decoys)() + after, set()))
        else:
            kind = list(true)[i // 2 % 4]
            lead, own = rng.choice(true[kind])()
            at = len(before) + len(lead)
            rows.append((before + lead + own + ('"' if lead.endswith('"') else "") + after, {f"{kind}:{at}:{at + len(own)}"}))
    return rows


def test_recall_and_precision_on_planted_spans(make):
    rows = planted()
    got = {r.doc_id: r for r in pii.private(make([(i, t) for i, (t, _) in enumerate(rows)])).collect()}
    for kind in pii.MORE:
        own = [i for i, (_, spans) in enumerate(rows) if any(s.startswith(kind) for s in spans)]
        assert len(own) == 50 and sum(rows[i][1] <= set(got[i].spans.split(",")) for i in own) >= 0.9 * len(own), kind
    assert all(got[i].private == bool(got[i].spans) for i in got)
    clean = [i for i, (_, spans) in enumerate(rows) if not spans]
    assert sum(got[i].private for i in clean) <= 0.05 * len(clean)


def test_base_spans_are_no_evidence(make):
    text = "a token = \"9233a8ecf7c5b09fe5949719b6b82bc439e9329b\" here"
    alone = pii.fit(pii.spans(make([(1, text)])))
    assert alone and alone == pii.fit(pii.spans(make([(1, text), *((i, "mail a@b.com and 4111 1111 1111 1111") for i in range(2, 40))])))


def test_private(make):
    rows = odd_rows() + [(100 + i, t) for i, t in enumerate(texts()[:200])]
    secret = 'token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"'
    rows += [(1000 + i, f"text {secret} and mail a{i}@b.com") for i in range(20)] + [(1100 + i, "see hash deadbeefdeadbeefdead1 there") for i in range(3)]
    got = pii.private(make(rows)).collect()
    expected = []
    for i, t in rows:
        found = plain(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        expected.append((i, *(sum(f[0] == k for f in found) for k in pii.BASE), hashlib.sha256(joined.encode()).hexdigest(), joined))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((e[:-1] for e in expected), key=str)
    assert all(r.private == bool(r.spans) and r.n_added == len([x for x in r.spans.split(",") if x]) - r.n_email - r.n_ip - r.n_card - r.n_phone for r in got)
    base = {(e[0], e[-2]): e[-1] for e in expected}
    for r in got:
        assert set(filter(None, base[r.doc_id, r.base_sha256].split(","))) <= set(r.spans.split(","))
        if 1000 <= (r.doc_id or 0) < 1020:
            assert "secret:14:54" in r.spans.split(",")


def test_empty_table(make):
    assert pii.private(make([])).collect() == []


def test_long_secrets_are_candidates():
    for n in (200, 201, 5000, 1_000_000):
        own = ("aB3x" * n)[:n]
        assert pii.candidates(f"token: {own} end", []) == [(4, 7, 7 + n)]
