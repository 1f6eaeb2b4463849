import hashlib
import re

import duckdb
import pytest

from tideline.llm import pii
from tideline.llm.pii import find_pii, op12_pii

# The contract's patterns, as they stand there.
BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
LENGTHS = dict((p[:2], int(p[2:])) for p in pii.IBAN_LENGTHS.split())


def luhn(number):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(number))]
    return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0


def only_digits(m):
    return re.sub(r"[^0-9]", "", m)


def base_ok(kind, m):
    n = only_digits(m)
    return {"email": True, "ip": all(int(p or 256) <= 255 for p in m.split(".")) if kind == "ip" else False, "card": 16 <= len(n) <= 19 and luhn(n), "phone": 8 <= len(n) <= 15}[kind]


def context(text, all_found, i):
    start, end = all_found[i].span()
    left, right = all_found[i - 1].end() if i else 0, all_found[i + 1].start() if i + 1 < len(all_found) else len(text)
    return text[max(left, start - pii.BEFORE) : start], text[end : min(right, end + pii.AFTER)]


def has(words, near):
    return re.search(f"(^|[^a-z])({words})([^a-z]|$)", re.sub("[A-Z]", lambda m: m.group().lower(), near)) is not None


def total(kind, score, before, after):
    return min(100, max(0, score + 30 * has(pii.FOR[kind], before + " " + after) - 30 * has(pii.AGAINST[kind], before)))


def beside(before, after, left, right):
    return bool(re.search(f"({left})$", before)) or bool(re.match(right, after))


def brute(text):
    """(base spans, all spans): (ordinal, start, end, kind, score, base)."""
    base, added = [], []
    for k, (kind, pattern) in enumerate(BASE):
        found = list(re.finditer(pattern, text))
        for i, m in enumerate(found):
            if base_ok(kind, m.group()):
                base.append((k, m.start(), m.end(), kind, total(kind, pii.BASE_SCORE[kind], *context(text, found, i)), True))

    def add(pattern, decide):
        found = list(re.finditer(pattern, text))
        for i, m in enumerate(found):
            before, after = context(text, found, i)
            for kind, score, end in decide(m.group(), before, after):
                points = total(kind, score, before, after)
                if points >= pii.LEAST_SCORE:
                    added.append((m.start(), -(m.start() + end), pii.KINDS.index(kind), kind, points))

    word = "[A-Za-z0-9]"
    add(pii.SPELT, lambda m, b, a: [("email", 60, len(m))])

    def number(m, b, a):
        n = only_digits(m)
        if m.startswith("+"):
            return [("phone", 60, len(m))] if 8 <= len(n) <= 15 and not beside(b, a, "[0-9+]", "[0-9]") else []
        return [("card", 70 if len(n) > 15 else 30, len(m))] if 13 <= len(n) <= 19 and luhn(n) and not beside(b, a, word, word) else []

    add(pii.NUMBER, number)
    add(pii.LOCAL, lambda m, b, a: [] if beside(b, a, "[A-Za-z0-9+.-]", "[A-Za-z0-9-]") else [("phone", 30, len(m))])

    def account(m, b, a):
        size = LENGTHS.get(m[:2], 99)
        end = size + (-(-size // 4) - 1 if " " in m else 0)
        taken, rest = m[:end], m[end:] + a
        plain = taken.replace(" ", "")
        if len(taken) != end or len(plain) != size or re.match(word, rest) or re.search(word + "$", b):
            return []
        return [("iban", 80, end)] if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else []

    add(pii.IBAN, account)
    add(pii.SSN, lambda m, b, a: [] if beside(b, a, "[A-Za-z0-9-]", "[A-Za-z0-9-]") or re.match("000|666|9", m) or m[4:6] == "00" or m.endswith("0000") else [("ssn", 30, len(m))])
    kept, reached = list(base), 0
    for start, last, k, kind, points in sorted(added):
        if start >= reached and not any(s < -last and start < e for _, s, e, *_ in base):
            kept.append((k, start, -last, kind, points, False))
        reached = max(reached, -last)
    return sorted(base), sorted(kept)


PLANTED = [
    "call me at (415) 555-2671 or tel 415-555-2671; part 415-555-2671", "mail bob [at] mail [dot] com or a.b@c.d-e.org.", "IBAN DE89 3704 0044 0532 0130 00 AND GB82WEST12345698765432.",
    "IBAN DE89 3704 0044 0532 0130 01, xGB82WEST12345698765432, GB82WEST123456987654321, ZZ82WEST12345698765432", "+1 (988) 555-2485 4041894974608795", "+1 (988) 555-2485 4111 1111 1111 1111 x", "ssn 123-45-6789 part 123-45-6780 000-12-3456",
    "Amex 3782 822463 10005 x, order 378282246310005 card 378282246310005", "a@b.c_d@e.f x@y g@h.i", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.003.0255 version 1.2.3.4", "4111-1111-1111-1111 4111 1111 1111 1112 41111111111111111111", "+1234567 +12345678 ++49 30 1234567",
    "é€😀 x@y.zz 😀 +49 30 12345678 é", "1" * 40 + " " + "4" * 16, "a@b.co " * 70, "4041894974608795 4041894974608795 4041894974608795", "", "+1 2 +", "DE89 3704 0044 0532 0130 00", "10.0.0.1 " * 40 + "call (415) 555-2671",
]


def check(rows, found):
    for text, spans in zip(rows, found, strict=True):
        want = brute(text)[1]
        got = [(s.ord, s.start, s.end, s.kind, s.score, s.base) for s in spans]
        assert got == want, (text[:200], got[:5], want[:5])


def test_planted_spans_match_brute_force(spark):
    held = spark.createDataFrame(list(enumerate(PLANTED)), "doc_id long, text string")
    check(PLANTED, [r.spans for r in find_pii(held).orderBy("doc_id").collect()])


def test_matches_brute_force(spark, docs, odd, none):
    for df in (docs, odd):
        got = sorted(((str(r.doc_id), [tuple(s) for s in r.spans]) for r in find_pii(df).collect()), key=str)
        assert got == sorted(((str(r.doc_id), [(k, s, e, *more) for k, s, e, *more in brute(r.text or "")[1]]) for r in df.select("doc_id", "text").collect()), key=str)
    assert find_pii(none).count() == 0


def test_query_lists_counts_digest_and_spans(spark, small, texts):
    for r in op12_pii(spark, small).collect():
        base, spans = brute(texts[r.doc_id])
        joined = ",".join(f"{kind}:{s}:{e}" for _, s, e, kind, *_ in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.spans == ",".join(f"{kind}:{s}:{e}" for _, s, e, kind, *_ in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == kind for x in base) for kind in pii.KINDS[:4]]


@pytest.mark.parametrize("text", ["x" * 300_000, "1" * 300_000, "1 " * 150_000, "+1" * 150_000, "a@" * 150_000, "1." * 150_000, "AB12" * 75_000])
def test_long_runs_take_linear_time(spark, text):
    assert len(find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()) == 1


def test_the_main_path_has_no_python(spark, small):
    plan = op12_pii(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_sql_matches_brute_force():
    with duckdb.connect() as con:
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", [*enumerate(PLANTED), (1000, None)])
        got = {r[0]: r[-1] for r in con.execute(pii.SQL).fetchall()}
    assert got == {k: ",".join(f"{kind}:{s}:{e}" for _, s, e, kind, *_ in brute(text)[1]) for k, text in [*enumerate(PLANTED), (1000, "")]}


def test_query_matches_sql(spark, small):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
        assert sorted(con.execute(pii.SQL).fetchall()) == sorted(map(tuple, op12_pii(spark, small).collect()))
