import hashlib
import random
import re
import time

from polygate.llm import pii

SCHEMA = "doc_id long, text string, email string, hit string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def texts():
    rng = random.Random(8)
    bits = ["a@b.co", "x_y@z.w-v.org", "@", "a@b", "..@c.d", "1.2.3.4", "256.1.1.1", "001.02.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111111", "6011000990139424",
            "+49 (30) 1234-567", "+1", "+123456789012345678", "é", "日本", "😀", "\n", " ", ".", "-", "_", "9", "call", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "DE89370400440532013001", "m@n.o_p@q.r"]
    out = ["".join(rng.choices([*bits, " ", " "], k=rng.randrange(1, 14))) for _ in range(300)]
    return [*out, "", None, "a" * 50_000, "9" * 50_000, "a@" + "b." * 20_000 + "c", "1." * 30_000, "+1" + "(" * 40_000, "a@b.c " * 800, "ann@b.org, 10.0.0.1; 4111 1111 1111 1111 tel. +49 30 1234567 " * 3000, "1.2.3.4 " * 129, *bits]


def test_base_spans_match_plain_patterns(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(8)
    got = {r.doc_id: r for r in pii.digest(pii.find(df)).collect()}
    for i, t in rows:
        want = base(t)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (t or "")[:80]
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(x[0] == k for x in want) for k in PATTERNS]
        assert got[i].spans.startswith(said)


def test_time_is_linear_in_the_matches(spark):
    def took(n):
        df = spark.createDataFrame([(1, "mail ann.b@example.org or 10.1.2.3; " * n, None, None)], SCHEMA)
        began = time.monotonic()
        assert pii.digest(pii.find(df)).first().n_email == n
        return time.monotonic() - began

    took(5_000)
    assert took(40_000) < 4 * took(20_000) + 1  # the square would be more by far from here on
    assert "Python" not in pii.digest(pii.find(spark.createDataFrame([], SCHEMA)))._jdf.queryExecution().toString()


def test_context_reaches_back_over_matches(spark):
    rows = [(1, "write: a@b.co c@d.co " + "e@f.co " * 300 + "write g@h.co", None, None)]
    scores = pii.digest(pii.find(spark.createDataFrame(rows, SCHEMA))).first().scores.split(",")
    # the word stands within 40 code points of the first five addresses and of the last
    text = rows[0][1]
    want = ["1.0" if "write" in text[max(0, m.start() - pii.CONTEXT) : m.start()] else "0.9" for m in re.finditer(PATTERNS["email"], text)]
    assert scores == want and want.count("1.0") > 2


def test_added_kind_scores_and_empty(spark):
    rows = [(1, "my iban: GB82 WEST 1234 5698 7654 32.", None, None), (None, "DE89370400440532013001", None, None), (3, "order 4111 1111 1111 1111", None, None), (3, "visa 4111 1111 1111 1111", None, None)]
    got = [tuple(r)[-2:] for r in pii.digest(pii.find(spark.createDataFrame(rows, SCHEMA))).collect()]
    assert got == [("iban:9:36", "1.0"), ("", ""), ("card:6:25", "0.5"), ("card:5:24", "0.9")]
    assert pii.find(spark.createDataFrame([], SCHEMA)).collect() == []
