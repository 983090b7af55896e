import random
import re

from pyspark.sql import functions as F

from pagelens.llm import pii


def brute(t):
    """The base rules as written, without any short cut."""
    t = t or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if k % 2 == 0 else (2 * x if 2 * x < 10 else 2 * x - 9) for k, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0])))


def test_base_spans_against_brute_force():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", "x-y", ".", "_", "%", "1", "25", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (386) 555-3733", " ", "-", "+", "(", "é", "\n", "mail", "@a.b_c@d.e", "0", "999999999999"]
    for _ in range(20000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [s[:3] for s in pii.find_pii(t) if s[0] in pii.BASE] == brute(t), t


def test_added_kinds_and_context():
    kinds = lambda t: [s[0] for s in pii.find_pii(t)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32.") == ["iban"]
    assert "iban" not in kinds("IBAN GB82 WEST 1234 5698 7654 33.")
    assert kinds("my ssn is 123-45-6789") == ["ssn"] and kinds("code 123-45-6789") == []
    near, far = pii.find_pii("call +1 386 555 3733")[0][3], pii.find_pii("code +1 386 555 3733")[0][3]
    assert near > far


def test_long_hostile_texts_are_linear():
    for t in ("a" * 300_000 + "@", "1" * 300_000 + ".", "+1" + " " * 300_000, "a@" * 50_000, "1." * 100_000):
        pii.find_pii(t)


def test_operator_edges(spark):
    df = spark.createDataFrame([(1, "x a@b.co"), (2, None), (3, ""), (None, "a@b.co"), (1, "x a@b.co")], "doc_id long, text string").withColumn("spans", F.lit(1))
    got = sorted((r["doc_id"] or 0, len(r["spans"]), str(r["redacted"])) for r in pii.scan_pii(df, with_text=True).collect())
    assert got == [(0, 1, "[EMAIL]"), (1, 1, "x [EMAIL]"), (1, 1, "x [EMAIL]"), (2, 0, "None"), (3, 0, "")]
    assert pii.scan_pii(df.limit(0)).count() == 0
