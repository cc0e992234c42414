"""PII spans against the plain patterns, and the weak-supervision layer."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from seedgrow.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def written(df):
    return {
        r["doc_id"]: (r["b"], r["a"])
        for r in pii.detect(df).select(
            "doc_id", pii._written(F.col("base_spans")).alias("b"), pii._written(F.col("added_spans")).alias("a")).collect()
    }


def test_base_spans_match_the_plain_patterns(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("a1.2@-+ ()5%9_é𝒳:x4") for _ in range(rng.randint(0, 80))) for _ in range(800)]
    texts += [
        "4111 1111 1111 1111 and 4111-1111-1111-1112", "x@y.z_w@q.r..t@u.v", "1" * 30000, "+" + "1" * 9 + "(" * 20000,
        "a" * 30000 + "@", "1.2.3.4.5.6.7.8 256.1.1.1 00000000000000255.1.1.1", "é𝒳 me@x.org 10.0.0.1 +1 (476) 555-5473", "", None,
    ]
    got = written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {i: b for i, (b, _) in got.items()} == {i: brute(t) for i, t in enumerate(texts)}


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.op9_pii(spark, sf).collect():
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [
            sum(x.startswith(k) for x in want.split(",")) for k in ("email", "ip", "card", "phone")]


def test_loose_spans_with_support_are_added_and_never_overlap_base(spark):
    base = [f"contact: a{i}@site.com" for i in range(40)]
    loose = [f"contact: bob{i} [at] site [dot] com" for i in range(40)]
    none = [f"see {i} [at] noon.x" for i in range(40)]
    phones = [f"call +1 (415) 555-{i:04d}" for i in range(40)]
    d = spark.createDataFrame(list(enumerate(base + loose + none + phones)), "doc_id long, text string")
    got = written(d)
    assert all(got[i][1].startswith("email:9:") for i in range(40, 80))
    assert not any(got[i][1] for i in range(80, 160))  # (415) 555-... lies inside a base span


def test_em_prefers_agreement():
    counts = [(0, (1, 1, 1), 50), (0, (-1, 0, 0), 50), (0, (1, 1, -1), 30), (0, (-1, 1, 0), 5)]
    post = pii._em(counts)
    assert post[(0, (1, 1, 1))] > 0.9 > 0.1 > post[(0, (-1, 0, 0))]


def test_redaction_and_edge_cases(spark):
    rows = [(1, "a me@x.org b 10.0.0.1"), (1, "a me@x.org b 10.0.0.1"), (2, None), (3, ""), (None, "𝒳 +1 (476) 555-5473.")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base_spans", F.lit("clash"))
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in pii.redact(d).collect()), key=repr)
    assert got == sorted([(0, "𝒳 <PHONE>."), (1, "a <EMAIL> b <IP>"), (1, "a <EMAIL> b <IP>"), (2, None), (3, "")], key=repr)
    assert pii.detect(d.limit(0)).count() == 0


FOUND = [
    ("contact (415) 555-1234 today", "phone:8:22"), ("fax 415-555-1234", "phone:4:16"), ("phone 415 555 1234", "phone:6:18"),
    ("call 030 1234567", "phone:5:16"), ("call (030) 123 4567", "phone:5:19"), ("tel 01 23 45 67 89", "phone:4:18"),
    ("bob [AT] example [DOT] com", "email:0:26"), ("bob at example dot com", "email:0:22"), ("x bob(at)example.org", "email:2:20"),
    ("see 2001:db8::1 there", "ip:4:15"), ("host fe80::1ff:fe23:4567:890a", "ip:5:29"),
    ("2001:0db8:0000:0000:0000:ff00:0042:8329", "ip:0:39"), ("pay 3782 822463 10005 now", "card:4:21"),
]
NOT_FOUND = [
    "version 415-555-1234", "order no. 415-555-1234", "order 030 1234567", "invoice number 415 555 1234", "the sum 415 555 1234 of it",
    "on 2024-05-12 and 01.02.2024", "on 01/02/2024 10:20", "at 12:30:45 sharp", "std::vector and a::b", "a1::b2 in code",
    "meet me at noon", "look at the dot com boom", "point at the dot in it", "see 9 at noon dot x", "10:20::30", "card 3782 822463 10006",
    "1415 555 12345", "415 555 1234 567", "call 0123", "::1", "part 00:1b:44:11:3a:b7",
]


def test_loose_spans_are_accepted_and_look_alikes_rejected(spark):
    support = [f"contact: a{i}@site.com, call +1 (415) 555-{i:04d}, server 10.0.0.{i}, card 4111 1111 1111 1111" for i in range(60)]
    for more in (support, [], support + NOT_FOUND * 20, support * 20):
        texts = [t for t, _ in FOUND] + NOT_FOUND + more
        got = written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        # Among look-alikes of one shape, twenty times over, the shape may
        # outweigh a single vote; none of them is taken all the same.
        if len(more) != len(support) + 20 * len(NOT_FOUND):
            assert [got[i][1] for i in range(len(FOUND))] == [x for _, x in FOUND]
        assert [(t, got[len(FOUND) + i][1]) for i, t in enumerate(NOT_FOUND)] == [(t, "") for t in NOT_FOUND]
        assert {i: b for i, (b, _) in got.items()} == {i: brute(t) for i, t in enumerate(texts)}


def test_em_matches_a_plain_version():
    """Span by span, without counts."""
    rng = random.Random(5)
    counts = {}
    for _ in range(400):
        key = (rng.randrange(4), (rng.choice([1, -1]), rng.choice([0, 1, 1]), rng.choice([-1, 0, 1])))
        counts[key] = counts.get(key, 0) + 1
    spans = [key for key, n in counts.items() for _ in range(n)]
    prior, hit = [0.5] * 4, [[0.2, 0.8] for _ in range(3)]
    for _ in range(pii.EM_ROUNDS):
        p = []
        for k, v in spans:
            yes, no = prior[k], 1 - prior[k]
            for j, x in enumerate(v):
                if x >= 0:
                    yes *= hit[j][1] if x else 1 - hit[j][1]
                    no *= hit[j][0] if x else 1 - hit[j][0]
            p.append(yes / (yes + no))
        for k in range(4):
            mine = [q for q, (kk, _) in zip(p, spans) if kk == k]
            prior[k] = (sum(mine) + pii.SMOOTHING) / (len(mine) + 2 * pii.SMOOTHING)
        for j in range(3):
            for y in (0, 1):
                w = [(q if y else 1 - q, v[j]) for q, (_, v) in zip(p, spans) if v[j] >= 0]
                hit[j][y] = (sum(a for a, x in w if x) + (4 if y else 1) * pii.SMOOTHING) / (sum(a for a, _ in w) + 5 * pii.SMOOTHING)
    post, got = pii._estimate([(k, v, n) for (k, v), n in counts.items()])
    assert all(abs(post[s] - q) < 1e-9 for s, q in zip(spans, p))
    assert all(abs(got[j][y] - hit[j][y]) < 1e-9 for j in range(3) for y in (0, 1))
