import hashlib

import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, frame
from tidewatch.llm import sketches as K


def digests(t):
    return {p for line in t.split("\n") for p in (line.replace(". ", ".\n") if len(line) > K.LONG_LINE else line).split("\n") if p}


def like(a, b):
    a, b = digests(a), digests(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64 - 2**63
    docs = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    out = []
    for k, (i, t) in enumerate(docs):
        after, half = docs[(k + 1) % len(docs)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(t, edited), 9), round(like(t, after), 9)))
    return sorted(out, key=str)


def test_awkward_documents(spark):
    rows = K.fingerprints(frame(spark)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows), key=str) == expected([(i, t) for i, t, _ in AWKWARD])
    same = {r.fingerprint for r in rows if r.n_chars == len(AWKWARD[0][1])}
    assert len(same) == 1


def test_one_row_and_none(spark):
    got = K.fingerprints(frame(spark, [(3, "q. w. e", "en")])).first()
    assert (got.near_next, got.edited_sha256) == (1.0, hashlib.sha256(b"q. wq. ").hexdigest())
    assert K.fingerprints(frame(spark, [])).isEmpty()


def hashed(spark, sets):
    return spark.createDataFrame(sets, "tp array<bigint>, tq array<bigint>").select(*[F.expr(f"transform({c}, x -> {K._checked('xxhash64(x)')})").alias(c) for c in ("tp", "tq")])


SETS = [(list(range(n)), list(range(m, m + k))) for n, m, k in ((0, 0, 0), (1, 0, 0), (5, 2, 5), (40, 7, 40), (300, 150, 300), (1000, 1000, 1000), (3, 0, 700), (500, 400, 20))]


def test_peeling_recovers_every_difference(spark):
    df = hashed(spark, SETS).select("*", F.expr(K.fingerprint("tp")).alias("fp"), F.expr(K.fingerprint("tq")).alias("fq"))
    for r in df.select("tp", "tq", F.expr(K.differing("fp", "fq")).alias("d"), F.expr(K.differing("fp", "fq", signed=True)).alias("e"), F.expr(K.count("fp")).alias("n")).collect():
        only = [sorted(set(x) - set(y)) for x, y in ((r.tp, r.tq), (r.tq, r.tp))]
        assert (r.d, r.n) == (len(only[0]) + len(only[1]), len(r.tp))
        assert sorted((x.k, x.n) for x in r.e) == sorted([(k, 1) for k in only[0]] + [(k, -1) for k in only[1]])


def test_too_small_a_sketch_gets_stuck(spark):
    df = hashed(spark, [(list(range(50)), [])])
    assert df.select(F.expr(K.peel(K.difference(K.sketch("tp", "4"), K.sketch("tq", "4")), "4")).alias("d")).first().d is None


def test_digests_that_no_sketch_tells_apart(spark):
    """Alike in all bits that place them: kept as a list, compared as sets, read back."""
    low, other = 12345, 12345 + (1 << 42)
    sets = [([low, other, 7], [low, 7]), ([low], [other]), ([other, 8, 9], [8, 9]), ([low, other], [other, low]), ([], [low, other])]
    df = spark.createDataFrame(sets, "tp array<bigint>, tq array<bigint>").select(*[F.expr(f"transform({c}, x -> {K._checked('x')})").alias(c) for c in ("tp", "tq")])
    df = df.select("tp", "tq", F.expr(K.fingerprint("tp")).alias("fp"), F.expr(K.fingerprint("tq")).alias("fq"))
    df = df.select("*", K.as_text("fp").alias("a"), K.as_text("fq").alias("b"), F.expr(K.differing("fp", "fq")).alias("d"), F.expr(K.differing("fp", "fq", signed=True)).alias("e"))
    for r in K.likeness_of_texts(df, "a", "b").collect():
        p, q = set(r.tp), set(r.tq)
        assert r.d == len(p ^ q) and {(x.k, x.n) for x in r.e} == {(k, 1) for k in p - q} | {(k, -1) for k in q - p}
        assert round(r.likeness, 9) == round(len(p & q) / len(p | q), 9)
        assert (r.a == r.b) == (p == q)


def test_text_form_is_read_back_without_loss(spark):
    df = hashed(spark, SETS).select(F.expr(K.fingerprint("tq")).alias("fq")).select("fq", K.as_text("fq").alias("t"))
    for r in df.select("fq", F.expr(K.from_text("t")).alias("again")).collect():
        assert [(b.c, b.s, sorted(b.h)) for b in r.fq] == [(b.c, b.s, sorted(b.h)) for b in r.again]
    large = spark.range(1).selectExpr("array(named_struct('c', 1, 's', array(named_struct('i', 0, 'n', 70000, 'k', -5L), named_struct('i', 1, 'n', -1, 'k', 0L), named_struct('i', 2, 'n', 0, 'k', 0L)))) AS b")
    r = large.select("b", K.as_text("b").alias("t")).select("b", F.expr(K.from_text("t")).alias("again")).first()
    assert r.b[0].s == r.again[0].s and r.again[0].h is None


def test_likeness_comes_from_the_two_fingerprints(spark):
    got = K.op3_lookup_sketch(spark, "/root/testdata/sf0.001").orderBy(F.desc("doc_id")).limit(60)
    rows = got.collect()
    texts = [(r.fingerprint, r.edited_fingerprint, rows[k + 1].fingerprint) for k, r in enumerate(rows[:-1])]
    df = spark.createDataFrame(texts, "td string, te string, tf string")
    again = K.likeness_of_texts(K.likeness_of_texts(df, "td", "te", "e"), "td", "tf", "n").select("e", "n").collect()
    assert [tuple(r) for r in again] == [(r.near_edited, r.near_next) for r in rows[:-1]]


def test_text_ids(spark):
    rows = K.fingerprints(spark.createDataFrame([("b", "x\ny"), ("a", "x\nz"), (None, None), ("c", "")], "doc_id string, text string")).collect()
    assert {r.doc_id: round(r.near_next, 9) for r in rows} == {"c": 0.0, "b": round(1 / 3, 9), "a": 0.0, None: 1.0}


def test_no_python_in_the_plan(spark):
    plan = K.fingerprints(frame(spark, AWKWARD[:3]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
