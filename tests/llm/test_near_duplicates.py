import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import AWKWARD, frame
from tidewatch.llm import simhash as S
from tidewatch.llm.runtime import cut


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, budget):
    p = {f: f for f in fps}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    order = np.array(sorted(p), np.uint64)
    for i, f in enumerate(order.tolist()):
        for g in order[i + 1 :][np.bitwise_count(order[i + 1 :] ^ order[i]) <= budget].tolist():
            p[find(f)] = find(g)
    return {f: find(f) for f in p}


def test_fingerprints():
    for text in [r[1] for r in AWKWARD] + ["a", "a b", "A B c", "é É e"]:
        assert S.fingerprint(text) == plain(text if text is None or len(text) < 10_000 else text)
    assert S.fingerprint("x y z " * 200_000 + "w") == plain("x y z " * 200_000 + "w")


def clustered(rng, n):
    """Fingerprints in tight groups, so that subtries get hot and chains of links arise."""
    out = []
    for base in rng.integers(0, 2**63, 12, dtype=np.uint64).tolist():
        f = base
        for _ in range(n):
            out.append(f)
            f ^= sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4)))
    return out + rng.integers(0, 2**63, 200, dtype=np.uint64).tolist() + [0, 0, 2**64 - 1, 2**64 - 3]


@pytest.mark.parametrize(("budget", "hot"), [(2, 4096), (2, 5), (1, 5), (3, 5)])
def test_links_against_brute_force(spark, budget, hot):
    fps = clustered(np.random.default_rng(budget), 60)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp bigint")
    place = {int(np.int64(r.node).view(np.uint64)): r.root for r in S.components(S.links(df, budget, hot)).collect()}
    groups, found = defaultdict(set), defaultdict(set)
    for f, root in components(fps, budget).items():
        groups[root].add(f)
    for f in set(fps):
        found[place.get(f, f"own {f}")].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_subtries_are_walked_one_after_another(spark, monkeypatch):
    import pyarrow as pa

    fps = clustered(np.random.default_rng(7), 40)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp bigint").distinct()
    place = ["trie", "sub", "block", "subblock"]
    rows = S._dealt(df, 2, 5).select("fp", *place).orderBy(*place).toArrow().combine_chunks()
    whole = {b.num_rows for b in S._link_partition(iter(rows.to_batches()), 2)}
    monkeypatch.setattr(S, "_ROWS_HELD", 40)
    parts = list(S._link_partition(iter(rows.to_batches(max_chunksize=17)), 2))
    assert len(whole) == 1 and len(parts) > 5
    edges = spark.createDataFrame(pa.Table.from_batches(parts).to_pandas())
    found = {int(np.int64(r.node).view(np.uint64)): r.root for r in S.components(edges).collect()}
    want = components(fps, 2)
    for f in want:
        for g in want:
            assert (want[f] == want[g]) == (found.get(f, f) == found.get(g, g))


def test_long_chain(spark):
    chain = spark.range(300).selectExpr("id AS u", "id + 1 AS v")
    assert len({r.root for r in cut(S.components(chain)).collect()}) == 1


def test_awkward_documents(spark):
    got = S.near_duplicates(frame(spark)).collect()
    assert len(got) == len(AWKWARD)
    want = components([plain(r[1]) for r in AWKWARD], 2)
    least = defaultdict(list)
    for i, t, _ in AWKWARD:
        least[want[plain(t)]].append(i)
    first = {k: min([i for i in v if i is not None], default=None) for k, v in least.items()}
    expected = sorted(((i, f"{plain(t):016x}", first[want[plain(t)]]) for i, t, _ in AWKWARD), key=str)
    assert sorted(map(tuple, got), key=str) == expected


def test_one_of_each_stays(spark):
    df = frame(spark)
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    want = components([plain(r[1]) for r in AWKWARD], 2)
    assert sorted(want[plain(t)] for _, t in texts) == sorted(set(want.values()))
    assert (1, AWKWARD[0][1]) in texts and (2, None) in texts


def test_empty(spark):
    none = frame(spark, [])
    assert S.near_duplicates(none).isEmpty() and S.keep_one(none).isEmpty()
