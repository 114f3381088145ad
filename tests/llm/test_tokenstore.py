import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import AWKWARD, frame
from tidewatch.llm import tokenstore as K
from tidewatch.llm.runtime import scratch


def test_round_trip(spark):
    folder = scratch(spark, "tokens")
    K.write(frame(spark), folder, K.tokenizer_path())
    rows = sorted(K.read(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    lib = Tokenizer.from_file(K.tokenizer_path())
    want = sorted(((i, lib.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in AWKWARD), key=str)
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows), key=str) == want
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(r.ids))
        at += r.n_tokens
    assert [r.doc_id for r in rows] == sorted((i for i, _, _ in AWKWARD), key=lambda i: (i is not None, i or 0))
    index = spark.read.parquet(f"{folder}/index")
    assert index.count() == index.select("digest").distinct().count()


def test_damage_is_found(spark):
    from pathlib import Path

    folder = scratch(spark, "tokens")
    K.write(frame(spark), folder, K.tokenizer_path())
    pack = next(Path(folder.removeprefix("file:")).glob("packs/*.bin"))
    data = bytearray(pack.read_bytes())
    data[-3] ^= 1
    pack.write_bytes(data)
    with pytest.raises(Exception, match="damaged|decompress|Data corruption"):
        K.read(spark, folder).collect()


def test_cuts_depend_on_the_neighbourhood():
    ids = np.random.default_rng(0).integers(0, 49_000, 60_000).astype(np.uint32)
    ends = K.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= K.MOST and sizes[:-1].min() >= K.LEAST
    moved = {e - 5000 for e in K.cuts(np.concatenate([ids[20_000:25_000], ids]))}
    assert len(moved & set(ends)) >= 0.8 * len(ends)
    assert K.cuts(ids[:0]) == [] and K.cuts(ids[:3]) == [3]
    assert all(0 < b - a <= K.MOST for a, b in zip([0, *K.cuts(np.zeros(50_000, np.uint32))], K.cuts(np.zeros(50_000, np.uint32)), strict=False))


def test_empty(spark):
    folder = scratch(spark, "tokens")
    K.write(frame(spark, []), folder, K.tokenizer_path())
    assert K.read(spark, folder).isEmpty()


def test_ids_beyond_the_width_are_refused(spark):
    with pytest.raises(Exception, match="doesn't fit"):
        K.write(frame(spark), scratch(spark, "tokens"), K.tokenizer_path(), width=1)
    folder = scratch(spark, "tokens")
    K.write(frame(spark), folder, K.tokenizer_path(), width=4)
    assert K.read(spark, folder, width=4).count() == len(AWKWARD)
