import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import AWKWARD, frame
from tidewatch.llm import packing as K
from tidewatch.llm.fastencode import PieceEncoder


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    import pyarrow as pa

    path = public_tokenizers.path(name)
    lib, enc = Tokenizer.from_file(path), PieceEncoder(path)
    texts = [r[1] for r in AWKWARD] + ["it's  we'll!! Foo'S ok.'s x", "a\n\n b\t c ", ". ,a .b..c", "İSTANBUL ΣΑΣ. Σ", " a　 b c  d\x85 e"]
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in enc.encode(pa.array(texts, pa.string()))] == want

    @settings(max_examples=150, deadline=None)
    @given(st.text(st.sampled_from("ab'sA .,!\n\t\xa0　é0Σ😀|"), max_size=24))
    def check(t):
        assert next(enc.encode(pa.array([t]))).tolist() == lib.encode(t, add_special_tokens=False).ids

    check()
    added = [t["content"] for t in enc.added]

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.sampled_from([*added, *(t.upper() for t in added), *(t[:-1] for t in added), *(t[1:] for t in added), "a", " ", "Word", "|", "<", ">.", "é", "\n"]), max_size=9))
    def check_added(parts):
        t = "".join(parts)
        assert next(enc.encode(pa.array([t]))).tolist() == lib.encode(t, add_special_tokens=False).ids

    check_added()


def test_files_of_other_forms_are_not_cut(tmp_path):
    import json

    import pyarrow as pa

    texts = ["Some Words, and  more.", "a <|endoftext|> b", ""]
    base = json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    for k, change in enumerate(({"normalizer": {"type": "Lowercase"}}, {"added_tokens": []}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}})):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(base | change), "utf-8")
        enc = PieceEncoder(str(path))
        assert not enc.cuttable
        assert [x.tolist() for x in enc.encode(pa.array(texts))] == [Tokenizer.from_file(str(path)).encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60))
def test_sequences_are_full_and_pieces_whole(lengths):
    packer, made = K.HarmonicPacker(), []
    for d, n in enumerate(lengths):
        made += packer.add(d, n)
    made += packer.finish()
    covered = defaultdict(list)
    for pieces in made:
        total = sum(n for _, _, n in pieces)
        assert 0 < total <= K.CAPACITY
        if len({n for _, _, n in pieces}) == 1 and pieces[0][2] & (pieces[0][2] - 1) == 0:
            assert total & (total - 1) == 0
        for d, s, n in pieces:
            covered[d].append((s, n))
    for d, n in enumerate(lengths):
        at = 0
        for s, m in sorted(covered[d]):
            assert s == at
            at += m
        assert at == n


def test_awkward_documents(spark):
    rows = K.pack(frame(spark), K.tokenizer_path(), with_ids=True).collect()
    lib = Tokenizer.from_file(K.tokenizer_path())
    want = sorted(str((i, lib.encode(t or "", add_special_tokens=False).ids + [0])) for i, t, _ in AWKWARD)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, ids.tolist()))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= K.CAPACITY
    total = sum(r.length for r in rows)
    assert total == sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in AWKWARD)
    for (i, _), parts in pieces.items():
        if i in (1, 7, 8, 10):
            assert str((i, [x for _, p in sorted(parts) for x in p])) in want
    padded = sum(1024 - n for s in sequences.values() if (n := sum(x for _, x in s)) & (n - 1))
    assert padded <= 0.02 * total


def test_empty(spark):
    assert K.pack(frame(spark, []), K.tokenizer_path()).isEmpty()
    with pytest.raises(ValueError, match="power of two"):
        K.HarmonicPacker(1000)
