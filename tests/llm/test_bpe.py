import base64
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tests.llm.helpers import AWKWARD, frame
from tidewatch.llm import bpe as K

PATH = str(public_tokenizers.path(K.RANKS))


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return K.SqlBpe(PATH, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids(both):
    sql, lib = both
    r = random.Random(1)
    texts = [t for _, t, _ in AWKWARD if t is not None] + ["ab" * 700, "=-" * 300, "".join(r.choice("abcdefgh") for _ in range(1500)), "ÿ" * 90]
    texts += ["".join(r.choice("abcé .'s1\n") for _ in range(r.randint(0, 60))) for _ in range(200)]
    ids = list(sql.encode(pa.array(texts)))
    assert [x.tolist() for x in ids] == [lib.encode_ordinary(t) for t in texts]
    assert sql.decode(ids) == [t.encode() for t in texts]
    assert sql.decode([np.array([], np.uint32)]) == [b""]


def test_words_of_every_length(both):
    """One query, whatever the length: repeated letters, long runs, words that overlap themselves."""
    sql, lib = both
    r = random.Random(5)
    words = ["a" * n for n in (3, 17, 1000, 5001)] + ["aab" * 700, "abab" * 500, "の" * 400, "".join(r.choice("abc") for _ in range(4000)), "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2500))]
    words += ["".join(r.choice("aabn") for _ in range(r.randint(2, 40))) for _ in range(400)]
    assert [x.tolist() for x in sql.encode(pa.array(words))] == [lib.encode_ordinary(w) for w in words]


def test_other_patterns_split_whole_texts():
    pattern = r"\S+|\s+"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["well, yes.  No", "a b.c", ""]
    assert [x.tolist() for x in K.SqlBpe(PATH, pattern).encode(pa.array(texts))] == [lib.encode_ordinary(t) for t in texts]


def test_any_ids_decode(both):
    sql, lib = both
    ids = np.random.default_rng(0).integers(0, 50_000, 3000).astype(np.uint32)
    assert sql.decode([ids, ids[:0], ids[:1]]) == [lib.decode_bytes(ids.tolist()), b"", lib.decode_bytes(ids[:1].tolist())]


def test_awkward_documents(spark, both):
    got = K.decode(K.encode(frame(spark), PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
    want = sorted(((i, np.array(both[1].encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, _ in AWKWARD), key=str)
    assert sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got), key=str) == want
    once = K.round_trip(frame(spark), PATH, public_tokenizers.PATTERN).collect()
    assert sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in once), key=str) == want
    assert K.round_trip(frame(spark, []), PATH, public_tokenizers.PATTERN).isEmpty()
