import base64
import gzip
import hashlib
from pathlib import Path

import numpy as np
import pytest

from tidewatch.llm import warc as K
from tidewatch.llm.runtime import scratch

ROWS = [(1, "http://a b\r\nc", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (None, "u", "x"), (None, "u", "only"), (None, "v", "only"), (5, "é", "é\r\n\r\nWARC/1.1\r\n"), (2, "z", "x"), (2, "z", "y"), (9, "big", "<p>" * 400_000), (10, "big", "<p>" * 400_000)]
# larger than what is read at once, compressed too
ROWS.append((11, "wide", "".join(map(chr, np.random.default_rng(0).integers(33, 0x2FF, 2_000_000)))))


def expected(rows, least):
    digest = lambda h: base64.b32encode(hashlib.sha1(h).digest()).decode()
    data = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, h in data:
        same = [j for j, g in data if g == h and j is not None]
        revisit = same and len(h) >= least and (i is None or i < max(same))
        out.append((i, len(h), digest(h), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "roll"), [(0, 1 << 20), (0, 400), (2, 1 << 20)])
def test_round_trip(spark, least, roll):
    df = spark.createDataFrame(ROWS, "page_id bigint, url string, html string").selectExpr("*", "'clash' AS sha1", "'clash' AS refers_to")
    folder = scratch(spark, "warc")
    manifest = K.write(df, folder, least_bytes=least, roll=roll)
    assert sorted(map(tuple, K.read(spark, folder).collect()), key=str) == expected(ROWS, least)
    files = list(Path(folder.removeprefix("file:")).glob("files/*.gz"))
    assert sorted(f.name for f in files) == sorted(r.file for r in manifest.collect())
    assert not list(Path(folder.removeprefix("file:")).glob("files/.*tmp*"))
    for r in manifest.collect():
        data = (Path(folder.removeprefix("file:")) / "files" / r.file).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r.bytes, r.sha256)
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_same_files_again(spark):
    df = spark.createDataFrame(ROWS, "page_id bigint, url string, html string")
    sums = [sorted((r.file, r.sha256) for r in K.write(df.repartition(n), scratch(spark, "warc")).collect()) for n in (1, 1)]
    assert sums[0] == sums[1]


def test_damage_is_found(spark):
    record = K.page_record(1, "u", b"payload", None)
    head, block = K.parse(gzip.decompress(record))
    assert head["x-page-id"] == "1" and block.endswith(b"payload")
    with pytest.raises(ValueError, match="damaged"):
        K.parse(gzip.decompress(record).replace(b"payload", b"paYload"))


def test_empty(spark):
    folder = scratch(spark, "warc")
    assert K.write(spark.createDataFrame([], "page_id bigint, url string, html string"), folder).isEmpty()
    assert K.read(spark, folder).isEmpty()
