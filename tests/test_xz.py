"""xz feeds of many blocks, read in parts."""

import json
import lzma
import random
import zlib

import pyarrow.fs as pafs
import pytest

from genosieve.sources import xz
from genosieve.sources.xz import FeedSource


def number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def stream(pieces, padding=0):
    """One xz stream with a block for every piece."""
    blocks, records = b"", b""
    for p in pieces:
        one = lzma.compress(p, check=lzma.CHECK_CRC64)
        index = (int.from_bytes(one[-8:-4], "little") + 1) * 4
        block = one[12 : -12 - index]
        at = len(one) - 12 - index
        data = one[at:]
        k = 2  # after the mark and the count of one record
        unpadded = shift = 0
        while True:
            unpadded |= (data[k] & 127) << shift
            shift, k = shift + 7, k + 1
            if not data[k - 1] & 128:
                break
        blocks += block
        records += number(unpadded) + number(len(p))
    head = lzma.compress(b"", check=lzma.CHECK_CRC64)[:12]
    index = b"\0" + number(len(pieces)) + records
    index += b"\0" * (-len(index) % 4)
    index += zlib.crc32(index).to_bytes(4, "little")
    foot = (len(index) // 4 - 1).to_bytes(4, "little") + head[6:8]
    return head + blocks + index + zlib.crc32(foot).to_bytes(4, "little") + foot + b"YZ" + b"\0" * padding


def cut(data, r, top):
    out = []
    while data:
        k = r.randint(1, top)
        out.append(data[:k])
        data = data[k:]
    return out


@pytest.mark.parametrize("top", [1, 7, 60, 400, 10**6])
def test_parts_equal_the_whole(tmp_path, top):
    r = random.Random(top)
    for case in range(6):
        rows = [b"x" * r.choice([0, 1, 5, 90]) for _ in range(r.randint(0, 25))]
        data = b"\n".join(rows) + r.choice([b"", b"\n"])
        pieces = cut(data, r, top)
        half = r.randint(0, len(pieces))
        padding = 4 * r.randint(0, 2)
        raw = stream(pieces[:half], padding) + stream(pieces[half:]) if case % 2 else stream(pieces)
        assert padding and case % 2 or lzma.decompress(raw) == data  # Python's own reader stops at padding
        path = tmp_path / f"{case}.xz"
        path.write_bytes(raw)
        with pafs.LocalFileSystem().open_input_file(str(path)) as f:
            blocks = xz.index(f, len(raw))
            assert [b.decoded for b in blocks] == [len(p) for p in pieces]
            for split in (1, 10, 150, 10**9):
                parts = xz.runs("p", blocks, split)
                found = [x for run in parts for x in xz.lines(f, run, len(raw))]
                want = data.split(b"\n")
                assert found == (want if want[-1] else want[:-1])
                assert split > 1 or len(parts) == len(pieces)


def test_cut_off_files_raise(tmp_path):
    raw = stream([b"a\n", b"b\n"])
    (tmp_path / "x.xz").write_bytes(raw[:-3])
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "x.xz")) as f, pytest.raises(ValueError, match="cut off"):
        xz.index(f, len(raw) - 3)


def test_source_in_many_tasks(spark, tmp_path):
    r = random.Random(3)
    rows = [{"id": str(i), "text": "é" * r.randint(0, 300)} for i in range(3000)]
    data = "".join(json.dumps(x, ensure_ascii=False) + "\n" for x in rows).encode()
    (tmp_path / "large.xz").write_bytes(stream([data[i : i + 20_000] for i in range(0, len(data), 20_000)]))
    (tmp_path / "small.xz").write_bytes(lzma.compress(b'{"id": "s", "text": null}\n\n') + b"\0" * 8 + lzma.compress(b'{"id": "t"}'))
    (tmp_path / "none.xz").write_bytes(lzma.compress(b""))
    spark.dataSource.register(FeedSource)
    df = spark.read.format("xzjson").schema("id string, text string").option("splitbytes", 100_000).option("smallfile", 1000).load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 5
    assert sorted((x.id, x.text) for x in df.collect()) == sorted([(x["id"], x["text"]) for x in rows] + [("s", None), ("t", None)])
