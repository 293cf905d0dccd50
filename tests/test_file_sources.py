"""LMDB pages and zipped runs, from files that the tests write byte by byte or pickle themselves."""

import os
import pickle
import struct
import zipfile

import numpy as np
import pandas as pd
import pytest

from touchline.sources import lmdb, zipped

SIZE = 512


def environment(rows, txn=(5, 4), flags=0, per_leaf=4):
    """A file of version 1 with these sorted rows: leaves of a few nodes, overflow pages for long values, levels of branches above."""
    pages = {}
    number = [2]

    def new(body, kind, spare=0):
        at = number[0]
        number[0] += 1 + spare
        pages[at] = (kind, body)
        return at

    def page(nodes, kind):
        ptrs, body, top = [], b"", SIZE
        for n in nodes:
            n += b"\0" * (len(n) % 2)
            top -= len(n)
            ptrs.append(top)
            body = n + body
        assert 16 + 2 * len(ptrs) <= top
        head = struct.pack("<HHHH", 0, kind, 16 + 2 * len(ptrs), top) + b"".join(struct.pack("<H", p) for p in ptrs)
        return new(head + b"\0" * (top - 8 - len(head)) + body, kind)

    leaves = []
    for k in range(0, len(rows), per_leaf):
        nodes = []
        for key, value in rows[k : k + per_leaf]:
            if len(value) > 80:
                spare = (16 + len(value) - 1) // SIZE
                far = new(struct.pack("<HHI", 0, 4, spare + 1) + value, 4, spare)
                nodes.append(struct.pack("<HHHH", len(value) & 0xFFFF, len(value) >> 16, 1, len(key)) + key + struct.pack("<Q", far))
            else:
                nodes.append(struct.pack("<HHHH", len(value), 0, flags, len(key)) + key + value)
        leaves.append((rows[k][0], page(nodes, 2)))
    depth, level = 1, leaves
    while len(level) > 1:
        level = [
            (part[0][0], page([struct.pack("<HHHH", p & 0xFFFF, p >> 16 & 0xFFFF, p >> 32, len(key) if n else 0) + (key if n else b"") for n, (key, p) in enumerate(part)], 1))
            for part in (level[k : k + 5] for k in range(0, len(level), 5))
        ]
        depth += 1
    root = level[0][1] if level else (1 << 64) - 1
    out = bytearray(number[0] * SIZE)
    for k, t in enumerate(txn):
        table = struct.pack("<IHHQQQQQ", 0, 0, depth, 0, len(leaves), 0, len(rows), root if t == max(txn) else (1 << 64) - 1)
        free = struct.pack("<IHHQQQQQ", SIZE, 0, 0, 0, 0, 0, 0, (1 << 64) - 1)
        meta = struct.pack("<QHHHH", k, 0, 8, 0, 0) + struct.pack("<IIQQ", 0xBEEFC0DE, 1, 0, len(out)) + free + table + struct.pack("<QQ", number[0] - 1, t)
        out[k * SIZE : k * SIZE + len(meta)] = meta
    for at, (_, body) in pages.items():
        whole = struct.pack("<Q", at) + body
        out[at * SIZE : at * SIZE + len(whole)] = whole
    return bytes(out)


def rows_of(n):
    rng = np.random.default_rng(n)
    return [(f"key-{k:05d}".encode(), rng.bytes(int(rng.integers(0, 60)) if k % 7 else int(rng.integers(100, 3000)))) for k in range(n)]


@pytest.mark.parametrize("n", [1, 3, 60, 300])
def test_entries_of_a_file(spark, tmp_path, n):
    rows = rows_of(n)
    (tmp_path / "data.mdb").write_bytes(environment(rows))
    got = lmdb.read(spark, str(tmp_path), 4)
    assert sorted((bytes(r["key"]), bytes(r["value"])) for r in got.collect()) == rows
    assert got.rdd.getNumPartitions() == (4 if n >= 60 else 1)


def test_each_task_reads_a_range_of_keys(tmp_path):
    rows = rows_of(300)
    (tmp_path / "data.mdb").write_bytes(environment(rows, txn=(4, 5)))
    reader = lmdb.LmdbReader({"path": str(tmp_path), "partitions": "6"})
    parts = [[k.as_py() for b in reader.read(p) for k in b["key"]] for p in reader.partitions()]
    assert len(parts) == 6 and all(parts) and sum(parts, []) == [k for k, _ in rows]


def test_empty_and_other_files(spark, tmp_path):
    (tmp_path / "e.mdb").write_bytes(environment([]))
    assert lmdb.read(spark, str(tmp_path / "e.mdb")).count() == 0
    (tmp_path / "x.mdb").write_bytes(b"\0" * 2000)
    with pytest.raises(Exception, match="no LMDB file"):
        lmdb.read(spark, str(tmp_path / "x.mdb")).collect()
    (tmp_path / "s.mdb").write_bytes(environment(rows_of(3)[1:], flags=2))
    with pytest.raises(Exception, match="named tables"):
        lmdb.read(spark, str(tmp_path / "s.mdb")).collect()


def test_labelled_images(spark, tmp_path):
    rows = [(b"num-samples", b"3")] + [(f"image-{k:09d}".encode(), bytes([k]) * 200) for k in (1, 2, 3, 4)] + [(f"label-{k:09d}".encode(), t) for k, t in ((1, "Ab c".encode()), (2, "é1".encode()), (3, b"!!"), (4, b"late"))]
    (tmp_path / "data.mdb").write_bytes(environment(sorted(rows)))
    got = {r["index"]: (bytes(r["content"]), r["label"]) for r in lmdb.labelled(spark, str(tmp_path), "abcde1").collect()}
    assert got == {1: (b"\1" * 200, "abc"), 2: (b"\2" * 200, "e1")}


def archive(path, tables):
    with zipfile.ZipFile(path, "w") as z:
        for name, t in tables.items():
            z.writestr(name, t if isinstance(t, bytes) else pickle.dumps(t))
        z.writestr("summary.json", "{}")


SCHEMA = "seq string, det_id long, track_id long, conf double, role string, box array<double>, seen boolean, absent double"


def frame(shift):
    return pd.DataFrame({"track_id": [1.0, np.nan], "conf": [0.5, np.nan], "role": ["player", None], "box": [np.array([1.0, 2.0 + shift]), None], "seen": [True, False]}, index=[10 + shift, 11 + shift])


def test_zipped_run(spark, tmp_path):
    images = pd.DataFrame({"frame": [1, 2], "file_path": ["a.jpg", "b.jpg"]}, index=[100, 101])
    archive(tmp_path / "run.pklz", {"A.pkl": frame(0), "A_image.pkl": images, "B.pkl": frame(5)})
    got = zipped.read_archive(spark, str(tmp_path / "run.pklz"), SCHEMA, index="det_id")
    assert got.rdd.getNumPartitions() == 2
    assert sorted(map(tuple, got.collect()), key=str) == [
        ("A", 10, 1, 0.5, "player", [1.0, 2.0], True, None), ("A", 11, None, None, None, None, False, None),
        ("B", 15, 1, 0.5, "player", [1.0, 7.0], True, None), ("B", 16, None, None, None, None, False, None),
    ]
    f = zipped.read_archive(spark, str(tmp_path), "seq string, image_id long, frame int, file_path string", "frames", "image_id")
    assert sorted(map(tuple, f.collect())) == [("A", 100, 1, "a.jpg"), ("A", 101, 2, "b.jpg")]
    with pytest.raises(ValueError):
        zipped.read_archive(spark, "x", "seq string", "tables")


class Evil:
    def __reduce__(self):
        return os.system, ("true",)


@pytest.mark.parametrize("bad", [Evil(), pd.DataFrame({"x": [Evil()]}), print])
def test_foreign_classes_are_refused(spark, tmp_path, bad):
    archive(tmp_path / "run.pklz", {"A.pkl": bad})
    with pytest.raises(Exception, match="is not part of a table"):
        zipped.read_archive(spark, str(tmp_path / "run.pklz"), SCHEMA).collect()


def test_no_tables(spark, tmp_path):
    archive(tmp_path / "run.pklz", {"A.pkl": pickle.dumps([1])})
    with pytest.raises(Exception, match="is no table"):
        zipped.read_archive(spark, str(tmp_path / "run.pklz"), SCHEMA).collect()
    archive(tmp_path / "none.pklz", {})
    with pytest.raises(Exception, match="no table of a sequence"):
        zipped.read_archive(spark, str(tmp_path / "none.pklz"), SCHEMA).collect()
