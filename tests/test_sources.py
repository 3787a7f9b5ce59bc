import json
import os
import random
import struct

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import types as T

from sightline.operators.keeping import derived_currency, read_derived, write_derived
from sightline.sources import buffers
from sightline.sources.publish import StatGatedCache, atomic_publish, staging_sweep
from sightline.sources.tail import capture_follow, lines_of, spans, tail

FRAME = T.StructType([T.StructField("seq", T.LongType())])


def append(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "ab") as f:
        f.write(data)


def test_tail_reads_whole_lines_once(spark, tmp_path):
    root, seen = str(tmp_path / "in"), []
    journal = f"{root}/a/frames.jsonl"

    def poll():
        before = len(seen)
        q = tail(spark, root).writeStream.foreachBatch(lambda df, _: seen.extend(r.value for r in df.orderBy("path", "offset").collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return seen[before:]

    append(journal, b'{"seq": 1}\n{"seq": 2}\n{"se')
    assert poll() == ['{"seq": 1}', '{"seq": 2}']
    append(journal, b'q": 3}\n\n\xff\xfe\n')
    append(f"{root}/b/frames.jsonl", b"other\n")
    assert poll() == ['{"seq": 3}', "", "��", "other"]
    assert poll() == []
    with open(journal, "wb") as f:  # shorter than before: read from the start
        f.write(b"new\n")
    assert poll() == ["new"]


def test_spans_share_a_file_line_by_line(spark, tmp_path):
    rnd = random.Random(6)
    lines = [b"x" * rnd.choice([0, 1, 2, 9, 40]) for _ in range(60)]
    path = tmp_path / "f"
    path.write_bytes(b"\n".join(lines) + b"\n")
    offsets = [sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))]
    stop = path.stat().st_size
    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        for start in (0, offsets[7]):
            for size in (1, 2, 3, 7, 41, 10_000):
                for step in (1, 5, 1 << 20):
                    got = [x for span in spans(str(path), start, stop, size) for x in lines_of(f, span, step)]
                    assert got == [(o, x) for o, x in zip(offsets, lines) if o >= start], (start, size, step)


def test_a_long_backlog_is_many_tasks(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "frames.jsonl").write_text("".join(f'{{"n": {i}}}\n' for i in range(500)) + "torn")
    seen, tasks = [], []

    def take(df, _):
        tasks.append(df.rdd.getNumPartitions())
        seen.extend(json.loads(r.value)["n"] for r in df.orderBy("offset").collect())

    q = tail(spark, str(tmp_path), span_bytes=1000).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert seen == list(range(500)) and max(tasks) >= 5


def test_tail_from_the_end(spark, tmp_path):
    root, seen = str(tmp_path / "in"), []
    append(f"{root}/a/frames.jsonl", b"old\n")
    for more in (b"", b"new\n"):
        append(f"{root}/a/frames.jsonl", more)
        q = tail(spark, root, start_at_end=True).writeStream.foreachBatch(lambda df, _: seen.extend(r.value for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert seen == ["new"]


def manifest(root, name, **fields):
    append(f"{root}/{name}/manifest.json", json.dumps(fields).encode())


def test_follow_goes_on_within_the_grace(spark, tmp_path):
    root, got = str(tmp_path / "in"), []
    for name, seqs in (("a", b'{"seq": 1}\n[1]\n{"seq": 2}\n'), ("b", b'{"seq": 3}\n'), ("c", b'{"seq": 4}\n')):
        append(f"{root}/{name}/frames.jsonl", seqs)
    manifest(root, "a", ended_at=100.0, end_reason="disconnect")
    manifest(root, "b", ended_at=200.0, end_reason="disconnect", continues_capture="a")
    now = [150.0]

    def sleep(_):  # the successor of b appears exactly at the end of the grace
        now[0] += 70.0
        if now[0] == 290.0:
            manifest(root, "c", ended_at=300.0, end_reason="stopped", continues_capture="b")

    walk = capture_follow(spark, root, "a", FRAME, lambda df: got.extend(r.seq for r in df.collect()), str(tmp_path / "cp"), clock=lambda: now[0], sleep=sleep)
    assert walk == ["a", "b", "c"] and got == [1, 2, 3, 4]


def test_follow_ends_without_successor_or_when_idle(spark, tmp_path):
    root = str(tmp_path / "in")
    for name in "ab":
        append(f"{root}/{name}/frames.jsonl", b'{"seq": 1}\n')
    manifest(root, "a", ended_at=100.0, end_reason="disconnect")
    late = capture_follow(spark, root, "a", FRAME, lambda df: None, str(tmp_path / "cp"), clock=lambda: 190.1, sleep=lambda _: None)
    idle = capture_follow(spark, root, "b", FRAME, lambda df: None, str(tmp_path / "cp2"), max_idle=2, sleep=lambda _: None)
    assert late == ["a"] and idle == ["b"]


def test_publish_replaces_whole_files(spark, tmp_path):
    path = str(tmp_path / "m.json")
    for payload in ({"v": 1}, {"v": 2, "x": [1, None]}):
        atomic_publish(spark, path, payload)
        assert json.load(open(path)) == payload
    with pytest.raises(ValueError):
        atomic_publish(spark, path, {"v": float("nan")})
    assert [n for n in os.listdir(tmp_path) if n.endswith(".tmp")] == [] and json.load(open(path))["v"] == 2


def test_sweep_takes_only_dead_writers_files(tmp_path):
    dead, mine, other = f"a.json.p999999.{'0' * 32}.tmp", f"a.json.p{os.getpid()}.{'1' * 32}.tmp", "a.json.tmp"
    for n in (dead, mine, other):
        (tmp_path / n).write_text("x")
    assert staging_sweep(str(tmp_path)) == [dead] and sorted(os.listdir(tmp_path)) == sorted([mine, other])


def test_cache_follows_its_files_and_the_minute(spark, tmp_path):
    path, cache = str(tmp_path / "t"), StatGatedCache(spark)
    load = lambda s, p: s.read.parquet(p)
    spark.range(3).write.parquet(path)
    assert [cache.get(path, None, load, now=t).count() for t in (0.0, 59.0)] == [3, 3] and cache.loads == 1
    spark.range(2).write.mode("append").parquet(path)
    assert cache.get(path, None, load, now=59.0).count() == 5 and cache.loads == 2
    cache.get(path, None, load, now=60.0), cache.get(path, 7.0, load, now=60.0)
    assert cache.loads == 4


def test_points_and_meshes_there_and_back(spark):
    pts = [("p", i, float(i), 0.5, -1.0, i % 256, 2, 3, 4) for i in range(70_000)] + [("q", 0, 1.0, 2.0, 3.0, 1, 2, 3, 255)]
    df = spark.createDataFrame(pts, "path string, index long, x float, y float, z float, r int, g int, b int, confidence int")
    packed = buffers.pack_points(df)
    assert {(r.path, r.part): len(r.content) for r in packed.collect()} == {("p", 0): 65536 * 16, ("p", 1): (70_000 - 65536) * 16, ("q", 0): 16}
    assert buffers.unpack_points(packed).exceptAll(df).count() == 0 == df.exceptAll(buffers.unpack_points(packed)).count()
    with pytest.raises(Exception, match="no whole number"):
        buffers.unpack_points(spark.createDataFrame([("p", 0, b"x" * 17)], "path string, part long, content binary")).collect()


def test_mesh_container_by_its_layout(spark):
    v, c, f = np.array([[0, 0, 0], [1, 2, 4], [0.5, 1, 2]], "f4"), [[1, 2, 3], [4, 5, 6], [7, 8, 9]], [[0, 1, 2]]
    normals = [[1, 0, 0], [0, -1, 0], [0, 0, 0.5]]
    blob = buffers.pack_mesh(v, c, f, normals)
    want = struct.pack("<8sIIII6f", b"WBSURF01", 3, 3, 3, 1, 0, 0, 0, 1, 2, 4) + struct.pack("<9H", 0, 0, 0, 65535, 65535, 65535, 32767, 32767, 32767) + bytes(range(1, 10)) + struct.pack("<9b", 127, 0, 0, 0, -127, 0, 0, 0, 63) + struct.pack("<3H", 0, 1, 2)
    assert blob == want
    many = buffers.pack_mesh(np.zeros((65_536, 3)), None, [[0, 65_535, 1]])
    assert many[-12:] == struct.pack("<3I", 0, 65_535, 1) and len(many) == 48 + 65_536 * 9 + 12  # indices of 32 bits from there on
    assert buffers.read_mesh("m", buffers.pack_mesh(np.zeros((0, 3)), None, []))[0].shape == (0, 3)
    sure = buffers.pack_confidence([1, 2, 255])
    assert sure == struct.pack("<8sIII", b"WBCONF01", 3, 1, 0) + b"\x01\x02\xff"
    row = lambda b, s: spark.createDataFrame([("m", b, s)], "path string, content binary, confidence binary")
    vertices, faces = buffers.unpack_mesh(row(blob, sure))
    got = [tuple(r) for r in vertices.orderBy("id").collect()]
    assert [r[:2] + r[5:8] + r[11:] for r in got] == [("m", 0, 1, 2, 3, 1), ("m", 1, 4, 5, 6, 2), ("m", 2, 7, 8, 9, 255)] and tuple(faces.first()) == ("m", 0, 0, 1, 2)
    assert got[1][2:5] == (1.0, 2.0, 4.0) and got[2][2:5] == pytest.approx((0.5, 1, 2), abs=1e-4) and got[2][8:11] == pytest.approx((0, 0, 63 / 127))
    plain, _ = buffers.unpack_mesh(row(buffers.pack_mesh(v, c, f), None))
    assert [tuple(r)[8:] for r in plain.collect()] == [(None, None, None, None)] * 3
    again = buffers.pack_meshes(vertices, faces).first()
    assert again.content == blob and again.confidence == sure
    bad = {
        "no header": (blob[:20], None), "another kind": (b"X" + blob[1:], None), "version": (blob[:20] + b"\x09" + blob[21:], None), "bytes for": (blob[:-1], None), "isn't there": (buffers.pack_mesh(v, c, [[0, 1, 3]]), None),
        "whole number of triangles": (blob[:12] + b"\x04" + blob[13:], None), "confidences for": (blob, buffers.pack_confidence([1])), "bytes for 3 confidences": (blob, sure[:-1]), "another kind of buffer": (blob, blob),
    }
    for why, (b, s) in bad.items():
        with pytest.raises(Exception, match=why):
            [x.collect() for x in buffers.unpack_mesh(row(b, s))]


def test_chunks_of_pictures(spark):
    kind = sorted(buffers.PICTURES)[0]
    blob = buffers.pack_chunk(kind, 640, 360, [b"abc", b"", b"de"])
    assert blob == struct.pack("<8sIIIIII", b"WBAPCK01", 1, buffers.PICTURES[kind], 3, 640, 360, 0) + struct.pack("<6I", 0, 3, 3, 0, 3, 2) + b"abcde"
    df = lambda *b: spark.createDataFrame([(f"c{i}", x) for i, x in enumerate(b)], "path string, content binary")
    out = buffers.unpack_chunks(df(blob, buffers.pack_chunk(kind, 1, 1, []))).collect()
    assert [(r.path, r.slot, r.picture, r.width, r.height, bytes(r.content)) for r in out] == [("c0", i, kind, 640, 360, x) for i, x in enumerate((b"abc", b"", b"de"))]
    for why, b in {"no header": blob[:9], "another kind": b"X" + blob[1:], "unknown picture": blob[:12] + b"\x09" + blob[13:], "its table": blob[:40], "past the end": blob[:-1], "disagrees": blob + b"x"}.items():
        with pytest.raises(Exception, match=why):
            buffers.unpack_chunks(df(b)).collect()


def test_derived_tables_answer_only_to_their_digest(spark, tmp_path):
    poses = spark.createDataFrame([("s", 1), ("s", 2), ("t", 3)], "session_id string, pose int")
    path = str(tmp_path / "d")
    write_derived({"poses": poses}, path, spark.createDataFrame([("s", "d1"), ("t", "d2")], "session_id string, input_digest string"))
    want = spark.createDataFrame([("s", "d1"), ("t", "other"), ("u", "d3")], "session_id string, input_digest string")
    assert {(r.session_id, r.pose) for r in read_derived(spark, path, "poses", want).collect()} == {("s", 1), ("s", 2)}
    now = want.withColumnRenamed("input_digest", "now").union(spark.createDataFrame([("v", None)], "session_id string, now string"))
    got = {r.session_id: r.current for r in derived_currency(spark.read.parquet(f"{path}/manifest"), now).collect()}
    assert got == {"s": True, "t": False, "u": None, "v": None}
