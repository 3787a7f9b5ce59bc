import gzip
import hashlib
import random

from sightline.llm.warc import MAGIC, member, payload_digest, read_archives, response_record, revisit_record, salvage, write_archives


def records(n=6):
    return [response_record(i, f"http://e.org/{i}", bytes([65 + i]) * (100 * i) + MAGIC + b"WARC/1.1") for i in range(n)] + [revisit_record(9, None, payload_digest(b""), 0, 3)]


def ids(data):
    return [x["head"]["warc-record-id"] for what, _, _, x in salvage(data) if what == "record"]


def test_clean():
    for data in (b"".join(map(member, records())), b"".join(records())):
        assert len(ids(data)) == 7 and all(what == "record" for what, *_ in salvage(data))
    assert list(salvage(b"")) == []


def test_damage_loses_only_its_record_and_is_logged():
    rnd = random.Random(1)
    for packed in (True, False):
        parts = [member(r) for r in records()] if packed else records()
        starts = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
        for hit in range(6):
            data = bytearray(b"".join(parts))
            at = starts[hit] + len(parts[hit]) // 2
            for i in range(at, min(at + 6, starts[hit + 1])):
                data[i] ^= rnd.randint(1, 255)
            found = list(salvage(bytes(data)))
            assert len([1 for w, *_ in found if w == "record"]) >= 6
            gaps = [(a, b) for w, a, b, _ in found if w == "gap"]
            assert all(starts[hit] <= a < b <= starts[hit + 1] for a, b in gaps)
        cut = b"".join(parts)[: starts[5] + 20]
        found = list(salvage(cut))
        assert len([1 for w, *_ in found if w == "record"]) == 5 and found[-1][0] == "gap"
    junk = b"junk" + member(records()[0]) + b"\0\0more" + member(records()[1])
    assert [w for w, *_ in salvage(junk)] == ["gap", "record", "gap", "record"]


def test_members_of_several_records():
    parts = records()
    plain = bytearray(b"".join(parts))
    hit = sum(map(len, parts[:3])) + len(parts[3]) - 20 - len(MAGIC)
    plain[hit] ^= 1  # in the payload of the fourth record
    for rest in (b"", member(parts[5])):
        found = list(salvage(member(bytes(plain)) + rest))
        kinds = [w for w, *_ in found]
        assert kinds[:7] == ["record"] * 3 + ["gap"] + ["record"] * 3 and len(kinds) == 7 + bool(rest)
        assert "payload digest differs" in found[3][3]
    rnd = random.Random(5)
    noise = [response_record(i, "u", rnd.randbytes(3000)) for i in range(8)]
    whole = member(b"".join(noise), 0)
    for cut in (whole[:15000], whole[:15000] + b"\xff" * 20 + whole[15020:]):  # broken off, and damaged
        found = list(salvage(cut + member(parts[0])))
        got = [x["head"]["warc-record-id"] for w, _, _, x in found if w == "record"]
        assert got[:4] == [f"<urn:x-page:{i}>" for i in range(4)] and got[-1] == "<urn:x-page:0>" and len(got) >= 5
        assert "gap" in [w for w, *_ in found]
    packed = member(b"".join(noise[:2]))
    bad_sum = packed[:-8] + bytes([packed[-8] ^ 1]) + packed[-7:]
    found = list(salvage(bad_sum + member(parts[0])))
    assert [w for w, *_ in found] == ["record", "record", "gap", "record"] and "gzip" in found[2][3]


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "http://d/\r\nX: y", ""), (5, "http://é/", "ü🙂" * 1000), (None, "u", "same"), (5, "twin", "ü🙂" * 1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    write_archives(df, f"{tmp_path}/w")
    got = read_archives(spark, f"{tmp_path}/w").collect()
    assert {r.kind for r in got} == {"record"} and len(got) == len(rows)
    by = {(r.page_id, r.record_type): r for r in got}
    assert by[2, "response"].payload == b"same" and by[1, "revisit"].refers_to == 2 and by[None, "revisit"].refers_to == 2
    assert by[4, "response"].payload_bytes == 0 and by[3, "revisit"].refers_to == 4
    assert by[5, "response"].payload.decode() == "ü🙂" * 1000 and by[1, "revisit"].payload_bytes == 4
    assert hashlib.sha1(b"same").digest() == __import__("base64").b32decode(by[1, "revisit"].payload_digest)
    some = next(p for p in (tmp_path / "w").glob("part*") if p.stat().st_size)
    assert gzip.decompress(some.read_bytes()).startswith(b"WARC/1.1")
    write_archives(df.limit(0), f"{tmp_path}/e")
    assert read_archives(spark, f"{tmp_path}/e").count() == 0


def test_member_that_does_not_end_in_zero(spark, tmp_path):
    big = "x" * (17 << 20)
    write_archives(spark.createDataFrame([(1, "u", big), (2, "v", "y")], "page_id long, url string, html string"), f"{tmp_path}/b")
    got = {r.page_id: r.payload_bytes for r in read_archives(spark, f"{tmp_path}/b", payloads=False).collect()}
    assert got == {1: len(big), 2: 1}
