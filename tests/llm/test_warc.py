import base64
import gzip
import hashlib
import io

import pytest

from quire.llm import warc

b32 = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()


def rows():
    big = "<p>" + "x\r\n\r\nWARC/1.1\r\n" * 40000
    return [(5, "u5", "same"), (3, "u3", "same"), (9, "u9", "same"), (9, "u9", "same"), (1, None, None), (2, "http://é\r\nX: y", ""), (None, "n", "same"), (None, "m", "only null"), (7, "u7", big), (8, "u8", big), (3, "u3", "same"), (11, "u", "café ☕")]


@pytest.mark.parametrize("roll", [1, 1 << 20])
@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, roll, least):
    df = spark.createDataFrame([(*r, 1) for r in rows()], "page_id long, url string, html string, refers_to int")
    folder = f"file://{tmp_path}/warc"
    archives = warc.write_archives(warc.plan_records(df, least), folder, roll)
    got = sorted((tuple(r)[:6] for r in warc.read_archives(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").collect()), key=str)
    want = []
    for p, _, h in rows():
        data = (h or "").encode()
        ids = [q for q, _, x in rows() if (x or "").encode() == data and q is not None]
        first = min(ids) if ids else None
        again = len(data) >= least and p != first
        want.append((p, len(data), b32(data), "revisit" if again else "response", first if again else None, None if again else data))
    assert got == sorted(want, key=str)
    assert archives.agg({"records": "sum"}).collect()[0][0] == len(rows())


@pytest.mark.parametrize("read", [1, 7, 1 << 16])
def test_every_record_is_a_member_of_its_own(monkeypatch, read):
    monkeypatch.setattr(warc, "READ", read)
    made = [warc.record("response", 1, "u", b"a\r\n\r\n" * 900), warc.record("revisit", 2, "v", b"a", 1), warc.record("response", 3, None, b"")]
    found = list(warc.records(io.BytesIO(b"".join(made))))
    assert [r["payload"] for r in found] == [b"a\r\n\r\n" * 900, b"", b""] and [r["warc-type"] for r in found] == ["response", "revisit", "response"]
    assert all(gzip.decompress(m).startswith(b"WARC/1.1\r\n") for m in made)


def test_damage_is_an_error():
    whole = warc.record("response", 1, "u", b"hello" * 50)
    raw = gzip.decompress(whole)
    bad = [whole[:-9], b"no gzip", *map(gzip.compress, (raw.replace(b"hello", b"jello", 1), raw.replace(b"Content-Length: 3", b"Content-Length: 2"), raw.replace(b"Content-Length: ", b"Content-Size: "), raw[:-1], raw + b"x", b"x" + raw, b"WARC/1.1\r\n", b""))]
    for data in bad:
        with pytest.raises(warc.DamagedArchive):
            list(warc.records(io.BytesIO(data)))
    with pytest.raises(warc.DamagedArchive):
        list(warc.records(io.BytesIO(gzip.compress(b"WARC/1.1\r\nX: " + b"y" * warc.MOST_HEAD + raw))))


def test_shared_folder_names_its_file_system(spark):
    from quire.llm.common import shared_dir

    assert shared_dir(spark).startswith("file:///")


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    archives = warc.write_archives(warc.plan_records(df), f"file://{tmp_path}/w")
    assert warc.read_archives(archives, f"file://{tmp_path}/w").count() == 0
