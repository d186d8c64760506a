import gzip
import io
import json
import zlib

from quire.llm import warc


def index_of(raw, **k):
    sink = io.BytesIO()
    return list(warc.rewrite(lambda: io.BytesIO(raw), sink, "f", **k)), sink.getvalue()


RECORDS = [warc.record(1, "http://a/", "<p>x</p>"), warc.record(None, None, None), warc.record(3, "http://b\r\nX: 1", "é" * 700000), warc.record(1, "http://a/", "<p>x</p>")]


def test_every_member_is_its_record():
    for raw in (gzip.compress(b"".join(RECORDS)), b"".join(map(gzip.compress, RECORDS)), gzip.compress(b"\r\n".join(RECORDS)) + b"\0" * 50):
        rows, out = index_of(raw)
        assert [r["status"] for r in rows] == ["ok"] * 4 and [r["page_id"] for r in rows] == [1, None, 3, 1]
        assert [gzip.decompress(out[r["offset"] : r["offset"] + r["length"]]) for r in rows] == RECORDS
        assert sum(r["length"] for r in rows) == len(out) and gzip.decompress(out) == b"".join(RECORDS)


def test_broken_files():
    whole = gzip.compress(b"".join(RECORDS))
    rows, out = index_of(whole[: len(whole) - 30])
    assert [r["status"] for r in rows][-1] == "truncated" and all(gzip.decompress(out[r["offset"] : r["offset"] + r["length"]]) == x for r, x in zip(rows[:-1], RECORDS))
    assert [r["status"] for r in index_of(gzip.compress(RECORDS[0] + b"rubbish\r\n\r\n"))[0]] == ["ok", "malformed"]
    assert [r["status"] for r in index_of(b"no gzip at all")[0]] == ["malformed"]
    assert index_of(b"")[0] == [] and index_of(gzip.compress(b""))[0] == []


def bodies(raw):
    rows, out = index_of(raw)
    return [(r["status"], gzip.decompress(out[r["offset"] : r["offset"] + r["length"]]) if r["length"] else None) for r in rows]


def test_records_after_a_bad_one_are_kept():
    a, b = RECORDS[0], RECORDS[1]
    ok = [("ok", a), ("ok", b)]
    for bad in (b"rubbish\r\n\r\n", b"WARC/1.0\r\nContent-Length: x\r\n\r\nbody\r\n\r\n", b"WARC/1.0\r\nX: " + b"y" * (3 << 20) + b"\r\n\r\n", b"WARC/1.0\r\nno end of this header\r\n"):
        assert bodies(gzip.compress(a + bad + b)) == [("ok", a), ("malformed", None), ("ok", b)], bad[:30]
    longer = b"WARC/1.0\r\nContent-Length: 2000\r\n\r\nshort\r\n\r\n"  # takes the next ones in
    got = bodies(gzip.compress(a + longer + b + a + b * 20))
    assert got[0] == ("ok", a) and got[1][0] == "malformed" and [g for g in got[2:]] == [("ok", x) for x in (b, a, *[b] * 20)]
    shorter = b"WARC/1.0\r\nContent-Length: 2\r\n\r\nlonger\r\n\r\n"
    got = bodies(gzip.compress(a + shorter + b))
    assert [g[0] for g in got] == ["ok", "malformed", "ok"] and (got[0], got[2]) == (ok[0], ok[1])


def test_line_feeds_and_missing_ends():
    a = RECORDS[0]
    for raw in (a[:-4], a[:-2], a, a + b"\r\n" * 9, a.replace(b"\r\n", b"\n"), a.replace(b"\r\n", b"\n") * 3):
        got = bodies(gzip.compress(raw))
        assert got and all(s == "ok" and gzip.decompress(gzip.compress(x)).endswith(b"<p>x</p>\r\n\r\n") for s, x in got)
    assert len(bodies(gzip.compress(a[:-4] + a[:-4] + a))) == 3


def test_a_file_takes_the_place_of_one_before(tmp_path):
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(b"".join(RECORDS)))
    for _ in range(2):
        rows = list(warc.normalize_file(f"file://{tmp_path}/x.warc.gz", f"file://{tmp_path}/out") if (tmp_path / "out").exists() or not (tmp_path / "out").mkdir() else [])
        assert len(rows) == 4
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["x.warc.gz", "x.warc.gz.idx"]


def test_pages(spark, tmp_path):
    data = [(i, f"http://x/{i}", f"<p>{i}</p>" * 50, "f", 9) for i in range(40)] + [(None, None, None, "f", 9), (7, "http://x/7", "<p>7</p>" * 50, "f", 9)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, file string, seq int").repartition(3)
    paths = warc.write_monolithic(pages, f"file://{tmp_path}/raw", most=4000)
    rows = warc.normalize(paths, f"file://{tmp_path}/out").collect()
    want = sorted(warc.record(*d[:3]) for d in data)
    got = []
    for r in rows:
        with open(tmp_path / "out" / r["file"], "rb") as f:
            f.seek(r["offset"])
            got.append(gzip.decompress(f.read(r["length"])))
    assert sorted(got) == want and len({r["file"] for r in rows}) > 3
    side = [json.loads(x) for p in (tmp_path / "out").glob("*.idx") for x in p.read_text().splitlines()]
    assert sorted((s["file"], s["seq"], s["offset"]) for s in side) == sorted((r["file"], r["seq"], r["offset"]) for r in rows)
    assert not list((tmp_path / "out").glob(".*.gz.*[0-9]"))
    assert warc.normalized_pages(pages.where("false")).count() == 0 and warc.normalized_pages(pages).count() == 42


def test_monolithic_file_is_one_member(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "h") for i in range(5)], "page_id long, url string, html string").coalesce(1)
    (path,) = [r["path"] for r in warc.write_monolithic(pages, f"file://{tmp_path}/raw").collect()]
    z = zlib.decompressobj(31)
    z.decompress(open(path.removeprefix("file://"), "rb").read())
    assert z.eof and not z.unused_data
