import gzip
import hashlib

from pyspark.sql import functions as F

from tracemark.llm import warc as W

IMAGE = bytes(range(256)) * 40
BODIES = [b"", b"a\n\nb", b"x" * 3000, "é".encode(), b"http://x 0.0.0.0 1 text/html 3\nabc", IMAGE, b"HTTP/1.0 200 OK\r\n\r\nhi"]


def made(version, bodies=BODIES):
    return [W.arc_record(version, b, f"http://a b/{i}", "1.2.3.4", "20010203040506", None, None, f"crawl-{i}.arc.gz") for i, b in enumerate(bodies)]


def good(data):
    return [r for r in W.parse_arc(data) if r["kind"] and r["kind"] != "warcinfo"]


def test_arc_versions():
    for version in (1, 2):
        data = W.version_block(version) + b"".join(made(version))
        for packed in (data, gzip.compress(data), gzip.compress(W.version_block(version)) + b"".join(map(gzip.compress, made(version)))):
            got = list(W.parse_arc(packed))
            assert got[0]["kind"] == "warcinfo" and got[0]["payload"].startswith(f"{version} 0 Archive".encode()) and not any(r["problem"] for r in got)
            got = got[1:]
            assert [r["payload"] for r in got] == BODIES and [r["url"] for r in got] == [f"http://a b/{i}" for i in range(7)]
            assert [r["name"] for r in got] == ([None] * 7 if version == 1 else [f"crawl-{i}.arc.gz" for i in range(7)]) and {r["version"] for r in got} == {version}
        assert list(W.parse_arc(b"")) == []
    assert W.iso_date("20010203040506") == "2001-02-03T04:05:06Z" and W.iso_date("200102030405") == "2001-02-03T04:05:00Z"
    assert W.iso_date(None) == W.iso_date("20019999") == "1970-01-01T00:00:00Z" and W.iso_date("1996") == "1996-01-01T00:00:00Z"
    assert [r["kind"] for r in W.parse_arc(W.version_block(1) + W.arc_record(1, b"1.2.3.4", "dns:a.b"))] == ["warcinfo", "resource"]


def test_what_is_broken_is_set_aside():
    for version in (1, 2):
        parts = made(version)
        whole = W.version_block(version) + b"".join(parts)
        # a bad header line, in the middle and with its record
        bad = W.version_block(version) + parts[2] + b"no header at all\n" + b"some\nbytes\n" + parts[3] + parts[5]
        got = list(W.parse_arc(bad))
        assert [r["payload"] for r in got if r["kind"] == "response"] == [BODIES[2], BODIES[3], BODIES[5]]
        assert [(r["payload"], r["offset"]) for r in got if r["problem"]] == [(b"no header at all\nsome\nbytes\n", bad.index(b"no header"))]
        # a length that runs over the end: the records within are found
        long = parts[2].replace(b" 3000\n", b" 999999\n")
        got = list(W.parse_arc(W.version_block(version) + long + parts[3] + parts[5]))
        assert [r["payload"] for r in got if r["kind"] == "response"] == [BODIES[3], BODIES[5]] and sum("999999" in (r["problem"] or "") for r in got) == 1
        # a cut archive
        assert [r["payload"] for r in good(whole[:-20])] == BODIES[:-1]
        cut = list(W.parse_arc(gzip.compress(whole)[:-30]))
        assert any("damaged" in (r["problem"] or "") for r in cut)
        # no version block, or other records than it says
        assert [r["kind"] for r in W.parse_arc(parts[1])] == [None] and not good(W.version_block(version) + made(3 - version)[1])
    changed = W.version_block(2) + made(2)[2].replace(b"xxx", b"xyx", 1)
    assert [r["problem"] for r in good(changed)] == ["checksum differs"] and len(good(changed)[0]["payload"]) == 3000
    assert W.intact("sha1:" + hashlib.sha1(b"a").hexdigest(), b"a") and W.intact(hashlib.md5(b"a").hexdigest(), b"a") and W.intact("odd", b"a") is None and W.intact(None, b"a") is None
    assert [h and h["warc-type"] for h, _ in W.parse_warc(b"junk\nWARC/1.0\r\nwarc-type: metadata\r\n of it\r\nContent-Length: 2\r\n\r\nab\r\n\r\nWARC/1.0\r\nContent-Length: 900\r\n\r\nx")] == [None, "metadata of it", None]


def test_archives_of_others(spark, tmp_path):
    (tmp_path / "arc").mkdir()
    for version in (1, 2):
        broken = b"oops this is no header\n" + b"\x00\xff\n"
        data = W.version_block(version, "20100101000000") + b"".join(made(version)) + broken + b"".join(made(version, [IMAGE]))
        (tmp_path / "arc" / f"crawl-{version}.arc.gz").write_bytes(gzip.compress(data))
    (tmp_path / "arc" / "not.arc").write_bytes(b"\x00\x01 not an archive")
    aside = W.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"), file_bytes=6000)
    assert sorted(r["file"].rsplit("/", 1)[1] for r in aside.collect()) == ["crawl-1.arc.gz", "crawl-2.arc.gz", "not.arc"]
    rows = W.read_warc(spark, str(tmp_path / "warc"), "part-*").collect()
    types = [r["record_type"] for r in rows]
    # x 3000 and the image are in both archives, the image twice in each: one response of each
    assert len(rows) == 18 and types.count("warcinfo") == 2 and types.count("revisit") == 4 and types.count("response") == 12
    by = {r["record_id"]: r for r in rows}
    assert len(by) == 18
    for r in rows:
        if r["record_type"] == "revisit":
            assert r["payload"] == b"" and hashlib.sha1(by[r["refers_to"]]["payload"]).hexdigest() == r["declared_digest"]
        elif r["record_type"] == "response":
            assert hashlib.sha1(r["payload"]).hexdigest() == r["declared_digest"] and len(r["payload"]) == r["declared_bytes"]
    assert {bytes(r["payload"]) for r in rows if r["record_type"] == "response"} == set(BODIES)
    pages = W.read_pages(spark, str(tmp_path / "warc")).collect()
    assert len(pages) == 16 and all(r["page_id"] is None for r in pages)  # names that are no numbers
    assert sorted(r["payload_bytes"] for r in pages) == sorted([len(b) for b in BODIES] * 2 + [len(IMAGE)] * 2)
    # files are bounded by bytes
    files = [gzip.decompress(p.read_bytes()) for p in (tmp_path / "warc").glob("part-*")]
    assert len([f for f in files if f]) >= 4 and all(len(f) < 6000 or sum(h is not None for h, _ in W.parse_warc(f)) == 1 for f in files)


def test_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 600
    pages = [(1, "http://a/1", big), (2, None, big), (5, "http://a/5", big + "x"), (3, "u v", ""), (4, "", None), (6, "http://s", "small"), (7, "http://s", "small"),
             (8, "http://n", "\r\n\r\nWARC/1.0\r\n" * 90), (9, "http://l", "long " * 400_000), (10, "http://a/1", big), (11, "dns", "a" * 999), (12, "dns", "a" * 999)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("size", F.lit(1))
    got = {r["page_id"]: r for r in W.op9(df).collect()}
    assert len(got) == len(pages)
    for i, _, html in pages:
        data = (html or "").encode()
        assert got[i]["payload_bytes"] == len(data) and got[i]["payload_digest"] == hashlib.sha1(data).hexdigest()
    assert {i: r["refers_to"] for i, r in got.items() if r["record_type"] == "revisit"} == {1: 10, 2: 10}
    assert W.op9(df.limit(0)).isEmpty()


def test_repeated_and_null_ids(spark):
    big = "y" * 2000
    rows = [(1, "u", big), (1, "u", big), (None, "u", big), (None, None, None), (3, "v", "z")]
    got = W.op9(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(((r["page_id"] or 0), r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in got) == [
        (0, "response", 0, 0), (0, "revisit", 1, 2000), (1, "response", 0, 2000), (1, "revisit", 1, 2000), (3, "response", 0, 1)]


def test_many_records_in_a_task(spark, tmp_path):
    df = spark.range(0, 5000, 1, 1).select(F.col("id").alias("page_id"), F.concat(F.lit("http://p/"), "id").alias("url"), F.repeat(F.lit("w "), (F.col("id") % 700).cast("int")).alias("html"))
    W.write_arc(df, str(tmp_path / "arc"), file_bytes=100_000)
    assert len(list((tmp_path / "arc").glob("part-*"))) > 20
    W.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"), file_bytes=300_000)
    got = W.read_pages(spark, str(tmp_path / "warc"))
    assert got.count() == 5000 and got.agg(F.sum("payload_bytes")).first()[0] == sum(i % 700 * 2 for i in range(5000))
    assert got.filter("record_type = 'revisit'").count() == sum(i % 700 >= 500 for i in range(5000)) - 200
