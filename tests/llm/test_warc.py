"""Op 5: exact round trip, and DuckDB's view of which page is the response."""

import base64
import collections
import gzip
import hashlib

import pyarrow.fs as pafs

from riskweave.llm import queries, warc

from ..conftest import SF_ORACLE


def expected(pages, min_bytes=0):
    groups = collections.defaultdict(list)
    for p, _, html in pages:
        groups[html or ""].append(p)
    out = []
    for p, _, html in pages:
        data = (html or "").encode()
        least = min((x for x in groups[html or ""] if x is not None), default=None)
        again = len(data) >= min_bytes and len(groups[html or ""]) > 1 and least is not None and p != least
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", least if again else None))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF_ORACLE}/pages.parquet").select("page_id", "url", "html").collect()]
    assert rows(queries.QUERIES["op5_warc"](spark, SF_ORACLE)) == expected(pages)


def edge_pages(spark):
    pages = [(5, "http://a/\nx", "same"), (3, None, "same"), (3, "u", "same"), (9, "u", None), (8, "é", ""), (None, "n", "same"),
             (7, "big", "ünï" * 200_000), (None, "w", "alone"), (2, "hdr", "a\r\n\r\nb\r\n\r\n")]
    return pages, spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, payload int, sha string").repartition(3)


def test_edges_and_pushdown(spark, tmp_path):
    pages, df = edge_pages(spark)
    path = f"file://{tmp_path}/arc"
    back = warc.archive_pages(df, path)
    assert rows(warc.page_digest(back)) == expected(pages)
    assert sorted(bytes(r.payload) for r in back.where("record_type = 'response'").collect()) == sorted(
        (h or "").encode() for (p, _, h), e in zip(sorted(pages, key=str), sorted(pages, key=str)) if (p, h) not in ((5, "same"), (None, "same"), (9, None)))
    heads = warc.read_warc(spark, path, payload=False)
    assert rows(heads.select("record_id", "payload_bytes")) == rows(back.select("record_id", "payload_bytes"))
    only = warc.read_warc(spark, path, payload=False, where="record_type = 'revisit' and record_id = 'urn:page:5'")
    assert [r.refers_to for r in only.collect()] == ["urn:page:3"] and only.where("refers_to = 'x'").count() == 0 and only.count() == 1
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan, plan
    assert warc.read_warc(spark, path, where="target_uri is null").count() == 1
    assert warc.read_warc(spark, path, False, "record_type in ('response')").count() == 6
    assert heads.where("record_type = 'revisit'").count() == 3 and heads.count() == len(pages)


def test_reader_filters():
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNull, Not

    r = warc._WarcReader({"path": "x", "pushdown": "true"})
    left = list(r.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_bytes",), 3), Not(EqualTo(("target_uri",), "u")), IsNull(("refers_to",))]))
    assert len(left) == 2
    assert r.wanted({"warc-type": "response"}) and not r.wanted({"warc-type": "revisit"})
    assert not r.wanted({"warc-type": "response", "warc-refers-to": "<x>"})


def test_members_are_gzip(tmp_path):
    rec = warc.record("response", "urn:page:1", "http://x", warc.base32_sha1(b"abc"), None, b"abc" * 1000)
    assert gzip.decompress(warc.member(rec)) == rec


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.page_digest(warc.archive_pages(empty, f"file://{tmp_path}/none")).collect() == []


def test_only_committed_files_are_read(spark, tmp_path):
    pages, df = edge_pages(spark)
    path = f"file://{tmp_path}/arc"
    warc.write_warc(warc.page_records(df), path)
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_output_stream(f"{at}/part-failed.warc.gz", compression=None) as f:
        f.write(b"half a file of a lost attempt")
    assert warc.read_warc(spark, path).count() == len(pages)
