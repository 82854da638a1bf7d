import hashlib

from retail_lake.llm import warc
from retail_lake.llm.files import new_folder

LONG = "é" * 600
PAGES = [
    (1, "http://www.b.example/x?q=1", LONG, "a"),
    (2, "http://b.example/y", LONG, "b"),
    (3, "http://a.example/", "short", "c"),
    (4, "http://a.example/", "short", "d"),
    (5, None, None, "e"),
    (None, "not a url", LONG, "f"),
    (2, "http://b.example/y", LONG, "g"),
    (6, "http://[bad", "", "h"),
    (7, "http://a.example/line\nbreak", "x", "i"),
]
SCHEMA = "page_id long, url string, html string, key string"


def expected(pages):
    out = []
    for page_id, url, html, _ in pages:
        raw = (html or "").encode()
        same = [p for p, _, h, _ in pages if (h or "").encode() == raw and p is not None]
        keeper = max(same, default=None) if len(raw) >= 1_000 else None
        first = keeper is None or keeper == page_id
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "response" if first else "revisit", None if first else keeper))
    return sorted(out, key=str)


def test_archive_gives_every_record_back(spark):
    got = warc.archive(spark.createDataFrame(PAGES, SCHEMA)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"
    )
    rows = got.collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == expected(PAGES)
    assert {bytes(r["payload"]).decode() for r in rows if r["record_type"] == "response"} == {LONG, "short", "", "x"}


def test_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lookup_reads_only_blocks_that_can_hold_the_key(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example/{i % 40}", "x", "k") for i in range(500)], SCHEMA)
    folder = new_folder(spark, "warc")
    captures = warc.write_archives(warc.with_revisits(pages, "page_id", "url", "html"), folder)
    directory = warc.build_index(captures, folder, lines=8)
    assert directory.count() > 50
    wanted = ["example,h3)/3", "example,h0)/0", "nowhere"]
    keys = spark.createDataFrame([(k,) for k in [*wanted, wanted[0]]], "k string")
    got = sorted(r["page_id"] for r in warc.lookup(keys, "k", directory, folder).collect())
    assert got == [i for i in range(500) if warc.url_key(f"http://h{i % 7}.example/{i % 40}") in wanted]


def test_url_keys():
    assert warc.url_key("HTTP://Blog.Example.com:8080/a?b#c") == "com,example,blog:8080)/a?b"
    assert warc.url_key("http://x.org") == "org,x)/"
    assert warc.url_key(None) == "" and warc.url_key("plain") == "plain"
