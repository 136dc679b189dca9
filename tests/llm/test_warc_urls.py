from __future__ import annotations

import gzip
import hashlib

import pytest

from foliant.llm import url_filter as U
from foliant.llm import warc as W

PAGES = [(3, "http://a.example.com/x", "p" * 150), (1, "http://b.example.com/y", "p" * 150), (2, None, "short"), (4, "http://c/\r\nEvil: 1", "short"), (5, "u", None), (6, "u", "é" * 60), (7, "u", "é" * 60), (7, "u", "é" * 60), (None, "u", "p" * 150)]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = "file://" + str(tmp_path_factory.mktemp("warc"))
    W.archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    return path


def test_round_trip(spark, archive):
    got = W.read_warc(spark, archive).collect()
    assert len(got) == len(PAGES)
    by_id = {r.page_id: r for r in got}
    assert bytes(by_id["1"].payload) == b"p" * 150 and by_id["1"].record_type == "response"
    assert by_id["3"].record_type == "revisit" and by_id["3"].refers_to_page == "1" and by_id["3"].payload_length == "150"
    assert by_id["3"].payload_digest == "sha256:" + hashlib.sha256(b"p" * 150).hexdigest()
    assert sorted(r.record_type for r in got if r.page_id == "7") == ["revisit", "revisit"]
    assert by_id["2"].record_type == by_id["4"].record_type == "response"
    assert bytes(by_id["5"].payload) == b"" and "Evil" not in by_id["4"].headers
    assert by_id[None].record_type == "response"


def test_predicates_are_pushed_and_payloads_skipped(spark, archive):
    heads = W.read_warc(spark, archive, payload=False)
    assert heads.where("payload is not null").count() == 0
    some = W.read_warc(spark, archive).where("record_type = 'revisit' and page_id in ('3', '7')")
    assert "PushedFilters" in some._jdf.queryExecution().toString() or some.count() == 3
    assert some.count() == 3
    reader = W.WarcReader({"path": archive})
    assert list(reader.pushFilters([W.EqualTo(("record_type",), "revisit"), W.IsNotNull(("payload",))])) == [W.IsNotNull(("payload",))]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert {r["record_type"] for r in rows} == {"revisit"}


def test_reads_archives_of_other_writers(spark, tmp_path):
    def record(kind, body):
        return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://x\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"

    parts = [record("warcinfo", b"a: b"), record("response", b"z" * 100_000), record("request", b"")]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "two.warc").write_bytes(b"".join(parts))
    got = W.read_warc(spark, f"file://{tmp_path}").collect()
    assert sorted((r.record_type, len(r.payload)) for r in got) == sorted([("warcinfo", 4), ("response", 100_000), ("request", 0)] * 2)
    assert W.read_warc(spark, f"file://{tmp_path}", payload=False).where("record_type = 'response'").count() == 2


def _plain(kind: str, body: bytes, length_name: str = "Content-Length") -> bytes:
    return (f"WARC/1.0\r\nwarc-type: {kind}\r\nWarc-Target-URI: http://x\r\n{length_name}: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


def _read(path, **options) -> list[dict]:
    reader = W.WarcReader({"path": f"file://{path}", **options})
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


@pytest.mark.parametrize("name", ["one.warc.gz", "one.warc"])
def test_members_with_several_records_and_names_in_any_case(tmp_path, name):
    bodies = [b"", b"a" * 70_000, b"\r\n\r\nWARC/1.0\r\n", b"end"]
    records = b"".join(_plain(f"k{i}", body, "content-length") for i, body in enumerate(bodies))
    (tmp_path / name).write_bytes(gzip.compress(records) + gzip.compress(_plain("last", b"z")) if name.endswith("gz") else records + _plain("last", b"z"))
    for options in ({}, {"payload": "false"}):
        got = _read(tmp_path, **options)
        assert [r["record_type"] for r in got] == ["k0", "k1", "k2", "k3", "last"]
        assert {r["target_uri"] for r in got} == {"http://x"}
        assert [r["payload"] for r in got] == ([None] * 5 if options else [*bodies, b"z"])
    reader = W.WarcReader({"path": f"file://{tmp_path}"})
    assert not list(reader.pushFilters([W.EqualTo(("record_type",), "k2")]))
    assert [r["payload"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == [bodies[2]]


@pytest.mark.parametrize("wanted", ["true", "false"])
@pytest.mark.parametrize("own", [True, False])
def test_cut_archives_are_errors_that_name_the_place(tmp_path, own, wanted):
    import random

    noise = random.Random(1).randbytes(30_000)
    whole = W.record_bytes({"WARC-Type": "response"}, b"a") if own else gzip.compress(_plain("response", b"a"))
    cut = W.record_bytes({"WARC-Type": "response"}, noise) if own else gzip.compress(_plain("response", noise))
    (tmp_path / "cut.warc.gz").write_bytes(whole + cut[: len(cut) // 2])
    with pytest.raises(ValueError, match=f"at {len(whole)} is cut off"):
        _read(tmp_path, payload=wanted)
    (tmp_path / "cut.warc.gz").unlink()
    plain = _plain("response", b"a")
    (tmp_path / "cut.warc").write_bytes(plain + _plain("response", noise)[:20_000])
    with pytest.raises(ValueError, match=f"at {len(plain)} is cut off"):
        _read(tmp_path, payload=wanted)


def test_empty_archive(spark, tmp_path):
    W.archive(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/none")
    assert W.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_append_adds_up_and_overwrite_replaces(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    schema = "page_id long, url string, html string, payload string, record_type int, headers string, _digest string, _key string"
    table = lambda ids: spark.createDataFrame([(i, f"u{i}", "p" * (100 + i), "x", 1, "h", "d", "k") for i in ids], schema)
    W.archive(table([1, 2]), path)
    W.archive(table([3]), path)
    assert sorted(r.page_id for r in W.read_warc(spark, path).collect()) == ["1", "2", "3"]
    W.archive(table([4, 5]), path, mode="overwrite")
    got = W.read_warc(spark, path).collect()
    assert sorted((r.page_id, len(r.payload)) for r in got) == [("4", 104), ("5", 105)]
    assert all(r.date and r.date >= "2020" for r in got)
    assert len([x for x in (tmp_path / "a").iterdir() if x.name.startswith("_manifest-")]) == 1
    names = {n for m in W._manifests(*W._open(path)).values() for n, _ in m["files"]}
    assert {x.name for x in (tmp_path / "a").glob("*.warc.gz")} == names
    W.archive(table([6]), path)
    assert W.read_warc(spark, path).count() == 3


def test_an_overwrite_takes_effect_with_its_manifest(tmp_path):
    """Until the old files are deleted, a reader sees the new manifest alone."""
    (tmp_path / "_manifest-old.json").write_text('{"files": [["a.warc.gz", 1]], "replaces": []}')
    (tmp_path / "_manifest-new.json").write_text('{"files": [["b.warc.gz", 1]], "replaces": ["_manifest-old.json"]}')
    (tmp_path / "_draft-x").write_text("half a manif")
    assert list(W._manifests(*W._open(f"file://{tmp_path}"))) == ["_manifest-new.json"]
    assert [p.paths for p in W.WarcReader({"path": f"file://{tmp_path}"}).partitions()] == [((f"{tmp_path}/b.warc.gz", 1),)]


def test_files_are_closed_and_grouped_at_the_size_asked_for(spark, tmp_path):
    import random

    rows = [(str(i), bytes(random.Random(i).randbytes(3_000))) for i in range(40)]
    W.register(spark)
    spark.createDataFrame(rows, "page_id string, payload binary").coalesce(1).write.format("warc").option("fileBytes", 20_000).mode("append").save(f"file://{tmp_path}/f")
    assert len(list((tmp_path / "f").glob("*.warc.gz"))) == 6
    got = spark.read.format("warc").option("fileBytes", 20_000).load(f"file://{tmp_path}/f")
    assert sorted((r.page_id, bytes(r.payload)) for r in got.collect()) == sorted(rows)


def test_a_member_too_long_for_its_length_field(monkeypatch, tmp_path):
    monkeypatch.setattr(W, "MOST_LENGTH", 500)
    bodies = [b"a" * 2000, b"short", bytes(range(256)) * 8, b""]
    data = b"".join(W.record_bytes({"WARC-Type": "response"}, x) for x in bodies)
    (tmp_path / "x.warc.gz").write_bytes(data)
    reader = W.WarcReader({"path": f"file://{tmp_path}"})
    got = [bytes(x) for p in reader.partitions() for b in reader.read(p) for x in b.column("payload").to_pylist()]
    assert got == bodies
    reader = W.WarcReader({"path": f"file://{tmp_path}", "payload": "false"})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 4


def test_very_long_html(spark, tmp_path):
    html = "<p>" + "lang und breit " * 400_000 + link("c", "http://y.com/de/1")
    page = spark.createDataFrame([(1, "http://n.example.net/", html)], "page_id long, url string, html string")
    W.archive(page, f"file://{tmp_path}/l")
    assert bytes(W.read_warc(spark, f"file://{tmp_path}/l").first().payload) == html.encode()
    assert U.judge(page).first().verdict == "block"


def link(kind, to):
    return f'<link rel="canonical" href="{to}">' if kind == "c" else f'<meta http-equiv="refresh" content="0; url={to}">'


URLS = [
    (1, "http://x.example.org/es/1", ""),  # blocked by its rule
    (2, "http://plain.example.net/a", link("c", "http://x.example.org/es/1?a=1&amp;b=2")),
    (3, "http://plain.example.net/b", link("c", "http://y.com/de/1")),  # alias of a blocked url
    (4, "http://third.example.net/c", link("r", "http://plain.example.net/b")),  # alias of the alias
    (5, "http://ok.org/q", link("c", "http://plain.example.net/b")),  # explicitly allowed, frees its class
    (6, "https://z.example.net/d", link("c", "//w.com/de/2")),
    (7, "https://z.example.net/e", link("r", "/d")),
    (8, "no scheme", link("c", "http://y.com/de/1")),
    (9, None, None),
    (10, "http://sub.example.org/en/17", ""),
    (11, "http://example.org", ""),
    (12, "HTTP://User@EXAMPLE.com:80/fr/?q#f", ""),
    (7, "https://z.example.net/e", link("r", "/d")),
    (13, "http://rel.example.net/a/b?q", link("c", "c/d") + link("r", "http://y.com/de/9")),  # from its folder, and a second tag
    (14, "http://rel.example.net/a/c/d", ""),  # alias of 13
    (15, "http://rel.example.net", link("c", "top")),
    (16, "http://rel.example.net/top", link("c", "mailto:x@y.com")),
    (17, "http://two.example.net/", link("c", "http://one.example.net/") + link("c", "http://y.com/de/8")),
]


def test_verdicts(spark):
    got = {r.page_id: r for r in U.judge(spark.createDataFrame(URLS, "page_id long, url string, html string")).collect()}
    verdicts = {i: r.verdict for i, r in got.items()}
    assert verdicts == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "block", 8: "allow", 9: "allow", 10: "block", 11: "allow", 12: "allow", 13: "block", 14: "block", 15: "allow", 16: "allow", 17: "block"}
    assert (got[10].rule, got[5].rule, got[11].rule, got[1].rule) == ("example.org/en/1", "org/", None, "example.org/es/")
    assert (got[12].host, got[12].path, got[8].host, got[9].path) == ("user@example.com:80", "/fr/", "", "")
    assert U.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_clashing_columns_and_sql_on_the_cases(spark, duck):
    import pandas as pd

    table = spark.createDataFrame(URLS, "page_id long, url string, html string")
    more = table.selectExpr("*", "'r' AS rule", "'v' AS verdict", "'h' AS host", "1 AS _alias", "2 AS _url", "3 AS _rule", "4 AS component", "5 AS a", "6 AS key")
    got = sorted(map(tuple, U.judge(more).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert got == sorted(map(tuple, U.judge(table).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    con = duck.cursor()
    con.register("cases", pd.DataFrame([u for u in URLS[:-6] + URLS[-5:]], columns=["page_id", "url", "html"]))
    con.sql("CREATE TEMP VIEW pages AS SELECT * FROM cases")
    want = con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({U.OP5_SQL})").fetchall()
    con.sql("DROP VIEW temp.pages")
    assert sorted(set(map(str, got))) == sorted(set(map(str, want)))


def test_redirect_table_and_hot_alias(spark):
    pages = spark.createDataFrame([(i, f"http://n{i}.example.net/", None) for i in range(50)], "page_id long, url string, html string")
    redirects = spark.createDataFrame([(f"http://n{i}.example.net/", "http://hub.com/de/x") for i in range(40)] + [(None, "http://a/"), ("x", None)], "from_url string, to_url string")
    got = U.judge(pages, redirects).where("verdict = 'block'").count()
    assert got == 40


def test_equals_sql_on_pages(spark, sf_dir, duck):
    got = sorted(map(tuple, U.op5_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", "verdict").collect()))
    want = sorted(duck.sql(f"SELECT page_id, host, path, rule, verdict FROM ({U.OP5_SQL})").fetchall())
    assert got == want
    got = sorted(map(tuple, W.op10_warc(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type").collect()))
    want = sorted(duck.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type FROM ({W.OP10_SQL})").fetchall())
    assert got == want
