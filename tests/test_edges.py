import json

import pytest

from stellwerk.sinks import back_up, write_csv
from stellwerk.sources import markup, pages, recorded


def test_anchors():
    page = '<a href="/jobs/koch-1" aria-label="Koch"><b>x</b></a><a href="/jobs/x/y">no</a><a href="/jobs/hilfe-2">Hilfe<br> gern &amp; bald</a><a href="/jobs/leer-3"></a>'
    assert markup.linked(page, "XI") == [("koch-1", "Koch", "/jobs/koch-1"), ("hilfe-2", "Hilfe gern & bald", "/jobs/hilfe-2")]
    assert markup.linked('<a href="/rc?jk=ab1">A</a><a href="/x?a=b&jk=ab1">A</a>', "ID") == [("ab1", "A", "/rc?jk=ab1")]
    assert markup.linked('<a href="/stellenangebote--koch-77-inline.html">K</a>', "SS")[0][0] == "77" and markup.linked(None, "XI") == []


def test_cards(spark):
    page = '<article class="aditem" data-adid="5" data-href="/s-anzeige/x"><div class="aditem-main--top--left"><i></i> 85051 Ort </div><a class="ellipsis" href="#">Aushilfe</a><p class="aditem-main--middle--description">520 € Basis<br>gern</p></article><article class="aditem" data-adid="6" data-href="/s-gesuch/y"><a class="ellipsis">Suche</a></article><a class="pagination-next" href="/s2">n</a>'
    assert markup.cards(page)[1] == "/s2"
    df = spark.createDataFrame([(page,), (None,)], "html string")
    got = markup.card_postings(df, "https://b").collect()
    assert [(r.job_id, r.plz, r.city, r.is_minijob, r.source_url) for r in got] == [("KA:5", "85051", "Ort", True, "https://b/s-anzeige/x")]
    assert markup.link_postings(spark.createDataFrame([('<a href="/jobs/w-1">Werkstudent</a>',)], "html string"), "XI", "https://x").collect()[0].is_werkstudent


def test_sources(spark, tmp_path):
    for source, query, page, payload in [("BA", 0, 1, {"ergebnisliste": [{"referenznummer": "1", "stellenangebotsTitel": "Praktikum", "arbeitszeitTeilzeitNeu": True, "stellenlokationen": {"adresse": {"plz": 123, "ort": "O"}}}]}), ("BA", 0, 2, {}), ("KA", 0, 1, {"x": 1})]:
        p = tmp_path / source / f"{query}-{page}.json"
        p.parent.mkdir(exist_ok=True)
        p.write_text(json.dumps(payload))
    recorded.register(spark)
    df = spark.read.format("recorded_pages").option("path", str(tmp_path)).load()
    assert df.count() == 3 and df.filter("source = 'BA'").count() == 2 and df.count() == 3
    assert spark.read.format("recorded_pages").option("path", str(tmp_path)).option("sources", "KA").load().count() == 1
    got = pages.agency_postings(df, ["source"]).drop("source").collect()
    assert len(got) == 1 and got[0].is_parttime and got[0].is_internship and got[0].plz == "123" and got[0].employment_type_raw == "Teilzeit"
    assert [s for s, _, why in recorded.registry() if why is None] == ["BA", "AN", "KA", "XI"]
    with pytest.raises(ValueError, match="QQ"):
        recorded.registry(["QQ"])


def test_queries_of_sources(spark):
    q = pages.agency_queries(["A", "B"], ["Koch", " "], ["minijob", "werkstudent"])
    assert len(q) == 4 and q[1] == {"was": "Koch werkstudent", "wo": "A", "umkreis": 25, "arbeitszeit": None} and q[0]["arbeitszeit"] == "mj"
    assert pages.agency_queries(["A"], [], []) == [{"was": None, "wo": "A", "umkreis": 25, "arbeitszeit": None}]
    assert [r.url for r in pages.board_urls(spark, "https://x", ["München"], ["parttime"], ["Koch"]).collect()] == ["https://x/jobs/teilzeit-muenchen", "https://x/jobs/koch-muenchen"]


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("b", 'x "y"\nz', None), ("a", "ä,1", 2)], "k string, t string, n int")
    path = tmp_path / "out.csv"
    write_csv(df, str(path), ["k", "t", "n"], ["k"])
    assert path.read_bytes().startswith(b"\xef\xbb\xbfk,t,n\n") and path.read_text(encoding="utf-8-sig").splitlines()[1] == 'a,"ä,1",2'
    write_csv(df.limit(0), str(tmp_path / "none.csv"), ["k"])
    assert (tmp_path / "none.csv").read_bytes() == b"\xef\xbb\xbfk\n"
    write_csv(df.filter("n = 2"), str(path), ["k", "t", "n"], append=True)
    assert path.read_text(encoding="utf-8-sig").count("k,t,n") == 1
    for k in range(7):
        assert back_up([str(path), str(tmp_path / "missing")], str(tmp_path / "b"), f"2026-01-0{k}") == ["out.csv"]
    assert sorted(p.name for p in (tmp_path / "b").iterdir()) == [f"2026-01-0{k}" for k in range(2, 7)]
