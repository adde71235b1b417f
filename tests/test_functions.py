import pytest
from pyspark.sql import functions as F

from stellwerk.functions import contact, dates, geo, html, text


def values(spark, column, inputs):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string")
    return [r[0] for r in df.orderBy("k").select(column).collect()]


DATES = [("2026-07-01", "2026-07-01"), ("2026-06-20T12:20:44Z", "2026-06-20"), ("2026-08-17T00:30:00+02:00", "2026-08-16"), ("2026-08-16T23:59:00", "2026-08-16"), ("20260816", "2026-08-16"), ("2026-08-16 junk", "2026-08-16"), ("2026", None), ("2026-13-45", None), ("0012-05-06", None), ("", None), (None, None), ("1743914954", None)]
PHONES = [("+49 8431 2078", "+4984312078"), ("08431/648595", "+498431648595"), ("004984312078", "+4984312078"), ("+49 8431 2078 (Küche 2)", "+4984312078"), ("08431 2078; 08431 9", "+4984312078"), ("08431 2078 oder 1", "+4984312078"), ("2078", None), ("648595", None), ("+43 664 1234567", "+436641234567"), ("0" * 30, None), ("", None), (None, None)]


def test_published_on(spark):
    got = values(spark, dates.published_on(F.col("x")).cast("string"), [a for a, _ in DATES])
    assert got == [b for _, b in DATES]


def test_phone(spark):
    assert values(spark, contact.phone(F.col("x")), [a for a, _ in PHONES]) == [b for _, b in PHONES]


def test_identity(spark):
    x = F.col("x")
    assert values(spark, text.identity_text(x), ["Werkstudent  Küche (m/w/d)", "Verkäufer(in) ( M / F )", None, "", "STRASSE Straße"]) == ["werkstudent kueche", "verkaeufer(in)", "", "", "strasse strasse"]
    assert values(spark, text.identity_city(x), ["Ingolstadt, Donau", None]) == ["ingolstadt", ""]
    assert values(spark, text.slug(x), [" München am  See - x ", "a--b"]) == ["muenchen-am-see-x", "a-b"]
    assert values(spark, text.content_hash(x), ["", "  ", None]) == [None] * 3


def test_signals(spark):
    got = values(spark, F.array_join(text.type_signals(F.col("x")), ","), ["Aushilfe auf 556 €", "Werkstudent (Teilzeit)", "Koch", None, "Praktikum Full-Time"])
    assert got == ["minijob", "werkstudent,parttime", "", "", "internship,fulltime"]


def test_german(spark):
    assert values(spark, text.reads_as_german(F.col("x")), ["Wir sind ein Team und suchen dich", "a Werkstudent role, paid as a Minijob", None, "", "und und und"]) == [True, False, False, False, False]


def test_postcode(spark):
    got = values(spark, text.postcode_and_city(F.col("x")), ["85053 Ingolstadt", "Ingolstadt", None, "850531 X", " 85053  A B"])
    assert [(r.plz, r.city) for r in got] == [("85053", "Ingolstadt"), (None, "Ingolstadt"), (None, None), (None, "850531 X"), ("85053", "A B")]


def test_markup(spark):
    x = F.col("x")
    page = "<style>p{}</style><SCRIPT>var a;</SCRIPT><p>A &amp; B&nbsp;C</p>"
    assert values(spark, html.html_text(x), [page, None, ""]) == ["A & B C", None, ""]
    assert values(spark, html.readable_text(x), [page, "<p>" + "a" * 80]) == [None, "a" * 80]
    assert values(spark, html.login_wall(x), ["Please LOG IN", "<form class=x action='/login'>", "Anzeige"]) == [True, True, False]
    assert values(spark, contact.email(x), ['<a href="MAILTO:Info@X.de">', "chef (at) laden [dot] de", "bild@2x.png agentur@x.de", None]) == ["info@x.de", "chef@laden.de", None, None]


def test_jsonld(spark):
    block = '<script type="application/ld+json">%s</script>'
    page = block % "{broken" + block % '{"@graph": [{"@type": ["Thing", "JobPosting"], "title": "T", "hiringOrganization": [{"name": "C"}], "jobLocation": {"address": [{"addressLocality": "O"}]}, "datePosted": "2026-01-02T03:04"}]}' + block % '[{"@type": "jobposting"}]'
    got = values(spark, html.jsonld_postings(F.col("x")), [page, None])
    assert [tuple(p) for p in got[0]] == [("T", "C", "O", "2026-01-02", None, None), (None, None, None, None, None, None)] and got[1] == []


def test_distance(spark):
    df = spark.createDataFrame([(48.7665, 11.4258), (None, 1.0), (48.737, 11.1807)], "lat double, lon double")
    assert [r[0] for r in df.select(geo.km_from_home(F.col("lat"), F.col("lon"))).collect()] == [18, None, 0]


def test_radius_equals_all_pairs(spark):
    points = [(k, 47.0 + (k * 37 % 100) / 40, 9.0 + (k * 53 % 100) / 30) for k in range(300)] + [(900, None, 1.0)]
    centres = [(f"c{k}", 47.2 + k / 5, 9.3 + k / 4) for k in range(10)]
    p = spark.createDataFrame(points, "id int, lat double, lon double")
    c = spark.createDataFrame(centres, "centre string, centre_lat double, centre_lon double")
    got = {(r.id, r.centre) for r in geo.within_radius(p, c, 40).collect()}
    km = geo.great_circle(F.col("centre_lat"), F.col("centre_lon"), F.col("lat"), F.col("lon"))
    want = {(r.id, r.centre) for r in p.crossJoin(c).filter(km <= 40).collect()}
    assert got == want and want


@pytest.mark.parametrize(("level", "rank"), [("none", 0), ("B2", 4), ("unclear", -1), (None, -1)])
def test_rank(spark, level, rank):
    assert values(spark, text.level_rank(F.col("x")), [level]) == [rank]
