from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stellwerk.operators import contacts as C
from stellwerk.operators import journal as J

T0 = datetime(2026, 1, 1)


def test_status_fold(spark):
    rows = [(1, 1, T0, "applied", None), (1, 2, T0 + timedelta(1), None, "n"), (1, 3, T0 + timedelta(2), "rejected", None), (1, 4, T0 + timedelta(3), "applied", None), (2, 5, T0, None, "m")]
    got = {r.job_id: r for r in J.status_fold(spark.createDataFrame(rows, "job_id int, event_id int, ts timestamp, status string, notes string")).collect()}
    assert (got[1].status, got[1].notes, got[1].applied_on) == ("applied", "n", T0) and (got[2].status, got[2].applied_on) == ("new", None)


def test_health(spark):
    rows = [("A", k, T0 + timedelta(hours=k), f) for k, f in enumerate([True, False, True, True, True])] + [("B", 9, T0, True), ("C", 10, T0, False)]
    h = J.source_health(spark.createDataFrame(rows, "source string, event_id int, ts timestamp, failed boolean"))
    got = {r.source: (r.consecutive_failures, r.cooldown_until) for r in h.collect()}
    assert got == {"A": (3, T0 + timedelta(hours=28)), "B": (1, None), "C": (0, None)}
    assert {r.source for r in J.allowed_sources(h, F.lit(T0)).collect()} == {"B", "C"}
    assert {r.source for r in J.allowed_sources(h, F.lit(T0 + timedelta(hours=28))).collect()} == {"A", "B", "C"}


def test_runs(spark):
    rows = [(1, "search", "running", None, T0), (2, "search", "running", T0, T0 - timedelta(1)), (3, "enrich", "done", None, T0)]
    runs = spark.createDataFrame(rows, "run_id int, kind string, state string, last_progress_at timestamp, started_at timestamp")
    now = F.lit(T0 + timedelta(minutes=9))
    assert [r[0] for r in runs.orderBy("run_id").select(J.display_state(F.col("state"), F.col("last_progress_at"), F.col("started_at"), now)).collect()] == ["running", "running", "done"]
    assert [r.state for r in J.close_stale(runs, now).orderBy("run_id").collect()] == ["interrupted", "running", "done"]
    assert J.latest_run(runs, "search").collect()[0].run_id == 2
    pages = spark.createDataFrame([("A", "s", 0, 3), ("A", "s", 1, 1), ("A", "t", 0, 0)], "source string, spec_hash string, query_index int, page int")
    assert [tuple(r) for r in J.resume_cursor(pages).collect()] == [("A", "s", 1, 2)]


def test_places_and_scores(spark):
    tags = [{"name": " Bäcker ", "shop": "bakery", "contact:phone": "08431/648595", "addr:street": "Weg", "addr:housenumber": "3"}, {"name": "X", "amenity": "bar"}, {"amenity": "cafe", "phone": "+49 8431 2078"}, {"name": "Y", "amenity": "restaurant", "email": "a@b.de", "cuisine": "iranian;grill", "phone": "1"}, {"name": "Z", "tourism": "hotel", "website": "z.de"}]
    rows = [("node", k, 1.0, None, (2.0, 3.0), t) for k, t in enumerate(tags)] + [("node", 0, 9.0, None, (2.0, 3.0), tags[0])]
    df = spark.createDataFrame(rows, "type string, id bigint, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>")
    got = {r.contact_id: r for r in C.places(df, "Ort").collect()}
    assert set(got) == {"node/0", "node/3", "node/4"} and got["node/0"].street == "Weg 3" and got["node/0"].phone == "+498431648595" and got["node/0"].lon == 3.0 and got["node/3"].phone is None
    scored = C.places(df, "Ort").select("contact_id", C.score(F.col("kind"), F.col("email"), F.element_at("tags", "cuisine"), ["Persian"]).alias("s"), C.reason(F.col("kind"), F.col("email"), F.element_at("tags", "cuisine"), ["Persian"]).alias("r"))
    by = {r.contact_id: (r.s, r.r) for r in scored.collect()}
    assert by["node/3"] == (79, "A restaurant: some kitchen work, some customer contact, you can write instead of phoning, their kitchen may speak Persian.") and by["node/0"][0] == 85


def test_contacts(spark):
    schema = "osm_id string, run_id int, name string, kind string, city string, back_of_house_score int, street string, phone string, email string, website string, lat double, lon double"
    rows = [("a", 1, "n1", "bar", "c", 1, "s", "p1", None, None, 1.0, None), ("a", 2, "n2", "cafe", "c", 2, None, None, "e", None, None, 2.0)]
    r = C.upserted(spark.createDataFrame(rows, schema)).collect()[0]
    assert (r["name"], r.kind, r.street, r.phone, r.email, r.lat, r.lon, r.first_run) == ("n2", "cafe", "s", "p1", "e", 1.0, 2.0, 1)
    ev = spark.createDataFrame([("a", 1, T0, "no"), ("a", 2, T0 + timedelta(1), "called"), ("a", 3, T0 + timedelta(2), "no")], "osm_id string, event_id int, ts timestamp, outcome string")
    o = C.outcomes(ev).collect()[0]
    assert (o.outcome, o.last_contacted_at) == ("no", T0 + timedelta(1))
    c = spark.createDataFrame([("1", "äb", "Z", 5, None, "m", None, None), ("2", "B", "Z", 5, "p", None, None, None), ("3", "a", "Y", 9, "", "", "w", "called")], "osm_id string, name string, city string, back_of_house_score int, phone string, email string, website string, outcome string")
    assert [x.osm_id for x in C.call_list(c).collect()] == ["3", "2", "1"] and [x.osm_id for x in C.waiting(c).collect()] == ["3"]
    assert tuple(C.counts(c).collect()[0]) == (3, 3, 2) and tuple(C.counts(c.limit(0)).collect()[0]) == (0, 0, 0)
