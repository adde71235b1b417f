import json

import pytest
from pyspark.sql import functions as F

from stellwerk.operators import contacts as C
from stellwerk.operators import profile as P
from stellwerk.schemas import PLACE, RESUME
from stellwerk.streaming.ingest import run_until_done


def test_levels(spark):
    df = spark.createDataFrame([("b2",), (" Native ",), ("Fließend",), ("none",), ("gut",), (None,)], "x string")
    assert [r[0] for r in df.select(P.language_level(F.col("x"))).collect()] == ["B2", "C2", "C1", None, None, None]
    with pytest.raises(Exception, match="gut"):
        df.filter("x = 'gut'").select(P.language_level(F.col("x"), strict=True)).collect()


def test_resume(spark):
    row = ("Ada Lovelace", [("English", "native", None), ("Deutsch", "basic", None)], [("Barista", "Café", "2024-10", "present"), ("x", "y", "YYYY-MM", "2023-01"), ("z", "w", "2022-13", "2022-02")], [("BSc", "Uni")], {"b": ["1"], "a": ["1", "2"], "c": ["1"], "d": []})
    df = spark.createDataFrame([row], RESUME)
    got = df.select(P.own_german_level(F.col("languages")), P.years_of_experience(F.col("experience"), "2026-04"), P.top_skill_groups(F.col("skill_groups")), P.first_name(F.col("name"))).collect()[0]
    assert tuple(got) == ("A2", 1.5, ["a", "b", "c"], "Ada")
    text = P.digest(df).collect()[0][0]
    assert "Ada" not in text and "- Barista at Café (2024-10 to present)" in text and text.startswith("# Skills\n- a: 1, 2")
    empty = spark.createDataFrame([(None, None, None, None, None)], RESUME)
    assert tuple(empty.select(P.own_german_level(F.col("languages")), P.years_of_experience(F.col("experience"), "2026-04"), P.first_name(F.col("name"))).collect()[0]) == ("A2", 0.0, "a student")


def test_roles_and_prompts(spark):
    roles = spark.createDataFrame([('{"roles": [{"title_de": "a", "search_keywords": [" X ", "x", "", "Y"], "confidence": 0.5}]}',), ("{broken",), (None,)], "value string")
    assert [r.search_keywords for r in P.stored_roles(roles).collect()] == [["x", "y"]]
    files = spark.createDataFrame([("p/enrich.v9.md", "nine"), ("p/enrich.v10.md", "ten"), ("p/roles.v1.md", "r"), ("p/notes.md", "n")], "path string, text string")
    assert {tuple(r) for r in P.latest_prompts(files).collect()} == {("enrich", "v10", "ten"), ("roles", "v1", "r")}


def test_scripts(spark):
    good = {"script_lines": [{"de": "a", "en": "b"}] * 5, "email_subject": "s", "email_body": "An {place}"}
    bad = [(good, None), (good | {"script_lines": []}, "not 5 lines"), (good | {"script_lines": [{"de": "a", "en": " "}] * 5}, "a line lacks a language"), (good | {"email_subject": ""}, "no subject or no body"), (good | {"email_body": "x"}, "no place for the name")]
    df = spark.createDataFrame([(k, json.dumps(a)) for k, (a, _) in enumerate(bad)] + [(9, "x")], "k int, a string")
    assert [r[0] for r in df.orderBy("k").select(P.script_problem(F.col("a"))).collect()] == [b for _, b in bad] + ["not 5 lines"]


def test_imprint(spark):
    places = spark.createDataFrame([("n/1", "A", "bar", "c", None, None, None, "Laden.de/start", None, None, {}), ("n/2", "B", "bar", "c", None, "1", None, "x.de", None, None, {})], PLACE)
    fetched = spark.createDataFrame([("https://Laden.de/kontakt", 200, "chef@laden.de"), ("https://Laden.de/impressum", 404, "no@laden.de"), ("https://Laden.de/contact", 200, "late@laden.de")], "url string, status int, html string")
    assert [tuple(r) for r in C.imprint_mail(places, fetched).collect()] == [("n/1", "chef@laden.de")]


def test_legs():
    assert run_until_done(lambda k: (5 - k, k == 2)) == [5, 4, 3] and run_until_done(lambda k: (0, False)) == [0] and len(run_until_done(lambda k: (1, False))) == 6
