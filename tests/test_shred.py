import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stellwerk.functions.jsontext import _by_events, load
from stellwerk.operators.shred import nodes_of, places_of_entries, search_pages


def brute(pages):
    out = set()
    as_list = lambda x: x if isinstance(x, list) else [] if x is None else [x]
    for i, p in pages:
        try:
            v = json.loads(p or "")
        except ValueError:
            continue
        if not isinstance(v, dict):
            continue
        for k, e in enumerate(as_list(v.get("ergebnisliste"))):
            if isinstance(e, dict) and e.get("referenznummer"):
                for j, place in enumerate(as_list(e.get("stellenlokationen"))):
                    a = (place or {}).get("adresse") or {}
                    ort, plz = a.get("ort") or "", a.get("plz")
                    plz = str(plz).zfill(5) if plz not in (None, "") else ""
                    if ort or plz:
                        out.add((i, k, j, ort, plz))
    return out


ENTRY = {"referenznummer": "r1", "stellenangebotsTitel": "t", "stellenlokationen": [None, {"adresse": {"ort": "A", "plz": 2413}}, {"adresse": None}, {"adresse": {"ort": "", "plz": ""}}, {"adresse": {"plz": "85049"}}]}
PAGES = [
    (1, json.dumps({"ergebnisliste": [None, ENTRY, {"referenznummer": None, "stellenlokationen": [{"adresse": {"ort": "B"}}]}], "maxErgebnisse": 3})),
    (2, json.dumps({"ergebnisliste": [{"referenznummer": "r2", "stellenlokationen": {"adresse": {"plz": "1", "ort": "  C "}}}]})),
    (3, json.dumps({"ergebnisliste": [ENTRY]})[:-3]), (4, None), (5, ""), (6, "[]"), (7, '{"meldung": "x", "code": 503}'), (8, json.dumps({"ergebnisliste": ENTRY})), (9, "NaN"), (10, '{"ergebnisliste": []} x'),
]


def test_places(spark):
    df = spark.createDataFrame([(i, p, "extra") for i, p in PAGES], "page_id bigint, payload string, node string")
    got = {tuple(r) for r in places_of_entries(df).collect()}
    assert got == brute(PAGES)
    twice = df.unionByName(df)
    assert sorted(map(tuple, places_of_entries(twice).collect())) == sorted(got)
    assert places_of_entries(df.limit(0)).count() == 0


def test_real_pages(spark, data):
    df = spark.read.parquet(f"{data}/jobs_werkstudent_ingolstadt.parquet")
    rows = [(r.page_id, r.payload) for r in df.collect()]
    assert {tuple(r) for r in places_of_entries(df).collect()} == brute(rows)
    pages, entries, places = search_pages(df)
    assert pages.count() > 0 and entries.count() > 0
    assert places.join(entries, (places.place_parent == entries.entry_node) & (places.page_id == entries.page_id) & (places.digest == entries.digest)).count() >= len(brute(rows))


@pytest.mark.parametrize("text", ["[" * 100000, "{", '{"a":' * 50000, "null", '"x"', '{"a": Infinity}'])
def test_what_is_no_page_gives_nothing(text):
    assert [n for n in nodes_of(text) if n[4] == "object"] == []


def test_shapes():
    got = nodes_of('{"a": [[1, 2], 3], "b": {"c": true}, "d": null, "a2": 1.50}')
    assert ("a", 2, "3") in {(n[2], n[3], n[5]) for n in got} and ("c", 0, "true") in {(n[2], n[3], n[5]) for n in got} and ("a2", 0, "1.50") in {(n[2], n[3], n[5]) for n in got}


_VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=4), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(max_size=3), v, max_size=3), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(_VALUES, st.integers(0, 60), st.sampled_from(["", ",", "}", "]", '"', " x", ":", "NaN", "-", "\\"]))
def test_events_read_as_the_parser_does(value, at, extra):
    whole = json.dumps(value)
    for text in (whole, json.dumps(value, indent=1), whole[:at] + extra + whole[at:], whole[:at]):
        try:
            want = load(text, str)
        except ValueError:
            with pytest.raises(ValueError):
                _by_events(text, str)
        else:
            assert _by_events(text, str) == want


@pytest.mark.parametrize("depth", [5_000, 50_000, 400_000])
def test_any_depth(depth):
    deep = '{"x":' * depth + "[" * depth + "1" + "]" * depth + "}" * depth
    page = '{"ergebnisliste": [{"referenznummer": "r", "extra": ' + deep + ', "stellenlokationen": [{"adresse": {"ort": "A"}}]}]}'
    rows = nodes_of(page, frozenset(["ergebnisliste", "referenznummer", "stellenlokationen", "adresse", "ort"]))
    assert [r[5] for r in rows if r[2] == "ort"] == ["A"]
    assert len([r for r in nodes_of(page) if r[2] == "x"]) == depth
    assert nodes_of(page[:-1]) == []
