import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stellwerk.llm import cities, employers, setsim, strings


def slow_distance(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if i == 0 or j == 0}
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=500, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.integers(1, 3))
def test_distance(a, b, most):
    assert strings.distance(a, b, most) == min(slow_distance(a, b), most + 1)


def test_repair():
    assert strings.repair("KrÃ¤henmarkt") == "Krähenmarkt" and strings.repair("GroÃ\x9fhandel") == "Großhandel" and strings.repair("Ã schön") == "Ã schön"
    assert strings.tidy("  a​b  c﻿ ") == "ab c" and strings.spell_out("Ärger ß é") == "aerger ss e"


def test_similarity_join_is_exact(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(120)]
    df = spark.createDataFrame([(w,) for w in sorted(set(words)) + [""]], "w string")
    left = df.select(F.col("w").alias("l"), setsim.grams(F.col("w")).alias("t"))
    right = df.select(F.col("w").alias("r"), setsim.grams(F.col("w")).alias("t"))
    grams = lambda s: {("^" + s + "$")[i : i + 2] for i in range(len(s) + 1)} if s else set()
    for threshold in (0.33, 0.5, 0.8, 1.0):
        got = {(r.l, r.r): round(r.jaccard, 9) for r in setsim.similarity_join(left, right, "l", "r", "t", threshold).collect()}
        want = {}
        for a, b in itertools.product(set(words), repeat=2):
            x, y = grams(a), grams(b)
            j = len(x & y) / len(x | y)
            if j >= threshold - 1e-9:
                want[a, b] = round(j, 9)
        assert got == want
    assert setsim.similarity_join(left.limit(0), right, "l", "r", "t", 0.5).count() == 0


REF = [(1, "Föhrenried an der Mehla", "Hügelland", "956"), (2, "Föhrenried bei Amperbach", "Unterwald", "432"), (3, "Bad Eschenau", "Seenkreis", "691"), (4, "Krähenmarkt", "Ostmark am Fels", "655"), (5, "Sankt Lechau", "Hügelland", "811"), (6, "Ampermünster", "Oberland", "091"), (7, "Amperheim", "Oberland", "662")]
TYPED = [("Föhrenried/Mehla", None, 1), ("foehrenried b. amperbach", None, 2), ("Föhrenried", "43201", 2), ("95601 Föhrenried", "43201", 1), ("Föhrenried", None, 0), ("Eschenau, Bad", None, 3), ("Eschenau-Süd, Bad", None, 3), ("BAD ESCHEANU", None, 3), ("KrÃ¤henmarkt", None, 4), ("K r ä h e n m a r k t", None, 4), ("krahenmarkt", "", 4), ("D-65511 Krähenmarkt (Zentrum)", None, 4), ("St. Lechau + Homeoffice", None, 5), ("Amper.", "66211", 7), ("Amper.", None, 0), ("Ampermarkt", "66211", 0), ("Homeoffice", None, 0), ("???", None, 0), ("Krähenmarkt, Ostmark am Fels", None, 4), ("x" * 50000, None, 0), ("wort " * 5000, None, 0)]


def test_cities(spark):
    ref = spark.createDataFrame([(*r, "c") for r in REF], "city_id int, name string, region_name string, plz_prefix string, city string")
    rows = [("jobs", str(k), c, p, 9) for k, (c, p, _) in enumerate(TYPED)] + [("jobs", "n", None, None, 1), ("jobs", "b", "   ", "1", 1), ("jobs", "e", "Bad Eschenau", None, 1), ("raw", "0", "Amperhiem", None, 1), ("raw", "0", "Amperhiem", None, 1)]
    df = spark.createDataFrame(rows, "origin string, row_key string, city string, plz string, open int")
    got = sorted((r.origin, r.row_key, r.city_id) for r in cities.map_cities(df, ref).collect())
    want = sorted([("jobs", str(k), i) for k, (_, _, i) in enumerate(TYPED)] + [("raw", "0", 7)] * 2)
    assert got == want
    assert cities.map_cities(df.limit(0), ref).count() == 0
    assert {r.city_id for r in cities.map_cities(df, ref.limit(0)).collect()} == {0}


SAME = [
    ["Georg Nusschimzell Metzgerei AG", "Metzg. Georg Nusschimzell", "METZGEREI NUSSCHIMZELL", "Nußchimzell, Fleischerei", "Metzgerei, Inh. G. Nuschimzell Aktiengesellschaft", "Nusschimezll Metzgerei - Hirschöd", "metzgerei nusschimzell (Hirschöd)"],
    ["Kripverslein & Jessrichlein Eiscafé GbR", "Eisdiele Jessrichlein + Kripverslein", "Eiscafe Kripverslein &amp; Jessrichlien G.b.R.", "Kripverslein-Jessrichlein Eiscafé", "EiscafÃ© Kripverslein/Jessrichlein"],
    ["Rohnkraft Personalservice GmbH", "Rohn Kraft Personalservice", "R0hnkraft Pers.-Service G.m.b.H.", "Personaldienst Rohnkraft (Zeitarbeit)", "RKP Rohnkraft Personalservice", "Rhonkraft Personalservice"],
    ["Nusschimzell Eiscafé KG"], ["Nusschimzell Feinkost AG"], ["Kripverslein & Jessrichlein Labor"],
]


def test_employers(spark):
    rows = [(c, k) for group in SAME for k, c in enumerate(group)] + [("Rohnkraft Personalservice GmbH", 1)] * 9 + [("Georg Nusschimzell Metzgerei AG", 2)] * 3 + [(None, 1), (" ", 1), ("", 2), ("w " * 4000, 1), ("?!", 1)]
    df = spark.createDataFrame(rows, "company string, key int")
    linked = employers.link_employers(df, ["Hirschöd"])
    got = {(r.company_a, r.company_b) for r in employers.employer_pairs(linked).collect()}
    want = {tuple(sorted(p)) for group in SAME for p in itertools.combinations(group, 2)}
    assert got == want
    assert employers.employer_pairs(employers.link_employers(df.limit(0))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_read(s):
    employers.read_spelling(s, frozenset(["hirschod"]))
    cities.read_value(s, frozenset(["oberland"]))


def _pairs(spark, counts, **options):
    df = spark.createDataFrame([(c,) for c, n in counts.items() for _ in range(n)], "company string")
    return {(r.company_a, r.company_b) for r in employers.employer_pairs(employers.link_employers(df, ["Hirschöd"], **options)).collect()}


def test_two_frequent_employers_one_letter_apart(spark):
    counts = {"Bäckerei Maier": 1000, "Maier Bäckerei": 4, "Bäckerei Meier": 999, "Meier Bäckerei": 4, "Bäckerei Maierr": 2}
    got = _pairs(spark, counts)
    assert got == {("Bäckerei Maier", "Maier Bäckerei"), ("Bäckerei Meier", "Meier Bäckerei"), ("Bäckerei Maier", "Bäckerei Maierr"), ("Bäckerei Maierr", "Maier Bäckerei")}


def test_a_line_outside_the_dictionary(spark):
    names = ["Huber", "Maurer", "Quast", "Lorenz", "Brandl", "Zirngibl", "Ostertag", "Felber", "Wimmer", "Gruber"]
    counts = {f"Bestattungen {n}": 3 for n in names} | {"Bäckerei Huber": 4, "Huber, Bestattungen": 1, "Josef Maurer Bestattungen": 1, "Bestattugen Quast": 1, "Bestatt. Lorenz": 1}
    got = _pairs(spark, counts)
    assert not any("Bäckerei" in a or "Bäckerei" in b for a, b in got)
    assert {("Bestattungen Huber", "Huber, Bestattungen"), ("Bestattungen Maurer", "Josef Maurer Bestattungen"), ("Bestattugen Quast", "Bestattungen Quast"), ("Bestatt. Lorenz", "Bestattungen Lorenz")} <= got
    # One alone is too little to learn from, but it is no baker either.
    assert _pairs(spark, {"Bestattungen Huber": 3, "Bäckerei Huber": 4}) == set()


def test_abbreviations_are_weighed_by_the_names(spark):
    counts = {"Pflegeheim Quast": 3, "Pflegedienst Lorenz": 3, "Pfleg. Quast": 1, "Pfleg. Lorenz": 1, "Pflegd. Lorenz": 1}
    got = _pairs(spark, counts)
    assert got == {("Pfleg. Quast", "Pflegeheim Quast"), ("Pfleg. Lorenz", "Pflegedienst Lorenz"), ("Pflegd. Lorenz", "Pflegedienst Lorenz"), ("Pfleg. Lorenz", "Pflegd. Lorenz")}


def test_names_of_any_number_and_length(spark):
    many = ["Adlgas", "Birnstiel", "Czerny", "Dorfner"]
    slip = ["Xdlgas", "Birnstiel", "Czerny", "Dorfner"]
    long = [f"{a}{b}berger" for a in "abcdefgh" for b in ("ill", "om", "ust", "ark", "enz", "orf", "ist", "unt")]
    a, b = "Labor " + " & ".join(many), "Labor " + " & ".join(slip)
    x, y = "Labor " + " & ".join(long), "Labor " + " & ".join(reversed(long))
    assert len(long) > 60 and _pairs(spark, {a: 5, b: 1, x: 2, y: 1}) == {tuple(sorted((a, b))), tuple(sorted((x, y)))}


LEFT_OUT = [
    # An abbreviation after the name, of several parts, and with a slip.
    {"Pflegedienst Quast GmbH": 3, "Quast, Pflegd. GmbH": 1, "Quast Pflegde.": 1},
    {"Maschinenbau Friedrich Lorenz": 3, "Mach.-Bau Friedrich Lorenz AG": 1, "Mssch.-Bau Lorenz": 1},
    # Equally frequent: the one between is meant, whichever sorts first.
    {"Üllmorode Autohaus GmbH": 2, "Üllmordoe Auto-Haus GmbH": 2, "Üllmoride Kfz-Handel": 2},
    # A slip in the umlaut as most typed it, beside another way to type it.
    {"Bäckerei Bäuerle": 10, "Bäckerei Baeuerle": 3, "Bäckerei Bäierle": 1},
    # No line of business at all, or one that is not known.
    {"Siemoras AG": 10, "Siemroas": 1, "SIEM ORAS AG": 1}, {"Bestattungen Huber": 5, "Bestattugen Huber": 1},
    # Two readings that fit are one employer.
    {"Metzgerei Traxl": 100, "Metzgerei Troxl": 1, "Truxl GmbH": 1},
    # Names of two letters.
    {"BP Tankstelle": 3, "Tankstelle BP GmbH": 1}, {"Tankstelle BB": 1},
    # A slip in a name that is written apart, or beside an abbreviation that fits several lines.
    {"Rohnkraft Personalservice": 5, "Rhon Kraft Personalservice": 1}, {"Pflegeheim Birnstiel": 3, "Pfleg. Birnsteil": 1},
    # Two edits in one name are another employer, and so is a frequent one.
    {"Autohaus Östdergraf": 14}, {"Autohaus Östversgraf": 5}, {"Zirngibl AG": 1000}, {"Zirngobl AG": 999},
]


def test_no_link_is_left_out(spark):
    got = _pairs(spark, {c: n for group in LEFT_OUT for c, n in group.items()})
    assert got == {tuple(sorted(p)) for group in LEFT_OUT for p in itertools.combinations(group, 2)}


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_common(a, b):
    found = {"".join(x) for k in range(len(a) + 1) for x in itertools.combinations(a, k)} & {"".join(x) for k in range(len(b) + 1) for x in itertools.combinations(b, k)}
    assert employers.common(a, b) == max(map(len, found))


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 5).flatmap(lambda n: st.lists(st.lists(st.integers(0, 9), min_size=n, max_size=n), min_size=n, max_size=n)))
def test_assign(cost):
    n = len(cost)
    assert employers.assign(cost) == min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_short_entries(spark):
    ref = spark.createDataFrame([(1, "Kiel", "N", "241"), (2, "Ulm", "S", "890"), (3, "Aue", "O", "082")], "city_id int, name string, region_name string, plz_prefix string")
    typed = [("Keil", 1), ("Kile", 1), ("Kil", 0), ("Ulm", None), ("Ullm", 2), ("Auue", 3), ("Bonn", 0), ("Kiel" + " (Mitte)" * 100, 1)]
    df = spark.createDataFrame([("jobs", str(k), c, None) for k, (c, _) in enumerate(typed)], "origin string, row_key string, city string, plz string")
    got = {int(r.row_key): r.city_id for r in cities.map_cities(df, ref).collect()}
    assert got == {k: i for k, (_, i) in enumerate(typed) if i is not None}
