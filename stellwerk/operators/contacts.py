"""Places to ask for work: parsing, scoring, upsert, outcomes, call list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.constants import CONTACTS_PAGE_SIZE, CUISINE_LANGUAGES, EMAIL_BONUS, IMPRINT_PATHS, KIND_SCORES, LANGUAGE_BONUS, MAX_SCORE, UNKNOWN_KIND_SCORE
from stellwerk.functions.contact import email, phone, site_root
from stellwerk.functions.text import nocase


# The tags of places that are asked for.
TAGS = ["amenity=restaurant", "amenity=cafe", "amenity=fast_food", "amenity=bar", "amenity=pub", "shop=bakery", "shop=butcher", "shop=supermarket", "tourism=hotel"]


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _tag(*names: str) -> Column:
    """The first tag of these that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(F.element_at("tags", n)), F.lit("")) for n in names])


def places(elements: DataFrame, city: str | Column, order: str | None = None) -> DataFrame:
    """Map elements (type, id, lat, lon, center, tags) that have a name, a kind and some way to reach them.

    The same element from several queries counts once, the first by ``order``.
    """
    street, number = _tag("addr:street"), _tag("addr:housenumber")
    rows = elements.select(
        F.concat_ws("/", "type", F.col("id").cast("string")).alias("contact_id"), _tag("name").alias("name"), F.coalesce(*[F.nullif(F.element_at("tags", k), F.lit("")) for k in ("amenity", "shop", "tourism")]).alias("kind"),
        (F.lit(city) if isinstance(city, str) else city).alias("city"), F.when(street.isNotNull(), F.concat_ws(" ", street, number)).alias("street"),
        phone(_tag("phone", "contact:phone")).alias("phone"), _tag("email", "contact:email").alias("email"), _tag("website", "contact:website").alias("website"),
        F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"), "tags", (F.col(order) if order else F.lit(0)).alias("_order"),
    ).filter("name IS NOT NULL AND kind IS NOT NULL AND coalesce(phone, email, website) IS NOT NULL")
    fields = [c for c in rows.columns if c not in ("contact_id", "_order", "tags")]
    return rows.groupBy("contact_id").agg(F.min_by(F.struct(*fields, F.to_json("tags").alias("tags_json")), "_order").alias("p")).select("contact_id", "p.*").withColumn("tags", F.from_json("tags_json", "map<string,string>")).drop("tags_json")


def spoken_cuisine(cuisine: Column, languages: list[str]) -> Column:
    """The first language of a cuisine tag (values joined by ';') that is spoken, or null."""
    spoken = F.array(*[F.lit(x.strip().lower()) for x in languages]) if languages else F.array().cast("array<string>")
    said = F.transform(F.split(cuisine, ";"), lambda v: _lookup(CUISINE_LANGUAGES, F.lower(F.trim(v))))
    return F.get(F.filter(said, lambda x: x.isNotNull() & F.array_contains(spoken, x)), F.lit(0))


def score(kind: Column, mail: Column, cuisine: Column, languages: list[str]) -> Column:
    """How well a place suits work away from customers, 0 to 100."""
    base = F.coalesce(_lookup(KIND_SCORES, kind), F.lit(UNKNOWN_KIND_SCORE))
    extra = F.when(F.length(mail) > 0, EMAIL_BONUS).otherwise(0) + F.when(spoken_cuisine(cuisine, languages).isNotNull(), LANGUAGE_BONUS).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(MAX_SCORE), base + extra)).cast("int")


def reason(kind: Column, mail: Column, cuisine: Column, languages: list[str]) -> Column:
    """Why, in one sentence. The sentences, which are compared as text."""
    known = _lookup(KIND_SCORES, kind)
    what = F.concat(F.lit("A "), F.replace(kind, F.lit("_"), F.lit(" ")))
    kind_text = (
        F.when(known.isNull(), F.concat(what, F.lit(" — not a kind we know much about")))
        .when(known >= 70, F.concat(what, F.lit(": mostly back-of-house work")))
        .when(known >= 45, F.concat(what, F.lit(": some kitchen work, some customer contact")))
        .otherwise(F.concat(what, F.lit(": mostly serving customers")))
    )
    language = spoken_cuisine(cuisine, languages)
    return F.concat(F.concat_ws(", ", kind_text, F.when(F.length(mail) > 0, F.lit("you can write instead of phoning")), F.when(language.isNotNull(), F.concat(F.lit("their kitchen may speak "), F.initcap(language)))), F.lit("."))


def upserted(sightings: DataFrame, run: str = "run_id") -> DataFrame:
    """One contact per place from its sightings over runs.

    Name, kind, town and score are the last sighting's; street, phone, email, website and position the last that are
    known; the first sighting's run stays.
    """
    last = lambda c: F.max_by(c, run)
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(run)))
    return sightings.groupBy("osm_id").agg(*[last(c).alias(c) for c in ("name", "kind", "city", "back_of_house_score")], *[known(c).alias(c) for c in ("street", "phone", "email", "website", "lat", "lon")], F.min(run).alias("first_run"))


def outcomes(events: DataFrame) -> DataFrame:
    """(osm_id, outcome, last_contacted_at): the last outcome, and when someone was first reached ('no' does not count)."""
    return events.groupBy("osm_id").agg(F.max_by("outcome", F.struct("ts", "event_id")).alias("outcome"), F.min(F.when(F.col("outcome") != "no", F.col("ts"))).alias("last_contacted_at"))


def call_list(contacts: DataFrame, *, cities: list[str] | None = None, pending: bool = False, reachable: bool = False) -> DataFrame:
    """Contacts that fit, best first, by name without case within a score."""
    conditions = [F.col("city").isin(*cities)] if cities else []
    conditions += [F.col("outcome").isNull()] if pending else []
    conditions += [F.coalesce(F.col("phone"), F.col("email")).isNotNull()] if reachable else []
    return (contacts.filter(reduce(lambda a, b: a & b, conditions)) if conditions else contacts).orderBy(F.col("back_of_house_score").desc(), nocase(F.col("name")), "osm_id")


def page(rows: DataFrame, number: int, size: int = CONTACTS_PAGE_SIZE) -> DataFrame:
    """A page of the rows; a number out of range is the nearest page."""
    last = max(1, -(-rows.count() // size))
    return rows.offset((min(max(1, number), last) - 1) * size).limit(size)


def scanned(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements of the tag queries (tag, server, element) and the tags that no server answered.

    Of each tag the answer of the first server that gave one counts; an element that several tags have counts once, by
    the first tag in order.
    """
    order = F.element_at(F.create_map(*[F.lit(x) for k, t in enumerate(TAGS) for x in (t, k)]), F.col("tag"))
    first = answers.groupBy("tag").agg(F.min("server").alias("server"))
    used = answers.join(first, ["tag", "server"])
    fields = [c for c in used.columns if c not in ("type", "id", "tags")]
    rows = used.groupBy("type", "id").agg(F.min_by(F.struct(*fields, F.to_json("tags").alias("tags_json")), order).alias("e")).select("type", "id", "e.*")
    rows = rows.withColumn("tags", F.from_json("tags_json", "map<string,string>")).drop("tags_json")
    return rows, failed_tags(answers.select("tag", "server", F.lit(True).alias("answered")))


def failed_tags(asked: DataFrame) -> DataFrame:
    """(tag) of the requests (tag, server, answered) that no server answered: recorded, and skipped in the run."""
    return asked.groupBy("tag").agg(F.bool_or("answered").alias("ok")).filter(~F.col("ok")).select("tag")


def tag_query(tag: str, lat: float, lon: float, radius_km: float) -> str:
    """The map server's question for all elements with a tag (``key=value``) around a place."""
    key, _, value = tag.partition("=")
    return f'[out:json];nwr(around:{round(radius_km * 1000)},{lat},{lon})["{key}"="{value}"];out center;'


def by_city(found: DataFrame, known: DataFrame) -> DataFrame:
    """(city, places, new_places, kinds) of the places of a run; ``known`` (contact_id) were there before."""
    seen = found.join(known.select("contact_id", F.lit(True).alias("old")).distinct(), "contact_id", "left")
    return seen.groupBy("city").agg(F.count("*").alias("places"), F.count_if(F.col("old").isNull()).alias("new_places"), F.array_sort(F.collect_set("kind")).alias("kinds"))


def waiting(contacts: DataFrame) -> DataFrame:
    """Places with a website only; an empty text is a missing one."""
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return contacts.filter(~has("phone") & ~has("email") & has("website"))


def counts(contacts: DataFrame) -> DataFrame:
    return contacts.agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col("phone"), F.col("email")).isNotNull()).alias("reachable"), F.count_if(F.col("outcome").isNull()).alias("pending"))


def filled(contacts: DataFrame, texts: DataFrame) -> DataFrame:
    """Scripts by kind with the place's name and town put in."""
    text = F.replace(F.replace(F.col("template"), F.lit("{place}"), F.coalesce("name", F.lit(""))), F.lit("{city}"), F.coalesce("city", F.lit("")))
    return contacts.join(texts, "kind").select("osm_id", "kind", text.alias("script"))


def imprint_mail(places: DataFrame, fetched: DataFrame) -> DataFrame:
    """(contact_id, email): places with a website only, with the address on the first of their imprint pages that answered.

    ``fetched`` has url, status and html; the paths are tried in the vocabulary's order.
    """
    wanted = waiting(places).select("contact_id", site_root(F.col("website")).alias("root")).withColumn("p", F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(path).alias("path")) for k, path in enumerate(IMPRINT_PATHS)])))
    got = wanted.withColumn("url", F.concat("root", "p.path")).join(fetched.filter("status = 200"), "url")
    return got.groupBy("contact_id").agg(F.min_by("html", "p.rank").alias("html")).select("contact_id", email(F.col("html")).alias("email")).filter("email IS NOT NULL")
