"""Deeply nested JSON payloads, turned into flat tables by way of one adjacency table.

:func:`shred` stores each payload as rows ``(doc_key, node, parent, label, ordinal, kind, scalar)``: one row per
object, and one per scalar member. Arrays are transparent: their elements hang on the object that owns the array, with
their position as ``ordinal``, so a single object counts as a list of one. :func:`objects` joins object nodes with
their scalar children, pivoted into columns; :func:`entity` selects the objects of a label. Parent-child links are the
node numbers.

Defined results:

* null, blank, incomplete or otherwise invalid JSON (also trailing text, NaN and Infinity) gives no rows;
* null members and null array elements give no row, but positions count them;
* scalars are kept as text: strings as they are, numbers as written, booleans ``true`` / ``false``;
* a member that occurs twice in an object counts as its last occurrence;
* an array right within an array is flattened, its elements counted on;
* nesting is followed to any depth, without recursion; repeated rows give repeated nodes, which entities merge
  (``doc_key`` holds the id columns and a digest of the payload); extra columns are not carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stellwerk.functions.jsontext import load
from stellwerk.session import cut

NODE_FIELDS = [("digest", "string"), ("node", "int"), ("parent", "int"), ("label", "string"), ("ordinal", "int"), ("kind", "string"), ("scalar", "string")]


def nodes_of(payload: str | None, labels: frozenset[str] | None = None) -> list[tuple[int, int, str, int, str, str | None]]:
    """The adjacency rows ``(node, parent, label, ordinal, kind, scalar)`` of one payload.

    ``labels`` keeps only members of these names, and what is below them: the column pruning of this operator.
    """
    if payload is None or not payload.strip():
        return []
    try:
        root = load(payload, str)
    except ValueError:
        return []
    rows: list[tuple[int, int, str, int, str, str | None]] = []
    todo: list[tuple[int, str, int, object]] = [(-1, "", 0, root)]
    while todo:
        parent, label, ordinal, value = todo.pop()
        if isinstance(value, dict):
            node = len(rows)
            rows.append((node, parent, label, ordinal, "object", None))
            for name, member in value.items():
                if labels is None or name in labels:
                    todo.append((node, name, 0, member))
        elif isinstance(value, list):
            flat, stack = [], [iter(value)]
            while stack:
                for x in stack[-1]:
                    if isinstance(x, list):
                        stack.append(iter(x))
                        break
                    flat.append(x)
                else:
                    stack.pop()
            todo.extend((parent, label, k, x) for k, x in enumerate(flat))
        elif value is not None:
            text = ("true" if value else "false") if isinstance(value, bool) else str(value)
            rows.append((len(rows), parent, label, ordinal, "scalar", text))
    return rows


def shred(df: DataFrame, ids: Sequence[str], payload: str, labels: Iterable[str] | None = None) -> DataFrame:
    """The adjacency table of ``payload``: the id columns, a digest of the payload, and the node columns."""
    keep = frozenset(labels) if labels is not None else None
    n_ids = len(ids)
    schema = T.StructType([df.schema[c] for c in ids] + [T.StructField(n, T.IntegerType() if k == "int" else T.StringType()) for n, k in NODE_FIELDS])
    source = df.select(*[F.col(c).alias(f"id{k}") for k, c in enumerate(ids)], F.col(payload).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                at: list[int] = []
                columns: list[list] = [[] for _ in NODE_FIELDS]
                for k, text in enumerate(part.column(n_ids).to_pylist()):
                    found = nodes_of(text, keep)
                    if found:
                        digest = hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()
                        at.extend([k] * len(found))
                        columns[0].extend([digest] * len(found))
                        for column, values in zip(columns[1:], zip(*found, strict=True), strict=True):
                            column.extend(values)
                index = pa.array(at, pa.int64())
                arrays = [part.column(k).take(index) for k in range(n_ids)] + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, schema)


def objects(adjacency: DataFrame, ids: Sequence[str], members: Iterable[str]) -> DataFrame:
    """Every object node joined with its scalar children, which are pivoted into one column per member.

    Columns: ids, digest, ``node``, ``parent``, ``label``, ``ordinal``, and the members (null where missing, the first
    element where a member is a list). The result is materialised: entity tables read it, not the payloads.
    """
    is_object = F.col("kind") == "object"
    owner = F.when(is_object, F.col("node")).otherwise(F.col("parent"))
    return cut(
        adjacency.groupBy(*ids, "digest", owner.alias("owner"))
        .agg(
            F.max(F.when(is_object, F.struct("node", "parent", "label", "ordinal"))).alias("o"),
            *[F.min_by("scalar", F.when(~is_object & (F.col("label") == m), F.col("ordinal"))).alias(m) for m in members],
        )
        .filter("o IS NOT NULL")
        .select(*ids, "digest", "o.*", *members)
    )


def entity(table: DataFrame, ids: Sequence[str], label: str, members: dict[str, str], *, prefix: str) -> DataFrame:
    """The entity table of the objects called ``label``: ids, digest, ``{prefix}_node``, ``{prefix}_parent``,
    ``{prefix}_no`` (position in its list), and the members (name to column name)."""
    return table.filter(F.col("label") == label).select(
        *ids, "digest", F.col("node").alias(f"{prefix}_node"), F.col("parent").alias(f"{prefix}_parent"), F.col("ordinal").alias(f"{prefix}_no"), *[F.col(m).alias(c) for m, c in members.items()]
    )


def search_pages(df: DataFrame, page_id: str = "page_id", payload: str = "payload") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, entries and places of recorded search pages, tied by ``page_id``, ``entry_node`` and ``place_node``."""
    members = ["maxErgebnisse", "referenznummer", "stellenangebotsTitel", "firma", "externeURL", "ort", "plz", "region", "land", "breite", "laenge"]
    nodes = objects(shred(df, [page_id], payload, ["ergebnisliste", "stellenlokationen", "adresse", *members]), [page_id], members)
    keys = [page_id, "digest"]
    pages = entity(nodes, [page_id], "", {"maxErgebnisse": "max_ergebnisse"}, prefix="page").filter("page_node = 0")
    entries = entity(nodes, [page_id], "ergebnisliste", {"referenznummer": "referenznummer", "stellenangebotsTitel": "titel", "firma": "firma", "externeURL": "externe_url"}, prefix="entry").filter("entry_parent = 0")
    places = entity(nodes, [page_id], "stellenlokationen", {"breite": "breite", "laenge": "laenge"}, prefix="place")
    addresses = entity(nodes, [page_id], "adresse", {m: m for m in ("ort", "plz", "region", "land")}, prefix="adresse").filter("adresse_no = 0")
    return pages, entries, places.join(addresses.select(*keys, F.col("adresse_parent").alias("place_node"), "ort", "plz", "region", "land"), [*keys, "place_node"], "left")


def places_of_entries(df: DataFrame, page_id: str = "page_id", payload: str = "payload") -> DataFrame:
    """One row per place with a town or a postcode of each entry with a reference number.

    Towns as recorded, postcodes padded to five digits (any other postcode counts as missing), '' where missing.
    """
    members = ["referenznummer", "ort", "plz"]
    nodes = objects(shred(df, [page_id], payload, ["ergebnisliste", "stellenlokationen", "adresse", *members]), [page_id], members)
    keys = [page_id, "digest"]
    entries = entity(nodes, [page_id], "ergebnisliste", {"referenznummer": "referenznummer"}, prefix="entry").filter((F.col("entry_parent") == 0) & (F.length("referenznummer") > 0))
    places = entity(nodes, [page_id], "stellenlokationen", {}, prefix="place")
    addresses = entity(nodes, [page_id], "adresse", {"ort": "ort", "plz": "plz"}, prefix="adresse").filter("adresse_no = 0")
    digits = F.regexp_extract(F.trim("plz"), r"^(?:[Dd][Ee]?[- ]?)?(\d{1,5})(?:\.0)?$", 1)
    return (
        addresses.select(*keys, F.col("adresse_parent").alias("place_node"), F.coalesce("ort", F.lit("")).alias("ort"), F.coalesce(F.when(digits != "", F.lpad(digits, 5, "0")), F.lit("")).alias("plz"))
        .filter((F.col("ort") != "") | (F.col("plz") != ""))
        .join(places, [*keys, "place_node"])
        .join(entries.select(*keys, F.col("entry_node").alias("place_parent"), "entry_no"), [*keys, "place_parent"])
        .select(page_id, "entry_no", F.col("place_no").alias("loc_no"), "ort", "plz")
        .distinct()
    )
