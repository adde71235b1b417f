"""A Python Data Source over recorded pages: one partition per source, so no site is ever asked in parallel.

``spark.read.format("recorded_pages").option("path", folder).load()`` reads files ``<source>/<query>-<page>.json`` (or
``.html``); ``.option("sources", "BA,KA")`` names the sources to read. (Filters are not pushed into the reader: Spark
keeps one reader per relation, so a filter taken in for one query would hold for the next.) A network reader has the
same shape: a partition per host, pages in order, a cursor to go on from.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class SourcePartition(InputPartition):
    def __init__(self, source: str) -> None:
        self.source = source


class RecordedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"]
        self.sources = [s for s in options.get("sources", "").split(",") if s] or None

    def partitions(self) -> list[InputPartition]:
        found = sorted(p.name for p in Path(self.folder).iterdir() if p.is_dir())
        return [SourcePartition(s) for s in found if self.sources is None or s in self.sources]

    def read(self, partition: SourcePartition) -> Iterator[tuple]:
        for p in sorted(Path(self.folder, partition.source).iterdir()):
            query, _, page = p.stem.partition("-")
            if query.isdigit() and page.isdigit():
                yield partition.source, int(query), int(page), p.read_text(encoding="utf-8")


class RecordedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return "source string, query_index int, page int, payload string"

    def reader(self, schema: object) -> RecordedReader:
        return RecordedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedPages)


def registry(enabled: list[str] | None = None, keys: dict[str, str] | None = None) -> list[tuple[str, str, str | None]]:
    """(source, kind, why it is skipped) of all sources in order; an unknown one is an error."""
    from stellwerk.constants import OFF_BY_DEFAULT, SOURCES

    if unknown := sorted(set(enabled or []) - set(SOURCES)):
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    out = []
    for s, kind in SOURCES.items():
        why = "not chosen" if enabled is not None and s not in enabled else "off by default" if enabled is None and s in OFF_BY_DEFAULT else "no key" if s == "AZ" and not (keys or {}).get("AZ") else None
        out.append((s, kind, why))
    return out
