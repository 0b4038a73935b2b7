"""Paged sources as a Spark data source, a partition a page.

A source's pages lie under one folder, each as page=N holding JSON text of one object, numbered from 0, as a harvest of a
service leaves them. What may be read is told by the source's adapter: how many records make a full page, the most pages there
may be, whether a source that has more is refused or cut there, and where the number of pages is said. Reading stops after the
first page that is not full.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass(frozen=True)
class Adapter:
    """How a source is paged: the field of its records, records of a full page (None: only an empty page ends), the most
    pages, whether more than these are an error, and where a page says how many there are; and for which locales it is asked."""

    field: str
    size: int | None
    most: int
    refuse: bool
    total: str | None = None
    locales: tuple[str, ...] = ()

    def supports(self, locale: str) -> bool:
        return not self.locales or locale in self.locales


#: The paged sources (fixed values).
ADAPTERS = {"merimee": Adapter("results", 100, 60, False, locales=("fr",)), "datatourisme": Adapter("objects", None, 500, True, "total_pages", ("fr",))}


@dataclass
class Page(InputPartition):
    number: int
    files: tuple[str, ...]


def _listed(path: str) -> dict[str, int]:
    """Files below a folder and their sizes. Local folders are read without Arrow's threads."""
    if path.startswith("file:") or "://" not in path:
        root = path.removeprefix("file:")
        root = "/" + root.lstrip("/") if path.startswith("file:") else root
        return {f: os.path.getsize(f) for d, _, names in os.walk(root) for f in (os.path.join(d, n) for n in names)}
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    return {i.path: i.size for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file}


def _text(path: str, files: tuple[str, ...]) -> str:
    if path.startswith("file:") or "://" not in path:
        return "".join(open(f, encoding="utf-8").read() for f in files)
    from pyarrow import fs

    system, _ = fs.FileSystem.from_uri(path)
    return "".join(system.open_input_stream(f).read().decode() for f in files)


class _Pages(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.field, self.most, self.refuse, self.total = options["path"], options["field"], int(options["most"]), options["refuse"] == "true", options.get("total")

    def partitions(self) -> list[Page]:
        found: dict[int, list[str]] = {}
        for f, size in _listed(self.path).items():
            m = re.search(r"/page=(\d+)/part-[^/]*$", f)
            if m and size:
                found.setdefault(int(m[1]), []).append(f)
        run = 0
        while run in found:  # pages after a gap do not belong to the harvest
            run += 1
        said = None
        if self.total and run:
            said = (json.loads(_text(self.path, tuple(found[0]))).get("meta") or {}).get(self.total)
        run = min(run, int(said)) if said else run
        if self.refuse and run > self.most:
            raise ValueError(f"the source has more than {self.most} pages; a part of it would be taken for the whole")
        return [Page(k, tuple(sorted(found[k]))) for k in range(min(run, self.most))]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # what Spark asks for where there are no partitions
            return
        for at, record in enumerate(json.loads(_text(self.path, partition.files)).get(self.field) or []):
            yield partition.number, at, json.dumps(record, ensure_ascii=False)


class PagedJson(DataSource):
    """spark.read.format("paged_json"): (page, at, record) of the records of every page."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, at int, record string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(dict(self.options))


def read_pages(spark: SparkSession, path: str, adapter: Adapter) -> DataFrame:
    """(page, at, record) up to the first page that is not full; an empty folder gives none. More pages than the adapter allows
    raise where it refuses them."""
    spark.dataSource.register(PagedJson)
    options = {"path": path, "field": adapter.field, "most": str(adapter.most), "refuse": str(adapter.refuse).lower()} | ({"total": adapter.total} if adapter.total else {})
    df = spark.read.format("paged_json").options(**options).load()
    if adapter.size is None:
        return df
    short = df.groupBy("page").count().where(F.col("count") < adapter.size).agg(F.min("page").alias("_last"))  # one row
    return df.crossJoin(F.broadcast(short)).where("_last IS NULL OR page <= _last").drop("_last")


def write_pages(records: DataFrame, path: str, field: str, page: Column, order: Column, meta: Column | None = None) -> None:
    """Writes records as pages of JSON objects; page numbers the page of a record, from 0, order its place in it."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.struct(*records.columns).alias("r")))), lambda x: x["r"]).alias(field)
    pages = records.groupBy(page.alias("page")).agg(listed)
    parts = [field] if meta is None else [field, F.struct(meta.alias("total_pages")).alias("meta")]
    pages.select("page", F.to_json(F.struct(*parts)).alias("value")).write.partitionBy("page").text(path)


def harvested(spark: SparkSession, path: str, source: str) -> DataFrame:
    """The records of a registered paged source; an unreadable folder is an error, not an empty source."""
    if source not in ADAPTERS:
        raise AnalysisException(f"no paged source {source!r}")
    return read_pages(spark, path, ADAPTERS[source])
