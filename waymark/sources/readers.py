"""Source readers and normalisers: place payloads, feeds and gazetteers become candidate rows.

Each normaliser is DataFrame to DataFrame; a candidate has source, external_id, name, alt_names, lat, lng, type and refs.
Live services are out of scope: payload files are read with Spark's own JSON and XML readers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import in_box
from ..scratch import written
from .taxonomy import CATEGORIES, CLASSES, PRACTICAL, mapped, type_of_classes, type_of_denomination, type_of_tags


@dataclass(frozen=True)
class Source:
    """What is known of a source."""

    key: str
    license: str
    storable: bool
    tier: str
    ttl_days: int
    archivable: bool


#: The registry (fixed values).
SOURCES = {
    s.key: s
    for s in (
        Source("osm", "ODbL", True, "open", 30, True), Source("overture", "CDLA", True, "open", 90, True), Source("wikidata", "CC0", True, "reference", 30, True),
        Source("merimee", "LO", True, "official", 180, True), Source("datatourisme", "LO", True, "official", 30, True), Source("news", "feed", False, "community", 1, False),
    )
}

OVERPASS = "elements array<struct<type:string,id:long,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"
OVERTURE = "features array<struct<id:string,geometry:struct<coordinates:array<double>>,properties:struct<names:struct<primary:string,common:map<string,string>>,categories:struct<primary:string,alternate:array<string>>,confidence:double>>>"
SPARQL = "results struct<bindings:array<map<string,struct<value:string>>>>"
MERIMEE = "results array<struct<reference:string,titre:string,denomination:string,coordonnees:struct<lat:double,lon:double>>>"
DATATOURISME = "objects array<struct<uuid:string,label:map<string,string>,types:array<string>,lat:double,lng:double>>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _candidate(df: DataFrame, source: str, **cols: Column) -> DataFrame:
    blank = {"alt_names": F.expr("cast(array() as array<string>)"), "refs": F.expr("cast(map() as map<string,string>)")}
    return df.select(F.lit(source).alias("source"), *[v.alias(k) for k, v in ({**blank, **cols}).items()]).select("source", "external_id", "name", "alt_names", "lat", "lng", "type", "refs")


def osm(raw: DataFrame) -> DataFrame:
    """Elements once each; unmapped ones and, but for practical places, unnamed ones are left out."""
    e = raw.select(F.explode("elements").alias("e")).select("e.*").dropDuplicates(["type", "id"])
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    kind, name = type_of_tags(F.col("tags")), tag("name")
    e = e.withColumn("kind", kind).where(F.col("kind").isNotNull() & (name.isNotNull() | F.col("kind").isin(*PRACTICAL)))
    alts = F.array_distinct(F.filter(F.array(tag("alt_name"), tag("old_name"), tag("name:en")), lambda x: x.isNotNull() & ~x.eqNullSafe(tag("name"))))
    refs = F.map_filter(F.create_map(F.lit("wikidata"), tag("wikidata"), F.lit("wikipedia"), tag("wikipedia")), lambda k, v: v.isNotNull())
    return _candidate(e, "osm", external_id=F.concat_ws("/", "type", "id"), name=name, alt_names=alts, lat=F.coalesce("lat", "center.lat"), lng=F.coalesce("lon", "center.lon"), type=F.col("kind"), refs=refs)


def overture(raw: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Features with an id and a mapped category, longitude first; `box` (south, west, north, east) must hold some."""
    f = raw.select(F.explode("features").alias("f")).select("f.*")
    lng, lat = F.get("geometry.coordinates", F.lit(0)), F.get("geometry.coordinates", F.lit(1))
    if box is not None and f.where(in_box(lat, lng, *box)).isEmpty():
        raise ValueError("the extract does not cover the region")
    kind = F.coalesce(mapped(F.col("properties.categories.primary"), CATEGORIES), mapped(F.get("properties.categories.alternate", F.lit(0)), CATEGORIES))
    good = F.col("id").isNotNull() & (F.col("id") != "") & F.col("properties.names.primary").isNotNull()
    return _candidate(f.withColumn("kind", kind).where(good & F.col("kind").isNotNull()), "overture", external_id=F.col("id"), name=F.col("properties.names.primary"), lat=lat, lng=lng, type=F.col("kind"))


def wikidata(raw: DataFrame, locale: str = "en") -> DataFrame:
    """Rows grouped by item; the first mapped class in input order gives the type; the label falls back to English."""
    b = raw.select(F.posexplode("results.bindings").alias("at", "b"))
    v = lambda k: F.try_element_at("b", F.lit(k))["value"]
    b = b.select("at", F.regexp_extract(v("item"), r"(Q\d+)$", 1).alias("qid"), F.regexp_extract(v("class"), r"(Q\d+)$", 1).alias("cls"), v("coord").alias("wkt"), F.coalesce(v(f"label_{locale}"), v("label_en"), v("label")).alias("name"))
    b = b.withColumn("kind", mapped(F.col("cls"), CLASSES))
    g = b.where("qid <> ''").groupBy("qid").agg(F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("at"))).alias("kind"), F.min_by("wkt", "at").alias("wkt"), F.min_by("name", "at").alias("name"))
    point = r"Point\(\s*(-?[\d.]+)\s+(-?[\d.]+)\s*\)"
    g = g.where(F.col("kind").isNotNull() & F.col("name").isNotNull() & F.col("wkt").rlike(point))
    return _candidate(g, "wikidata", external_id=F.col("qid"), name=F.col("name"), lat=F.regexp_extract("wkt", point, 2).cast("double"), lng=F.regexp_extract("wkt", point, 1).cast("double"), type=F.col("kind"))


def merimee(raw: DataFrame) -> DataFrame:
    """The denomination as a whole, else its first word."""
    r = raw.select(F.explode("results").alias("r")).select("r.*")
    kind = type_of_denomination(F.col("denomination"))
    r = r.withColumn("kind", kind).where(F.col("kind").isNotNull() & F.col("coordonnees.lat").isNotNull())
    return _candidate(r, "merimee", external_id=F.col("reference"), name=F.col("titre"), lat=F.col("coordonnees.lat"), lng=F.col("coordonnees.lon"), type=F.col("kind"))


def datatourisme(raw: DataFrame, locale: str = "en") -> DataFrame:
    """Labels in the locale, else French, else the first; the first type in the ontology's order."""
    o = raw.select(F.explode("objects").alias("o")).select("o.*")
    kind = type_of_classes(F.col("types"))
    name = F.coalesce(F.try_element_at("label", F.lit(f"@{locale}")), F.try_element_at("label", F.lit("@fr")), F.get(F.map_values("label"), F.lit(0)))
    return _candidate(o.withColumn("kind", kind).where(F.col("kind").isNotNull()), "datatourisme", external_id=F.col("uuid"), name=name, lat=F.col("lat"), lng=F.col("lng"), type=F.col("kind"))


#: Words of local alerts by kind, in order (fixed values).
ALERTS = {"strike": ["strike", "grève", "streik"], "closure": ["closed", "fermeture", "fermé", "stängt"], "weather": ["storm", "orage", "alerte météo"]}


def news(spark: SparkSession, path: str, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """The items of RSS files, and entries of Atom files, that are alerts: (title, summary, link, kind, published)."""
    from ..functions.text import first_kind, plain_text

    rows = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    rss = rows("item", "title string, description string, link string, pubDate string").select("title", "description", "link", F.col("pubDate").alias("at"))
    atom = rows("entry", "title string, summary string, link array<struct<_href:string,_rel:string>>, published string, updated string")
    link = F.coalesce(F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0)), F.get("link", F.lit(0)))["_href"]
    items = rss.unionByName(atom.select("title", F.col("summary").alias("description"), link.alias("link"), F.coalesce("published", "updated").alias("at"))).where(F.trim("title") != "")
    text = F.concat_ws(" ", "title", "description")
    when = F.coalesce(F.try_to_timestamp(F.regexp_replace("at", r"^\w{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("at"))
    out = items.select("title", plain_text(F.col("description")).alias("summary"), "link", first_kind(text, lexicon or ALERTS).alias("kind"), when.alias("published"))
    return out.where("kind IS NOT NULL")


def gazetteer(raw: DataFrame, country: str) -> DataFrame:
    """Named settlements; a population keeps its digits only."""
    e = raw.select(F.explode("elements").alias("e")).select("e.*").dropDuplicates(["type", "id"])
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    digits = F.regexp_replace(tag("population"), r"\D", "")
    return e.where(tag("name").isNotNull()).select(F.col("id").alias("osm_id"), tag("name").alias("name"), tag("place").alias("place_type"), "lat", F.col("lon").alias("lng"), F.when(digits != "", digits.cast("int")).alias("population"), F.lit(country).alias("country_code"))


def ingest(candidates: DataFrame, known: DataFrame, cell: Column) -> tuple[DataFrame, DataFrame]:
    """(items, tiles): known source items with the candidates merged in, and how many of these each tile got.

    Only what may be stored is taken; of one (source, external_id) the candidate replaces what was known, and of equal
    candidates one is taken. known has the candidates' columns and cell.
    """
    new = storable(candidates).where("external_id IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL").withColumn("cell", cell).dropDuplicates(["source", "external_id"])
    items = known.join(new.select("source", "external_id"), ["source", "external_id"], "left_anti").unionByName(new)
    return items, new.groupBy("source", "cell").agg(F.count("*").alias("candidates"))


def ingested(candidates: DataFrame, known: DataFrame, cell: Column, path: str) -> tuple[DataFrame, dict[str, int]]:
    """Ingest, written to path, with its numbers observed by the writing job itself: fetched candidates, those refused by their
    licence or for want of an id or a place, those taken, and items written."""
    seen, wrote = Observation("candidates"), Observation("items")
    allowed = F.col("source").isin(*[k for k, s in SOURCES.items() if s.storable])
    whole = F.col("external_id").isNotNull() & F.col("lat").isNotNull() & F.col("lng").isNotNull()
    watched = candidates.observe(seen, F.count("*").alias("fetched"), F.count_if(~F.coalesce(allowed, F.lit(False))).alias("refused"), F.count_if(F.coalesce(allowed, F.lit(False)) & ~whole).alias("incomplete"))
    new = watched.where(allowed & whole).withColumn("cell", cell).dropDuplicates(["source", "external_id"])
    new = written(new, "candidates")  # read twice below, fetched and observed once
    items = known.join(new.select("source", "external_id"), ["source", "external_id"], "left_anti").unionByName(new).observe(wrote, F.count("*").alias("written"))
    items.write.parquet(path)
    return candidates.sparkSession.read.schema(items.schema).parquet(path), {**seen.get, **wrote.get}


def storable(candidates: DataFrame) -> DataFrame:
    """Only what its source's licence lets us keep."""
    return candidates.where(F.col("source").isin(*[k for k, s in SOURCES.items() if s.storable]))
