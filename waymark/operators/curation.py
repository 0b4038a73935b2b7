"""Curation: candidate packs, claim checks, evidence, grounding, publishing, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_markup, is_perishable, plain_text, word_trigrams
from .tables import interleaved

GROUNDING, EXCERPT = 0.4, 600
LICENSES = ("CC0", "CC-BY", "CC-BY-SA", "ODbL", "PDM")


def pack_candidates(places: DataFrame, evidence: DataFrame, curated: DataFrame, prose: DataFrame, priority: list[str], limit: int) -> DataFrame:
    """Places with evidence and not curated yet, richest first, domains in turn and three of a tile at most."""
    score = F.size(F.array_intersect("facets", F.array(*[F.lit(f) for f in priority])))
    c = places.join(evidence.select("place_id").distinct(), "place_id", "left_semi").join(curated.select("place_id").distinct(), "place_id", "left_anti")
    c = c.join(prose.select("place_id").distinct().withColumn("_p", F.lit(True)), "place_id", "left").withColumn("has_prose", F.coalesce("_p", F.lit(False))).drop("_p")
    c = c.withColumn("_score", -score).withColumn("_prose", (~F.col("has_prose")).cast("int"))
    return interleaved(c, "region", "type_domain", "cell", ["_score", "_prose", "place_id"], limit).drop("_score", "_prose")


def violations(claim: Column, grounded: Column, evidence: Column, licenses: Column) -> Column:
    """What stands against publishing a claim, in order; an empty array if nothing does."""
    allowed = F.array(*[F.lit(x) for x in LICENSES])
    checks = (
        F.when(~F.coalesce(grounded, F.lit(False)), "not_grounded"), F.when(F.coalesce(evidence, F.lit(0)) <= 0, "no_evidence"),
        F.when(F.size(F.array_except(F.coalesce(licenses, F.array()), allowed)) > 0, "license_not_allowed"), F.when(F.trim(F.coalesce(claim, F.lit(""))) == "", "empty_claim"), F.when(is_perishable(claim), "perishable"),
    )
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def evidence_bundle(claims: DataFrame, excerpts: DataFrame) -> DataFrame:
    """Per place the curated claims and then the source excerpts, cut to EXCERPT characters, in order."""
    a = claims.select("place_id", F.lit(0).alias("part"), F.col("id").cast("string").alias("at"), F.col("claim").alias("text"))
    b = excerpts.select("place_id", F.lit(1).alias("part"), F.col("source").alias("at"), F.substring("excerpt", 1, EXCERPT).alias("text"))
    items = F.transform(F.sort_array(F.collect_list(F.struct("part", "at", "text"))), lambda x: x["text"])
    return a.unionByName(b).where("text IS NOT NULL").groupBy("place_id").agg(items.alias("evidence"))


def grounded(items: DataFrame, places: DataFrame, key: str = "id", floor: float = GROUNDING) -> DataFrame:
    """The place of the most similar name within the item's region, if similar enough.

    Titles and names meet once each, and only where they share one of their rarest trigrams: of two sets of n and m with a
    Jaccard similarity of `floor`, the first n - ceil(floor n) + 1 of the one and m - ceil(floor m) + 1 of the other, in a
    common order of all trigrams, share one.
    """
    texts = lambda df, c: df.where(F.col(c).isNotNull()).groupBy("region", F.col(c).alias("text"))
    sides = {"title": texts(items, "title").agg(F.lit(None).cast("long").alias("place")), "name": texts(places, "name").agg(F.min("place_id").alias("place"))}
    sides = {k: v.withColumn("grams", word_trigrams(F.col("text"))).where(F.size("grams") > 0) for k, v in sides.items()}
    often = sides["name"].select("region", F.explode("grams").alias("gram")).groupBy("region", "gram").agg(F.count("*").alias("n"))

    def leading(df: DataFrame) -> DataFrame:
        """(region, text, place, grams, gram) of the grams of each text that must be looked up."""
        long = df.select("region", "text", F.explode("grams").alias("gram")).join(often, ["region", "gram"], "left")
        ranked = long.groupBy("region", "text").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("g"))
        some = F.slice("g", 1, F.size("g") - F.ceil(F.lit(floor) * F.size("g") - 1e-9).cast("int") + 1)
        return ranked.select("region", "text", F.explode(some).alias("x")).select("region", "text", F.col("x.gram").alias("gram")).join(df, ["region", "text"])

    t, n = leading(sides["title"]).toDF("region", "title", "gram", "_", "tg"), leading(sides["name"]).toDF("region", "name", "gram", "place", "ng")
    met = t.join(n, ["region", "gram"]).select("region", "title", "name", "place", "tg", "ng").dropDuplicates(["region", "title", "name"])
    both = F.size(F.array_intersect("tg", "ng"))
    scored = met.withColumn("similarity", F.round(both / (F.size("tg") + F.size("ng") - both), 4)).where(F.col("similarity") >= floor)
    best = scored.groupBy("region", "title").agg(F.max_by(F.struct("place", "similarity"), F.struct("similarity", -F.col("place"))).alias("b"))
    return items.join(best, ["region", "title"]).select(key, F.col("b.place").alias("place_id"), F.col("b.similarity").alias("similarity"))


def published(packs: DataFrame, items: DataFrame) -> DataFrame:
    """Approved items' distinct tiles and effort per pack, the version raised."""
    a = items.where("status = 'approved'").groupBy("pack_id").agg(F.sort_array(F.collect_set("cell")).alias("tiles"), F.coalesce(F.sum("effort_minutes"), F.lit(0)).alias("effort_minutes"), F.count("*").alias("items"))
    return packs.join(a, "pack_id", "left").withColumn("version", F.col("version") + 1)


def sanitised(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose text has markup, with the clean text."""
    return rows.where(has_markup(F.col(text))).withColumn(text, plain_text(F.col(text)))


#: Names (under 100 bytes each) that may be sent to every executor.
BROADCAST_NAMES = 20_000


def named_in(alerts: DataFrame, places: DataFrame, text: str = "text", key: str = "alert_id", region: str = "region") -> DataFrame:
    """The longest place name (4 letters or more) that an alert's text contains, within its region.

    Few names are sent to the alerts. Of more, a name is looked up by its first four letters among those that the text has
    anywhere, and then compared as a whole.
    """
    p = places.where(F.length("name") >= 4).select(region, "place_id", "name")
    low = F.lower(F.col(text))
    if p.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES:
        names = F.transform(F.sort_array(F.collect_list(F.struct((-F.length("name")).alias("l"), "place_id", "name"))), lambda x: F.struct(x["place_id"].alias("place_id"), x["name"].alias("name")))
        asked = alerts.join(F.broadcast(p.groupBy(region).agg(names.alias("_names"))), region)
        first = F.get(F.filter("_names", lambda n: F.contains(low, F.lower(n["name"]))), F.lit(0))
        return asked.select(key, first.alias("_hit")).groupBy(key).agg(F.first("_hit", ignorenulls=True).alias("_hit")).where("_hit IS NOT NULL").select(key, "_hit.place_id", "_hit.name")
    seeds = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 3), lambda i: F.substr(low, i, F.lit(4))))
    asked = alerts.withColumn("_seed", F.explode(F.when(F.length(low) >= 4, seeds)))
    hit = asked.join(p.withColumn("_seed", F.lower(F.substring("name", 1, 4))), [region, "_seed"]).where(F.contains(low, F.lower(F.col("name"))))
    best = hit.groupBy(key).agg(F.max_by(F.struct("place_id", "name"), F.struct(F.length("name"), -F.col("place_id"))).alias("b"))
    return best.select(key, "b.place_id", "b.name")
