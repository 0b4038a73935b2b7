"""Suggestions over several lists of names from a stored trigram index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_trigrams
from ..scratch import sent, written

FLOOR, LIMIT, RESERVED = 0.3, 8, 3
#: Letters by which names that start alike are looked up, and queries that may be sent to every executor (under 200 bytes each).
HEAD, BROADCAST_QUERIES = 3, 50_000


@dataclass
class NameIndex:
    """Written tables: names(list, id, name, low, grams), often(gram, n), postings(gram, list, id), heads(head, list, id, low)."""

    names: DataFrame
    often: DataFrame
    postings: DataFrame
    heads: DataFrame
    floor: float


def _leading(texts: DataFrame, key: list[str], often: DataFrame, floor: float) -> DataFrame:
    """(key, gram): the rarest grams of each of texts(key, grams), as many as must be looked up.

    Of two sets of n and m with a Jaccard similarity of `floor`, the first n - ceil(floor n) + 1 of the one and
    m - ceil(floor m) + 1 of the other, in a common order of all grams, share one.
    """
    long = texts.select(*key, F.explode("grams").alias("gram")).join(often, "gram", "left")
    ranked = long.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("g"))
    return ranked.select(*key, F.explode(F.slice("g", 1, F.size("g") - F.ceil(F.lit(floor) * F.size("g") - 1e-9).cast("int") + 1)).alias("x")).select(*key, F.col("x.gram").alias("gram"))


def name_index(lists: dict[str, DataFrame], floor: float = FLOOR) -> NameIndex:
    """An index of lists of (id, name), whose order is that of the suggestions. Null and empty names are left out."""
    parts = [df.select(F.lit(k).alias("list"), F.col("id").cast("string").alias("id"), "name") for k, df in enumerate(lists.values())]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    names = written(every.where("name <> ''").select("*", F.lower("name").alias("low"), word_trigrams(F.col("name")).alias("grams")), "names")
    often = written(names.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")), "grams")
    postings = written(_leading(names, ["list", "id"], often, floor), "postings")
    cut = F.transform(F.sequence(F.lit(1), F.least(F.lit(HEAD), F.length("low"))), lambda n: F.substr("low", F.lit(1), n))
    heads = written(names.select(F.explode(cut).alias("head"), "list", "id", "low"), "heads")
    return NameIndex(names, often, postings, heads, floor)


def similar_names(index: NameIndex, queries: DataFrame) -> DataFrame:
    """(q, list, id, name, starts, similarity) of every name that starts with a query q, in any case, or reaches the index's
    floor of word similarity (4 digits). Few queries are sent to the index, more are joined with it."""
    asked = written(queries.where("q <> ''").select("q", F.lower("q").alias("_low"), word_trigrams(F.col("q")).alias("grams")).dropDuplicates(["q"]), "queries")
    rare = sent(_leading(asked.select("q", "grams"), ["q"], index.often, index.floor), BROADCAST_QUERIES * 8)
    heads = sent(asked.select("q", "_low", F.substring("_low", 1, HEAD).alias("head")), BROADCAST_QUERIES)
    alike = index.postings.join(rare, "gram").select("q", "list", "id")
    begin = index.heads.join(heads, "head").where(F.col("low").startswith(F.col("_low"))).select("q", "list", "id")
    met = alike.unionByName(begin).distinct().join(index.names, ["list", "id"]).join(sent(asked.select("q", "_low", F.col("grams").alias("_asked")), BROADCAST_QUERIES), "q")
    both = F.size(F.array_intersect("grams", "_asked"))
    union = F.size("grams") + F.size("_asked") - both
    found = met.select("q", "list", "id", "name", F.col("low").startswith(F.col("_low")).alias("starts"), F.round(F.when(union > 0, both / union).otherwise(0.0), 4).alias("similarity"))
    return found.where(F.col("starts") | (F.col("similarity") >= index.floor))


def suggestions(index: NameIndex, queries: DataFrame, limit: int = LIMIT, reserved: int = RESERVED) -> DataFrame:
    """For each of queries(q) up to `limit` suggestions: (q, position, list, id, name).

    Each list gives its best `limit`: names that start with the query, then the most similar, then by name and id. The first list
    leaves as many of its slots as the others have matches, `reserved` at most; then come the others. Of equal names in
    any case the first stays. A query without letters or digits finds names that start with it only.
    """
    best = Window.partitionBy("q", "list").orderBy(F.desc("starts"), F.desc("similarity"), "name", "id")
    ranked = similar_names(index, queries).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= limit)
    others = F.count_if(F.col("list") > 0).over(Window.partitionBy("q"))
    placed = ranked.withColumn("_free", F.least(F.lit(reserved), others)).where((F.col("list") > 0) | (F.col("_n") <= limit - F.col("_free")))
    once = placed.withColumn("_k", F.row_number().over(Window.partitionBy("q", F.lower("name")).orderBy("list", "_n"))).where("_k = 1")
    return once.withColumn("position", F.row_number().over(Window.partitionBy("q").orderBy("list", "_n"))).where(F.col("position") <= limit).select("q", "position", "list", "id", "name")
