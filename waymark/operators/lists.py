"""Smaller reads: digests, kept lists, explanations, anchors, claims, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import metres
from .feedback import last_of
from .folds import accepted
from .privacy import listed

DRIFT_M, DRIFT_S, MOST_SERVES, DIGEST_ITEMS = 400.0, 120, 20, 5


def kept_list(recommendations: DataFrame, events: DataFrame, images: DataFrame, on: str, off: str) -> DataFrame:
    """Recommendations whose last toggle is on, with when and the place's first image by id."""
    state = events.groupBy("rec_id").agg(F.coalesce(last_of("event", on, off), F.lit(False)).alias("is_on"), F.max(F.when(F.col("event") == on, F.col("ts"))).alias("kept_at")).where("is_on")
    first = images.groupBy("place_id").agg(F.min_by("url", "image_id").alias("image"))
    return recommendations.join(state.select("rec_id", "kept_at"), "rec_id").join(first, "place_id", "left")


def digest(traces: DataFrame, live: DataFrame, most: int = DIGEST_ITEMS) -> DataFrame:
    """Per user the first sighting of each held or missed place that is still live, `most` at the most.

    traces(user_id, ts, items array<struct<place_id, reason>>); the order, which the reference leaves open, is by time and place.
    """
    seen = traces.select("user_id", "ts", F.explode("items").alias("i")).select("user_id", "ts", "i.*").join(live.select("place_id"), "place_id", "left_semi")
    one = seen.withColumn("_n", F.row_number().over(Window.partitionBy("user_id", "place_id").orderBy("ts", "reason"))).where("_n = 1")
    return one.withColumn("position", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "place_id"))).where(F.col("position") <= most).select("user_id", "place_id", "reason", "position")


def drift_anchors(fixes: DataFrame, key: str = "user_id", least_m: float = DRIFT_M, least_s: int = DRIFT_S, most: int = MOST_SERVES, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The fixes at which a session is served anew; its first one serves always.

    A fix serves if it lies least_m (its own accuracy_m, if that is known and larger) from the place and least_s from the
    time of the last serve, and fewer than `most` have been served.
    """

    def step(state: tuple | None, row: tuple) -> tuple[tuple, bool]:
        at, lat, lng, accuracy = row
        if state is None:
            return (at, lat, lng, 1), True
        last, lat0, lng0, serves = state
        far = metres(lat0, lng0, lat, lng) >= max(least_m, accuracy if accuracy == accuracy and accuracy is not None else 0.0)
        if serves < most and (at - last).total_seconds() >= least_s and far:
            return (at, lat, lng, serves + 1), True
        return state, False

    known = fixes if "accuracy_m" in fixes.columns else fixes.withColumn("accuracy_m", F.lit(None).cast("double"))
    return accepted(known.where("lat IS NOT NULL AND lng IS NOT NULL"), [key], order, (order[0], "lat", "lng", "accuracy_m"), step).select(*fixes.columns)


def explained(scores: DataFrame, key: list[str], terms: list[str]) -> DataFrame:
    """One row per sub-score of a trace, the largest first."""
    items = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(t).cast("double").alias("value"), F.lit(i).alias("_o")) for i, t in enumerate(terms)]))
    long = scores.select(*key, items.alias("x")).select(*key, "x.*")
    return long.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("value"), "_o"))).drop("_o")


def unresolved(items: DataFrame, decisions: DataFrame, version: str, tiers: dict[str, int]) -> DataFrame:
    """Items without a decision of this resolver version, by tier, source and id."""
    todo = items.join(decisions.where(F.col("resolver_version") == version).select("id"), "id", "left_anti")
    rank = F.coalesce(*[F.when(F.col("tier") == t, F.lit(n)) for t, n in tiers.items()], F.lit(len(tiers)))
    return todo.withColumn("turn", F.row_number().over(Window.partitionBy("cell").orderBy(rank, "source", "id")))


def claimed_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source, external_id, place_id): direct contributions repoint an id, references only claim free ones, first come first."""
    direct = new.where("direct").groupBy("source", "external_id").agg(F.max_by("place_id", "at").alias("place_id"))
    kept = old.join(direct.select("source", "external_id"), ["source", "external_id"], "left_anti").select("source", "external_id", "place_id").unionByName(direct)
    refs = new.where("NOT direct").groupBy("source", "external_id").agg(F.min_by("place_id", "at").alias("place_id"))
    return kept.unionByName(refs.join(kept.select("source", "external_id"), ["source", "external_id"], "left_anti"))


def merged_places(places: DataFrame, merges: DataFrame) -> DataFrame:
    """Places with those merged into them folded in: names and facets united, the canonical id's name first."""
    m = merges.select(F.col("merged_id").alias("_m"), F.col("canonical_id").alias("_c"))
    p = places.join(m, F.col("place_id") == F.col("_m"), "left").withColumn("own", F.coalesce("_c", "place_id"))
    out = p.groupBy("own").agg(F.min_by("name", F.struct(F.col("_c").isNotNull(), F.col("place_id"))).alias("name"), F.sort_array(F.collect_set("name")).alias("names"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("facets")))).alias("facets"))
    return out.select(F.col("own").alias("place_id"), "name", F.array_remove("names", F.col("name")).alias("alt_names"), "facets")


def gold_pairs(scored: DataFrame, explicit: DataFrame, negatives: int = 400, ambiguous: int = 60, review: float = 0.60) -> DataFrame:
    """Explicit positives, disjoint negatives (over 100 m, other domain) and ambiguous pairs, each capped by score and key."""
    key = F.concat_ws("|", F.least("a_id", "b_id"), F.greatest("a_id", "b_id"))
    known = explicit.select(key.alias("pair")).distinct()
    rest = scored.withColumn("pair", key).join(known, "pair", "left_anti").dropDuplicates(["pair"])
    no = rest.where((F.col("distance_m") > 100) & (F.col("a_domain") != F.col("b_domain"))).orderBy(F.desc("score"), "pair").limit(negatives).select("pair", F.lit("distinct").alias("label"))
    maybe = rest.where((F.col("score") >= review - 0.05) & ~((F.col("distance_m") > 100) & (F.col("a_domain") != F.col("b_domain")))).orderBy(F.desc("score"), "pair").limit(ambiguous).select("pair", F.lit("ask").alias("label"))
    return known.withColumn("label", F.lit("match")).unionByName(no).unionByName(maybe)


def next_unanswered(pairs: DataFrame, answers: DataFrame, users: DataFrame) -> DataFrame:
    """Q05: per user the smallest pair number without an answer; null if all are answered. pairs is a short fixed list."""
    every = pairs.agg(F.sort_array(F.collect_set("pair")).alias("_all"))  # one row
    done = answers.groupBy("user_id").agg(F.collect_set("pair").alias("_done"))
    own = users.select("user_id").distinct().join(done, "user_id", "left").crossJoin(F.broadcast(every))
    return own.select("user_id", F.array_min(F.array_except("_all", F.coalesce("_done", F.array()))).alias("next_pair"))


def consent(current: str, granted_at: Column, version: Column) -> Column:
    """Q06."""
    return F.coalesce(granted_at.isNotNull() & (version == current), F.lit(False))


def dashboard(users: DataFrame, roles: DataFrame, key: str, recent: Column) -> DataFrame:
    """Q01: one row: users, those that have a role (a semi join with roles(key)), and those of the last days."""
    marked = users.join(roles.select(key).distinct().withColumn("_role", F.lit(True)), key, "left")
    return marked.agg(F.count("*").alias("users"), F.count("_role").alias("with_role"), F.count_if(F.coalesce(recent, F.lit(False))).alias("recent"))


def page_with(rows: DataFrame, order: list[Column], limit: int, offset: int, related: DataFrame, key: str, related_key: str, related_order: list[Column]) -> DataFrame:
    """Q02: a page of rows with their related rows as an ordered array, and the total of rows. The page is cut first, so only
    its own related rows are gathered."""
    page = rows.orderBy(*order).offset(offset).limit(limit)
    own = related.join(F.broadcast(page.select(F.col(key).alias("_k"))), F.col(related_key) == F.col("_k"), "left_semi")  # `limit` keys
    many = own.groupBy(F.col(related_key).alias("_k")).agg(listed(related_order, *related.columns).alias("related"))
    total = rows.agg(F.count("*").alias("total"))
    return page.crossJoin(F.broadcast(total)).join(many, F.col(key) == F.col("_k"), "left").drop("_k").withColumn("related", F.coalesce("related", F.array()))
