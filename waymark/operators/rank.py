"""Ranking: gates, sub-scores, composite, selection, urgent slot, replay, notification policy."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import travel_minutes
from ..functions.num import clamp, decay, half_away, ramp, renormalised
from ..functions.time import in_quiet_hours
from .folds import accepted

#: The scoring model (fixed values).
WEIGHTS = {
    "warm": {
        "route": {"personal_fit": 0.30, "uniqueness": 0.20, "temporal_urgency": 0.15, "route_fit": 0.15, "novelty": 0.10, "confidence": 0.10},
        "radius": {"personal_fit": 0.35, "uniqueness": 0.23, "temporal_urgency": 0.18, "novelty": 0.12, "confidence": 0.12},
    },
    "cold": {
        "route": {"personal_fit": 0.05, "uniqueness": 0.30, "temporal_urgency": 0.25, "route_fit": 0.15, "novelty": 0.05, "confidence": 0.20},
        "radius": {"personal_fit": 0.06, "uniqueness": 0.35, "temporal_urgency": 0.29, "novelty": 0.06, "confidence": 0.24},
    },
}
PENALTY = {"friction": 0.25, "repetition": 0.15}
FRICTION = {"time": 0.45, "price": 0.25, "queue": 0.15, "weather": 0.20, "effort": 0.15}
TIME_TOLERANCE, PRICE_UNKNOWN, QUEUE = 1.5, 0.3, {"low": 0.1, "medium": 0.4, "high": 0.8}
URGENCY_HALF_LIFE, SPECIAL_FLOOR = 480.0, 0.7
NOVELTY_TYPE, NOVELTY_DOMAIN, NOVELTY_HALF_LIFE_DAYS = 0.6, 0.9, 4.0
NOVELTY_EVENTS = {"visited": 1.0, "accepted": 0.7, "saved": 0.3, "ignored": 0.0}
UNIQUENESS = {"u1": 0.25, "u2": 0.20, "u3": 0.20, "u4": 0.15, "u5": 0.10, "u6": 0.10}
TIERS = {"official": 0.95, "reference": 0.85, "open": 0.70, "community": 0.40}
CORROBORATION, CORROBORATION_CAP, CONFLICT, COVERAGE, COVERAGE_CAP, TIER_D_CAP = 0.05, 0.15, -0.15, -0.05, -0.15, 0.40
FRESHNESS = (0.5, 1.0)
ON_ROUTE_MINUTES, ALLOWANCE = 3.0, 0.35
N_EFF = {"visited": 5.0, "dismissed": 4.0, "saved": 3.0, "accepted": 2.0, "ignored": 0.25}
FULL_WARM, CALIBRATED_FLOOR = 20.0, 0.4
COLD_ALPHA, REPETITION_STEP, BUCKETS = 0.7, 0.5, (45, 120)
CONFIDENCE_FLOOR = 0.25


def reachable(lat: Column, lng: Column, from_lat: Column, from_lng: Column, dwell: Column, remaining: Column, mode: str, to_lat: Column | None = None, to_lng: Column | None = None) -> Column:
    """There, the stay, and back (or onward) within the minutes that remain."""
    there = travel_minutes(from_lat, from_lng, lat, lng, mode)
    on = there if to_lat is None or to_lng is None else travel_minutes(lat, lng, to_lat, to_lng, mode)
    return there + dwell + on <= remaining


def personal_fit(weights: Column, facets: Column) -> Column:
    """Weights: map of facet to weight; unknown facets weigh 0.5, and so does a place without facets."""
    w = F.transform(facets, lambda f: F.coalesce(F.try_element_at(weights, f), F.lit(0.5)))
    return F.when(F.coalesce(F.size(facets), F.lit(0)) <= 0, F.lit(0.5)).otherwise(F.round(0.7 * F.array_max(w) + 0.3 * F.aggregate(w, F.lit(0.0), lambda a, x: a + x) / F.size(w), 4))


def uniqueness(signals: dict[str, Column]) -> Column:
    """Renormalised over the known of u1 to u6; 0.5 without any."""
    known = F.lit(False)
    for v in signals.values():
        known = known | v.isNotNull()
    return F.when(known, renormalised({k: (v, UNIQUENESS[k]) for k, v in signals.items()})).otherwise(0.5)


def temporal_urgency(slack_minutes: Column, special: Column) -> Column:
    """R05."""
    v = decay(F.greatest(F.lit(0.0), slack_minutes), URGENCY_HALF_LIFE)
    return F.round(F.when(special, F.greatest(v, F.lit(SPECIAL_FLOOR))).otherwise(v), 4)


def route_fit(detour: Column, slack: Column, tolerance: Column) -> Column:
    """R06."""
    allowed = F.least(ALLOWANCE * slack, tolerance)
    return F.round(1.0 - ramp(detour, F.lit(ON_ROUTE_MINUTES), F.greatest(allowed, F.lit(ON_ROUTE_MINUTES + 0.01))), 4)


def novelty(n_type: Column, n_domain: Column) -> Column:
    """R07, from the decayed event weights of the same type and of the same domain only."""
    return F.round(F.pow(F.lit(NOVELTY_TYPE), n_type) * F.pow(F.lit(NOVELTY_DOMAIN), n_domain), 4)


def event_weight(event: Column, age_days: Column) -> Column:
    base = F.coalesce(*[F.when(event == e, F.lit(w)) for e, w in NOVELTY_EVENTS.items()], F.lit(0.0))
    return base * decay(age_days, NOVELTY_HALF_LIFE_DAYS)


def with_novelty(candidates: DataFrame, history: DataFrame, trip: str = "trip_id") -> DataFrame:
    """candidates(trip, type, type_domain) with novelty, from what happened on the trip before: history(trip, type,
    type_domain, event, age_days), each event weighed and decayed. Events are summed by type once and joined, never paired."""
    own = history.where("type_domain IS NOT NULL").withColumn("_w", event_weight(F.col("event"), F.greatest(F.lit(0.0), F.col("age_days"))))
    by = own.groupBy(trip, "type_domain", F.col("type").alias("_t")).agg(F.sum("_w").alias("_w"))
    whole = by.groupBy(trip, "type_domain").agg(F.sum("_w").alias("_all"))
    df = candidates.join(whole, [trip, "type_domain"], "left").join(by.withColumnRenamed("_t", "type"), [trip, "type_domain", "type"], "left")
    same, every = F.coalesce("_w", F.lit(0.0)), F.coalesce("_all", F.lit(0.0))
    return df.withColumn("novelty", novelty(same, F.greatest(every - same, F.lit(0.0)))).select(*candidates.columns, "novelty")


def confidence(tiers: Column, conflicts: Column, missing: Column, age_over_ttl: Column) -> Column:
    """Tiers is an array; 0 without evidence; community sources alone stay under their cap."""
    value = lambda t: F.coalesce(*[F.when(t == k, F.lit(v)) for k, v in TIERS.items()], F.lit(0.4))
    cred = F.array_max(F.transform(tiers, value))
    more = F.least((F.size(tiers) - 1) * CORROBORATION, F.lit(CORROBORATION_CAP))
    c = clamp(cred + more + conflicts * CONFLICT + F.greatest(missing * COVERAGE, F.lit(COVERAGE_CAP))) * (1.0 - 0.5 * ramp(age_over_ttl, *FRESHNESS))
    c = F.when(F.forall(tiers, lambda t: t == "community"), F.least(c, F.lit(TIER_D_CAP))).otherwise(c)
    return F.when(F.coalesce(F.size(tiers), F.lit(0)) <= 0, 0.0).otherwise(F.round(c, 4))


def friction(walk: Column, tolerance: Column, bands_above: Column, queue: Column, weather: Column, effort: Column) -> Column:
    """R09."""
    price = F.when(bands_above.isNull(), PRICE_UNKNOWN).when(bands_above <= 0, 0.0).when(bands_above == 1, 0.5).otherwise(1.0)
    wait = F.coalesce(*[F.when(queue == k, F.lit(v)) for k, v in QUEUE.items()], F.lit(QUEUE["low"]))
    raw = FRICTION["time"] * ramp(walk, F.lit(0.0), TIME_TOLERANCE * tolerance) + FRICTION["price"] * price + FRICTION["queue"] * wait + FRICTION["weather"] * weather + FRICTION["effort"] * effort
    return F.round(clamp(raw), 4)


def alpha(counts: dict[str, Column], calibrated: Column) -> Column:
    """How warm a profile is: effective events over FULL_WARM, with a floor after calibration."""
    n = sum((N_EFF[k] * F.coalesce(v, F.lit(0)) for k, v in counts.items()), F.lit(0.0))
    a = clamp(n / FULL_WARM)
    return F.when(calibrated, F.greatest(a, F.lit(CALIBRATED_FLOOR))).otherwise(a)


def blended(scores: dict[str, Column], context: str, a: Column) -> Column:
    """The sub-scores under weights blended by warmth, each rounded before use."""
    warm, cold = WEIGHTS["warm"][context], WEIGHTS["cold"][context]
    return sum((F.round(a * warm[k] + (1 - a) * cold[k], 4) * F.coalesce(scores.get(k, F.lit(0.0)), F.lit(0.0)) for k in warm), F.lit(0.0))


def composite(scores: dict[str, Column], context: str, a: Column, friction_raw: Column, repetition_raw: Column) -> Column:
    """R10."""
    return F.round(blended(scores, context, a) - PENALTY["friction"] * friction_raw - PENALTY["repetition"] * repetition_raw, 4)


def hold_reason(tiers: Column, conf: Column) -> Column:
    """Null for what may be served."""
    return (
        F.when(F.coalesce(F.size(tiers), F.lit(0)) <= 0, "no_evidence")
        .when(F.forall(tiers, lambda t: t == "community"), "tier_d_only")
        .when(conf < CONFIDENCE_FLOOR, "below_confidence_floor")
    )


#: Shares into which a class of candidates is dealt for a first pruning, so no task gets a whole hot class.
DEALT = 32


def _bucket(minutes: Column) -> Column:
    return F.when(minutes <= BUCKETS[0], "short").when(minutes <= BUCKETS[1], "medium").otherwise("long")


def _inert_out(rows: DataFrame, session: str, need: int) -> DataFrame:
    """rows without those that the greedy selection can neither pick nor be swayed by.

    Candidates of one class (domain, set of facets, duration bucket, warm or cold) are treated alike at every step. One that
    `need` others of its class precede in the input order, each better by more than what a fresh bucket and rounding can
    make up, is always beaten by one of them that was looked at before. A class keeps about need * (1 + ln(n / need))
    of its n candidates in no particular order. Each class is read as a stream with the best `need` values as its state,
    first in DEALT shares by themselves, then what is left as a whole.
    """
    by = [session, "type_domain", "_set", "_bucket", "_cold"]

    def step(state: tuple | None, row: tuple) -> tuple[tuple, bool]:
        best, whole = state or (), row[0]
        if len(best) == need and best[0] > whole + FRESH_BUCKET + 2e-4:
            return best, False
        kept = sorted((*best, whole))
        return tuple(kept[-need:]), True

    classed = rows.withColumns({"_set": F.array_join(F.array_distinct("facets"), "\x1f"), "_bucket": _bucket(F.col("total_minutes")), "_cold": F.col("alpha") < COLD_ALPHA})
    classed = classed.withColumn("_share", F.pmod(F.xxhash64("ordinal", "place_id"), F.lit(DEALT)))
    few = accepted(classed, [*by, "_share"], ("ordinal",), ("whole",), step)
    return accepted(few, by, ("ordinal",), ("whole",), step).drop("_set", "_bucket", "_cold", "_share")


FRESH_BUCKET = 0.001


def _greedy(left: list, k: int) -> list[tuple]:
    """(candidate, composite) of the picks from candidates in input order."""
    left, out = list(left), []
    domains: dict[str, int] = {}
    facets: set[str] = set()
    buckets: set[str] = set()
    while left and len(out) < k:
        best = None
        for probing in (True, False):
            for c in left:
                own = set(c.facets) if c.facets is not None else set()
                if probing and c.alpha < COLD_ALPHA and len(left) >= 2 and facets and own and own <= facets:
                    continue
                repeat = min(1.0, REPETITION_STEP * domains.get(c.type_domain, 0))
                whole = half_away(c.whole - PENALTY["repetition"] * repeat, 4)
                bucket = "short" if c.total_minutes <= BUCKETS[0] else "medium" if c.total_minutes <= BUCKETS[1] else "long"
                score = whole
                if best is not None and bucket not in buckets and best[2] in buckets and abs(score - best[0]) < 0.02:
                    score += FRESH_BUCKET
                if best is None or score > best[0]:
                    best = (score, whole, bucket, c)
            if best is not None:
                break
        if best is None:
            break
        _, whole, bucket, c = best
        left.remove(c)
        domains[c.type_domain] = domains.get(c.type_domain, 0) + 1
        facets |= set(c.facets) if c.facets is not None else set()
        buckets.add(bucket)
        out.append((c, whole))
    return out


def select_verified(candidates: DataFrame, k: int, context: str = "radius", session: str = "session_id", rounds: int = 1) -> DataFrame:
    """(session, place_id, position, composite, shut): the greedy diverse top k of each session.

    candidates(session, place_id, ordinal, type_domain, facets, total_minutes, friction_raw, alpha, a column per sub-score,
    and is_open where rounds > 1). Each pick is penalised for domains picked before; while cold, candidates of facets already
    probed are passed over unless nothing else is left; a fresh duration bucket gains .001 among near equals. Input order
    (ordinal) breaks ties. Of `rounds` rounds each drops the picks of the one before that are known to be shut; picks of
    the last that are shut, and all dropped ones, come back as shut rows without a position. All rounds are one fold, over what
    is left of each session when the candidates that cannot matter are gone (_inert_out).
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal", kind="stable")
        left, shut, out = list(pdf.itertuples(index=False)), [], []
        for _ in range(rounds):
            out = _greedy(left, k)
            closed = {id(c) for c, _ in out if c.is_open is False or c.is_open == 0} if rounds > 1 else set()
            shut += [c for c, _ in out if id(c) in closed]
            left = [c for c in left if id(c) not in closed]
            out = [x for x in out if id(x[0]) not in closed] if closed else out
            if not closed:
                break
        key = pdf[session].iloc[0]
        served = [(key, c.place_id, i + 1, whole, False) for i, (c, whole) in enumerate(out)]
        return pd.DataFrame(served + [(key, c.place_id, None, None, True) for c in shut], columns=[session, "place_id", "position", "composite", "shut"]).astype({"position": "Int64", "composite": "Float64"})

    kinds = dict(candidates.dtypes)
    whole = blended({t: F.col(t) for t in WEIGHTS["warm"][context]}, context, F.col("alpha")) - PENALTY["friction"] * F.col("friction_raw")
    known = F.col("is_open") if rounds > 1 else F.lit(None).cast("boolean")
    some = candidates.select(session, "place_id", "ordinal", "type_domain", F.sort_array("facets").alias("facets"), "total_minutes", "alpha", whole.alias("whole"), known.alias("is_open"))
    few = _inert_out(some, session, k * rounds)
    return few.groupBy(session).applyInPandas(pick, f"{session} {kinds[session]}, place_id {kinds['place_id']}, position long, composite double, shut boolean")


def select_diverse(candidates: DataFrame, k: int, context: str = "radius", session: str = "session_id") -> DataFrame:
    """select_verified of one round: (session, place_id, position, composite)."""
    return select_verified(candidates, k, context, session).select(session, "place_id", "position", "composite")


def rank_all(candidates: DataFrame, session: str = "session_id") -> DataFrame:
    """Every candidate by composite, without diversity."""
    w = Window.partitionBy(session).orderBy(F.desc("composite"), "place_id")
    return candidates.withColumn("position", F.row_number().over(w))


def urgent_first(feed: DataFrame, now: Column, horizon_minutes: int = 120, session: str = "session_id") -> DataFrame:
    """The item that closes first within the horizon, if any, takes the first place; the others keep their order."""
    soon = F.col("closes_at").isNotNull() & (F.col("closes_at") > now) & (F.col("closes_at") <= now + F.make_interval(mins=F.lit(horizon_minutes)))
    w = Window.partitionBy(session)
    first = F.min(F.when(soon, F.struct("closes_at", "position"))).over(w)["position"]
    marked = feed.withColumn("urgent", F.coalesce(F.col("position") == first, F.lit(False)))
    return marked.withColumn("position", F.row_number().over(Window.partitionBy(session).orderBy(F.desc("urgent"), "position")))


def replay_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Each served place as same, moved, dropped or new."""
    b, a = before.select(*key, F.col("position").alias("was")), after.select(*key, F.col("position").alias("now"))
    both = b.join(a, key, "full")
    return both.withColumn("change", F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "dropped").when(F.col("was") == F.col("now"), "same").otherwise("moved"))


#: Notification policy (fixed values).
POLICY = {
    "min_confidence": 0.55, "max_evidence_age_days": 7.0, "max_detour_minutes": 20, "quiet": (22, 8), "max_per_day": 3, "cooldown_minutes": 60, "urgent": (0.85, 0.85, 0.75),
    "boost": {"time_sensitive": 0.30, "strong_preference": 0.20, "rare": 0.20, "last_chance": 0.15}, "last_chance_minutes": 45, "penalty": 0.20, "per_push": 0.5,
}


def notification_decision(df: DataFrame) -> DataFrame:
    """Adds denied_by (the first gate that fails, null if allowed) and priority.

    Columns: in_trip_mode, local_hour, movement_mode, pushable, confidence, open_now, detour_minutes, evidence_age_days,
    domain_rejected, urgency, personal_fit, uniqueness, composite, sent_today, sent_recently, minutes_since_sent,
    minutes_to_close. Unknown detours are not refused; an urgent candidate is spared the cooldown, never the daily budget.
    """
    c, p = F.col, POLICY
    near = F.coalesce(c("detour_minutes") <= p["max_detour_minutes"], F.lit(True))
    gates = {
        "trip_mode_off": c("in_trip_mode"), "quiet_hours": ~in_quiet_hours(c("local_hour"), *p["quiet"]), "driving": ~c("movement_mode").eqNullSafe("driving"), "not_pushable": c("pushable"),
        "low_confidence": c("confidence") >= p["min_confidence"], "not_open": c("open_now"), "detour_too_far": near, "stale_evidence": c("evidence_age_days") <= p["max_evidence_age_days"],
        "category_rejected": ~F.coalesce(c("domain_rejected"), F.lit(False)), "daily_budget": c("sent_today") < p["max_per_day"],
    }
    a, b, d = p["urgent"]
    urgent = (c("confidence") > a) & (c("urgency") > b) & (c("personal_fit") > d) & near
    cooling = F.coalesce(c("minutes_since_sent") < p["cooldown_minutes"], F.lit(False))
    denied = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(g)) for g, ok in gates.items()], F.when(~urgent & cooling, F.lit("cooldown")))
    w = p["boost"]
    boost = (
        F.when(c("urgency") > 0.5, w["time_sensitive"] * c("urgency")).otherwise(0.0) + F.when(c("personal_fit") > 0.7, w["strong_preference"] * c("personal_fit")).otherwise(0.0)
        + F.when(c("uniqueness") > 0.7, w["rare"] * c("uniqueness")).otherwise(0.0) + F.when(c("minutes_to_close") <= p["last_chance_minutes"], w["last_chance"]).otherwise(0.0)
    )
    penalty = F.round(p["penalty"] * F.least(F.lit(1.0), c("sent_recently") * p["per_push"]), 4)
    return df.withColumn("denied_by", denied).withColumn("priority", F.when(denied.isNull(), F.round(c("composite") + boost - penalty, 4)))
