"""Named cases as small tables, and plain versions of the sequential operators."""

import random
import unicodedata
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, num, text
from waymark.operators import cost, curation, feed, feedback, rank, resolve, tables, tiles, trajectory

T0 = datetime(2026, 8, 1, 14, 0)


def track(spark, minutes, lat=59.3255, lng=18.0705, user=1, start=T0):
    rows = [(i, start + timedelta(minutes=5 * i), user, lat, lng + (i % 3) * 1e-5) for i in range(minutes // 5 + 1)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, lat double, lng double")


def visit(spark, fixes, settled=()):
    served = spark.createDataFrame([(7, 1, T0 - timedelta(hours=5), 59.3255, 18.0705)], "rec_id long, user_id long, served_at timestamp, lat double, lng double")
    return trajectory.visits(trajectory.dwells(fixes), served, spark.createDataFrame([(x,) for x in settled], "rec_id long")).count()


def test_visits(spark):
    assert visit(spark, track(spark, 20)) == 1
    assert visit(spark, track(spark, 4)) == 0
    assert visit(spark, track(spark, 40, lat=59.3310)) == 0
    assert visit(spark, track(spark, 20), settled=[7]) == 0
    assert visit(spark, track(spark, 20).limit(0)) == 0


@pytest.mark.parametrize(("kind", "points"), [
    ("travel", [(59.3293, 18.0686, 8), (59.0, 17.0, 11), (58.2, 13.5, 14), (57.7089, 11.9746, 17)]),
    ("sightseeing", [(59.3250, 18.0700, 9), (59.3350, 18.0900, 11), (59.3400, 18.0500, 13), (59.3200, 18.0400, 16), (59.3250, 18.0700, 19)]),
    ("relaxation", [(59.3250, 18.0700, 9), (59.3252, 18.0704, 12), (59.3249, 18.0698, 16), (59.3250, 18.0700, 19)]),
])
def test_segments(spark, kind, points):
    rows = [(i, datetime(2026, 8, 1, h), 1, a, b) for i, (a, b, h) in enumerate(points)]
    f = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, lat double, lng double")
    cell = F.concat_ws(":", F.floor(F.col("lat") * 100), F.floor(F.col("lng") * 100))
    assert trajectory.day_segments(f, cell).first().kind == kind


def test_home(spark):
    rows, k = [], 0
    for day in range(14):
        for h, d in ((7, 0.0), (13, 0.03), (22, 0.0)):
            rows.append((k, datetime(2026, 6, 1 + day, h, 30), 1, 59.3120 + d, 18.0700 + d))
            k += 1
    f = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, lat double, lng double")
    r = trajectory.home_cells(f, F.concat_ws(":", F.floor(F.col("lat") * 100), F.floor(F.col("lng") * 100))).collect()
    assert [(x.cell, x.nights) for x in r] == [("5931:1807", 14)]


def test_throttle_and_trips(spark):
    f = track(spark, 30)
    assert trajectory.throttled(f, ["user_id"]).count() == 4  # at 0, 10, 20 and 30 minutes
    s = spark.createDataFrame([(1, 1, datetime(2026, 1, 1), 59.0, 18.0), (2, 1, datetime(2026, 1, 3), 59.5, 18.0), (3, 1, datetime(2026, 1, 8), 59.0, 18.0), (4, 1, datetime(2026, 1, 9), 55.0, 13.0)], "session_id long, user_id long, started_at timestamp, lat double, lng double")
    assert [r.trip for r in trajectory.trips(s).orderBy("session_id").collect()] == [1, 1, 2, 3]


FACT = "day date, user_id long, actor string, category string, vendor string, resource string, region_key string, billed long, would long, cached boolean, calls long, cpu_ms long"


def fact(user, billed, would, actor="user", region="r", resource="m"):
    return (datetime(2026, 1, 1).date(), user, actor, "llm", "gemini", resource, region, billed, would, billed == 0, 1, 1)


def test_amortise(spark):
    f = spark.createDataFrame([fact(1, 600, 600), fact(2, 0, 600)], FACT)
    r = {x.user_id: x for x in cost.rollup(f).collect()}
    assert (r[1].billed, r[2].billed, r[1].amortized, r[2].amortized) == (600, 0, 300, 300)


def test_capex(spark):
    f = spark.createDataFrame([fact(None, 8000, 8000, "system"), fact(1, 600, 600), fact(2, 600, 600)], FACT)
    r = {x.user_id: x for x in cost.rollup(f).collect()}
    assert (r[1].capex_share, r[2].capex_share, r[1].billed, r[None].billed, r[None].amortized) == (4000, 4000, 600, 8000, 8000)


def test_rollup_keeps_emulated_spend_and_is_repeatable(spark):
    f = spark.createDataFrame([fact(1, 5000, 5000, "admin_emulated"), fact(1, 600, 600)], FACT)
    one, two = (sorted(map(str, cost.rollup(f).collect())) for _ in range(2))
    assert one == two
    assert cost.rollup(f).where("actor = 'admin_emulated'").first().amortized == 5000
    assert cost.rollup(f.limit(0)).count() == 0


CAND = "names array<string>, lat double, lng double, type string, domain string"


def score(spark, a, b):
    d = spark.createDataFrame([(*a, *b)], ", ".join(f"{p}_{c.strip()}" for p in "ab" for c in CAND.split(",")))
    return resolve.scored_pairs(d).first()


def test_match_scores(spark):
    church = (["Storkyrkan"], 59.3255, 18.0705, "church", "religious_sacred")
    r = score(spark, church, church)
    assert (r.score, r.band) == (1.0, "high")
    r = score(spark, (["Storkyrkan", "Stockholms domkyrka"], 59.32555, 18.07055, "church", "religious_sacred"), (["Sankt Nikolai kyrka", "Storkyrkan"], 59.32550, 18.07080, "church", "religious_sacred"))
    assert (r.band, r.name_sim) == ("high", 1.0)
    assert score(spark, (["Galleri Duerr"], 59.3200, 18.0700, "gallery", "museum_gallery"), (["Galleri Dover"], 59.3205, 18.0710, "gallery", "museum_gallery")).band == "review"
    assert score(spark, (["Kaffebar Norr"], 59.3200, 18.0700, "cafe", "food_drink"), (["Antikvariat Söder"], 59.3210, 18.0730, "antique_shop", "shopping")).band == "distinct"
    r = score(spark, (["Espresso House"], 59.3200, 18.0700, "cafe", "food_drink"), (["Espresso House"], 59.3236, 18.0700, "cafe", "food_drink"))
    assert r.band != "high" and r.name_sim == 1.0
    assert score(spark, (["Café Sten Sture"], 59.32, 18.07, "cafe", "food_drink"), (["Cafe Sten Sture"], 59.32, 18.07, "cafe", "food_drink")).name_sim > 0.95
    plain = (["Järnpojken"], 59.3251, 18.0745, "monument", "historic_heritage")
    assert score(spark, plain, plain).score == 1.0
    unknown = (["Järnpojken"], 59.3251, 18.0745, None, None)
    assert score(spark, unknown, unknown).score == 0.8235  # a type that is unknown is compatible with none


def test_composite(spark):
    lit = {k: F.lit(v) for k, v in {"personal_fit": 0.86, "uniqueness": 0.74, "temporal_urgency": 0.91, "route_fit": 0.70, "novelty": 0.80, "confidence": 0.82}.items()}
    fr = rank.friction(F.lit(7.0), F.lit(15.0), F.lit(0), F.lit("low"), F.lit(0.0), F.lit(0.0))
    r = spark.range(1).select(fr.alias("f"), rank.composite(lit, "route", F.lit(1.0), fr, F.lit(0.0)).alias("c"), rank.composite(lit, "route", F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("w")).first()
    assert r.f == pytest.approx(0.155, abs=0.005) and r.c == pytest.approx(0.77, abs=0.005) and r.w == pytest.approx(0.8095, abs=0.0005)


def test_alpha_and_sub_scores(spark):
    tiers = lambda *t: F.array(*[F.lit(x) for x in t])
    r = spark.range(1).select(
        rank.alpha({}, F.lit(False)), rank.alpha({}, F.lit(True)), rank.alpha({"visited": F.lit(4)}, F.lit(False)),
        rank.uniqueness({"u1": F.lit(None).cast("double"), "u4": F.lit(0.0), "u6": F.lit(0.8)}), rank.confidence(tiers("community"), F.lit(0), F.lit(0), F.lit(0.0)),
        rank.confidence(tiers("open", "reference"), F.lit(0), F.lit(0), F.lit(0.0)), rank.confidence(tiers("open", "reference"), F.lit(0), F.lit(0), F.lit(1.0)),
    ).first()
    assert tuple(r) == (0.0, 0.4, 1.0, 0.32, 0.4, 0.9, 0.45)


SEL = "session_id long, place_id string, ordinal long, type_domain string, facets array<string>, total_minutes double, friction_raw double, alpha double, personal_fit double, uniqueness double, temporal_urgency double, novelty double, confidence double"


def selection(spark, items, alpha):
    rows = [(1, n, i, d, f, 30.0, 0.0, alpha, v, v, v, v, v) for i, (n, d, f, v) in enumerate(items)]
    return [r.place_id for r in rank.select_diverse(spark.createDataFrame(rows, SEL), 3).orderBy("position").collect()]


def test_selection(spark):
    warm = [("Church A", "religious", ["s"], 0.9), ("Church B", "religious", ["s"], 0.89), ("Church C", "religious", ["s"], 0.88), ("Cafe D", "food", ["f"], 0.86)]
    got = selection(spark, warm, 1.0)
    assert got[0] == "Church A" and "Cafe D" in got
    cold = [("Church A", "religious", ["s", "h"], 0.9), ("Chapel B", "religious", ["s"], 0.89), ("Viewpoint C", "nature", ["v"], 0.5), ("Cafe D", "food", ["f"], 0.5)]
    assert selection(spark, cold, 0.2) == ["Church A", "Viewpoint C", "Cafe D"]


@pytest.mark.parametrize(("mode", "minutes", "want"), [("walk", 180, True), ("walk", 120, False), ("bike", 120, True), ("bike", 70, False), ("drive", 75, True)])
def test_reachability(spark, mode, minutes, want):
    ok = rank.reachable(F.lit(59.3260), F.lit(18.1150), F.lit(59.3255), F.lit(18.0705), F.lit(60.0), F.lit(float(minutes)), mode)
    assert spark.range(1).select(ok).first()[0] is want


def test_evidence_gate(spark):
    e = spark.createDataFrame([([], 0.9), (["community"], 0.4), (["open"], 0.2), (["open", "community"], 0.5)], "tiers array<string>, c double")
    assert [r[0] for r in e.select(rank.hold_reason(F.col("tiers"), F.col("c"))).collect()] == ["no_evidence", "tier_d_only", "below_confidence_floor", None]


def test_toggles_and_learning(spark):
    rows = [(1, T0, 1, "saved"), (2, T0 + timedelta(1), 1, "unsaved"), (3, T0 + timedelta(2), 1, "dismissed"), (4, T0 + timedelta(3), 1, "saved")]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp, rec long, event_type string")
    r = feedback.toggle_states(e, ["rec"], {"kept": ("saved", "unsaved"), "dismissed": ("dismissed", "undismissed")}).first()
    assert r.kept and r.dismissed
    assert feedback.contradictions(e, ["rec"], ("saved", "unsaved"), ("dismissed", "undismissed")).first().undo == "undismissed"
    w = spark.range(1).select(feedback.learned_weight(F.array(F.lit("dismissed"), F.lit("undismissed"))), feedback.learned_weight(F.array(F.lit("shrug"), F.lit("visited"))), feedback.learned_weight(F.array(F.lit("undismissed")))).first()
    assert tuple(w) == (0.5, 0.65, None)


def test_tables(spark):
    a = spark.createDataFrame([(1, 10, "x"), (1, 20, "y")], "k long, t long, v string")
    assert tables.latest(a, ["k"], [F.desc("t")]).first().v == "y"
    old = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    new = spark.createDataFrame([(2, "b"), (3, "c")], "k long, v string")
    assert {tuple(r) for r in tables.upsert(old, new, ["k"], [F.col("v")]).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert {tuple(r) for r in tables.fill_if_null(old, new, ["k"], ["v"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    p = spark.createDataFrame([(1, 1.0), (2, 1.0)], "k long, v double").withColumn("g", F.lit(1))
    assert {r[0] for r in p.select(tables.percentile_of("v", ["g"])).collect()} == {None}


def test_coverage_and_violations(spark):
    o = spark.createDataFrame([(1, 59.33, 18.06)], "session_id long, lat double, lng double")
    c = {r.part: r["count"] for r in tiles.coverage(o, F.lit(9000.0)).groupBy("part").count().collect()}
    assert c["near"] >= 1 and c["near"] + c["far"] == 180 and c["pending"] > 0
    v = curation.violations(F.lit(""), F.lit(False), F.lit(0), F.array(F.lit("NC")))
    assert spark.range(1).select(v).first()[0] == ["not_grounded", "no_evidence", "license_not_allowed", "empty_claim"]
    grids = tiles.region_grids(spark.createDataFrame([("a", 59.0, 17.0, 60.0, 19.0), ("b", 1.0, 1.0, 1.0, 1.0)], "region_key string, south double, west double, north double, east double"), most=128)
    n = {r.region_key: r["count"] for r in grids.groupBy("region_key").count().collect()}
    assert n == {"a": 50, "b": 1}


def test_policy_names_the_first_gate(spark):
    cols = "in_trip_mode boolean, local_hour int, movement_mode string, pushable boolean, confidence double, open_now boolean, detour_minutes int, evidence_age_days double, domain_rejected boolean, urgency double, personal_fit double, uniqueness double, composite double, sent_today int, sent_recently int, minutes_since_sent int, minutes_to_close int"
    good = (True, 12, "walking", True, 0.9, True, None, 1.0, False, 0.2, 0.5, 0.5, 0.6, 0, 0, None, None)
    rows = [good, (False, *good[1:]), (True, 23, *good[2:]), (True, 12, "driving", *good[3:]), (*good[:13], 3, 0, None, None), (*good[:15], 10, None), (*good[:9], 0.9, 0.9, 0.5, 0.6, 0, 0, 10, None)]
    got = [r.denied_by for r in rank.notification_decision(spark.createDataFrame(rows, cols)).collect()]
    assert got == [None, "trip_mode_off", "quiet_hours", "driving", "daily_budget", "cooldown", None]


def half_up(x, digits=4):
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def test_half_away():
    assert [num.half_away(x, 4) for x in (0.00005, -0.00005, 0.12345, 2.00015)] == [0.0001, -0.0001, 0.1235, 2.0002]


def plain_score(a, b):
    """Scores of two items, from plain definitions."""
    def fold(s):
        return "".join(c for c in unicodedata.normalize("NFKD", s.lower().replace("ß", "ss")) if not unicodedata.combining(c))

    def grams(s):
        s = f"  {fold(s)} "
        return {s[i : i + 3] for i in range(len(s) - 2)}

    tri = max((len(grams(x) & grams(y)) / len(grams(x) | grams(y)) for x in a["names"] for y in b["names"]), default=0.0)
    sim = max([tri, *(text.jaro_winkler_of(f(x), f(y)) for x in a["names"] for y in b["names"] for f in (str.lower, fold))])
    sim = half_up(sim)
    m = geo.metres(a["lat"], a["lng"], b["lat"], b["lng"], geo.RADIUS["match"])
    domain = a["domain"] or b["domain"]
    big = domain in resolve.BUILDING
    radius = 500.0 if domain in resolve.NATURE else 150.0 if big else 100.0
    radius = 250.0 if big and sim >= 0.95 else radius
    pair = {a["type"], b["type"]}
    compat = 0.0 if None in pair else 1.0 if len(pair) == 1 else 0.6 if a["domain"] == b["domain"] else 0.3 if any(pair == set(p) for p in resolve.COMPATIBLE) else 0.0
    score = (0.45 * sim + 0.25 * half_up(max(0.0, 1 - min(1.0, m / radius))) + 0.15 * compat) / 0.85
    chain = pair & set(resolve.CHAIN_TYPES) and m > 250 and any(fold(x) == fold(y) for x in a["names"] for y in b["names"])
    band = "high" if score >= 0.82 and not chain else "review" if score >= 0.6 else "distinct"
    return m, tri, score, band


def plain_article(raw):
    """The key of an article, for the two spellings in use here."""
    if raw and raw.startswith("https://"):
        lang, _, title = raw.removeprefix("https://").partition(".wikipedia.org/wiki/")
        return f"{lang}:{title.replace('%20', '_')}"
    return raw.replace(" ", "_") if raw else None


def plain_resolution(items):
    """One item after another against all places there are, each of which is what its items have left in it."""
    places, registry, out = [], {}, {}
    order = {"geometry": {"osm": 3, "overture": 2, "wikidata": 1}, "type": {"overture": 3, "osm": 2, "wikidata": 1}}
    for i in sorted(items, key=lambda i: (i["tier"], i["source"], i["external_id"], i["id"])):
        qid = i["external_id"] if i["source"] == "wikidata" else i["refs"].get("wikidata")
        claims = [(k, v) for k, v in (("wikidata", qid), ("wikipedia", plain_article(i["refs"].get("wikipedia")))) if v]
        known = next((registry[c] for c in claims if c in registry), None)
        target, kind = None, "distinct"
        if known is not None:
            target = next(p for p in places if p["id"] == known)
            kind = "explicit" if geo.metres(i["lat"], i["lng"], target["lat"], target["lng"], geo.RADIUS["match"]) <= 1000 else "review"
        else:
            best = None
            for p in places:
                m, tri, score, found = plain_score(i, p)
                if m <= 350 and ((i["type"] and i["domain"] == p["domain"]) or tri >= 0.3) and (best is None or half_up(score) > best[0]):
                    best = (half_up(score), found, p)
            if best:
                kind, target = best[1], best[2]
        if kind in ("explicit", "high"):
            away = geo.metres(i["lat"], i["lng"], target["lat"], target["lng"], geo.RADIUS["match"])
            far, other = (round(away) if away > 150 else None), None
            target["names"] += [n for n in i["names"] if n not in target["names"]]

            def weight(source, tier):
                return 3 if tier == 0 else 2 if source == "osm" else 1

            if weight(i["source"], i["tier"]) > weight(target["by"]["name"], i["tier"] if target["by"]["name"] == i["source"] else None):
                target["name"], target["by"]["name"] = i["names"][0], i["source"]
            if order["geometry"].get(i["source"], 0) > order["geometry"].get(target["by"]["geometry"], 0):
                target["lat"], target["lng"], target["by"]["geometry"] = i["lat"], i["lng"], i["source"]
            if i["type"]:
                better = target["type"] is None or order["type"].get(i["source"], 0) > order["type"].get(target["by"]["type"], 0)
                if target["type"] not in (None, i["type"]):
                    other = target["type"] if better else i["type"]
                if better:
                    target["type"], target["domain"], target["by"]["type"] = i["type"], i["domain"], i["source"]
        else:
            far = other = None
            target = i | {"names": list(i["names"]), "name": i["names"][0], "by": dict.fromkeys(("name", "geometry", "type"), i["source"])}
            places.append(target)
        registry[i["source"], i["external_id"]] = target["id"]
        for c in claims:
            registry.setdefault(c, target["id"])
        out[i["id"]] = (target["id"], kind, far, other)
    return out, {p["id"]: p for p in places}


ITEM = "id long, source string, external_id string, refs map<string,string>, names array<string>, lat double, lng double, type string, domain string, tier int, facets array<string>"


def item_frame(spark, items):
    return spark.createDataFrame([tuple(x.get(c.split()[0]) for c in ITEM.split(", ")) for x in items], ITEM)


@pytest.mark.parametrize("seed", [3])
def test_resolution_against_a_plain_one(spark, seed):
    rng = random.Random(seed)
    names = ["Storkyrkan", "Storkyrka", "Café Söder", "Cafe Soder", "Gamla Torget", "Slottet", "Slott", "Espresso House", "Sankt Nikolai kyrka", "Nikolaikyrkan", "Straße", "Strasse"]
    kinds = [("church", "religious_sacred"), ("chapel", "religious_sacred"), ("cafe", "food_drink"), ("square", "architecture_urban"), ("castle", "historic_heritage"), (None, None)]
    items = []
    for i in range(160):
        t, d = rng.choice(kinds)
        refs = {"wikidata": f"Q{rng.randrange(8)}"} if rng.random() < 0.2 else {}
        if rng.random() < 0.2:
            n = rng.randrange(6)
            refs["wikipedia"] = rng.choice([f"sv:Place {n}", f"https://sv.wikipedia.org/wiki/Place%20{n}"])
        source = rng.choice(["osm", "wikidata", "merimee", "overture"])
        items.append({"id": i, "source": source, "external_id": f"x{i}" if source != "wikidata" else f"Q{i % 20 if i % 20 in range(8) else i}", "refs": refs, "names": rng.sample(names, rng.choice([1, 1, 2])), "lat": 59.32 + rng.random() * 0.012, "lng": 18.07 + rng.random() * 0.02, "type": t, "domain": d, "tier": rng.randrange(3), "facets": rng.sample(["a", "b", "c"], 2)})
    d = item_frame(spark, items)
    decided = resolve.resolved(d).cache()
    got = {r.id: (r.place_id, r.band, r.geometry_conflict_m, r.type_conflict) for r in decided.collect()}
    want, stand = plain_resolution(items)
    assert got == want
    assert {"explicit", "high", "review", "distinct"} == {b for _, b, _, _ in want.values()}
    assert any(f for _, _, f, _ in want.values()) and any(o for _, _, _, o in want.values())
    assert resolve.resolved(d.limit(0)).count() == 0
    left = {r.place_id: r for r in resolve.survivors(d.join(decided.select("id", "place_id"), "id")).collect()}
    assert {p: (r.name, set(r.alt_names) | {r.name}, r.lat, r.lng, r.type, r.domain) for p, r in left.items()} == {p: (x["name"], set(x["names"]), x["lat"], x["lng"], x["type"], x["domain"]) for p, x in stand.items()}


def test_resolution_knows_places_as_they_stand(spark):
    here = {"lat": 59.3258, "lng": 18.0706, "type": "church", "domain": "religious_sacred", "tier": 2}
    church = ("Storkyrkan", "Sankt Nikolai kyrka")

    cases = {  # each far from the others
        "own id": ([{"names": [church[0]], "refs": {"wikidata": "Q1"}}, {"source": "wikidata", "external_id": "Q1", "names": [church[1]]}], [(0, "distinct"), (0, "explicit")]),
        "names": ([{"names": [church[0]]}, {"names": list(church), "source": "overture"}, {"names": [church[1]], "source": "wikidata", "external_id": "Q7"}], [(0, "distinct"), (0, "high"), (0, "high")]),
        "article": ([{"names": ["A"], "refs": {"wikipedia": "sv:Stor kyrkan"}}, {"names": ["Zzz"], "refs": {"wikipedia": "https://sv.wikipedia.org/wiki/Stor%20kyrkan"}, "source": "wikidata", "external_id": "Q9"}], [(0, "distinct"), (0, "explicit")]),
        "odd": ([{"names": None, "lat": None}, {"names": None, "type": None, "domain": None}, {"names": ["A"], "external_id": None, "refs": None}], [(0, "distinct"), (1, "distinct"), (2, "distinct")]),
    }
    items = [here | {"id": 10 * c + k, "source": "osm", "external_id": f"e{c}{k}", "refs": {}, "lat": here["lat"] + c} | r for c, (rows, _) in enumerate(cases.values()) for k, r in enumerate(rows)]
    got = {r.id: (r.place_id, r.band) for r in resolve.resolved(item_frame(spark, items)).collect()}
    assert got == {10 * c + k: (10 * c + p, band) for c, (_, want) in enumerate(cases.values()) for k, (p, band) in enumerate(want)}


def test_crowded_squares_are_parted(spark, monkeypatch):
    rng = random.Random(1)
    pts = [(i, 59.33 + rng.gauss(0, 0.002), 18.07 + rng.gauss(0, 0.004)) for i in range(300)] + [(300 + i, 0.001 * (i - 20), 0.0015 * (i % 9) - 0.005) for i in range(60)] + [(400, None, 1.0)]
    d = spark.createDataFrame(pts, "id long, lat double, lng double")
    want = {(a[0], b[0]) for a in pts[:-1] for b in pts[:-1] if a[0] < b[0] and geo.metres(a[1], a[2], b[1], b[2], geo.RADIUS["match"]) <= 350}
    for most in (10, 10_000):
        monkeypatch.setattr(resolve, "CROWDED", most)
        got = [(r.a_id, r.b_id) for r in resolve.near_pairs(d, 350.0).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_plan_against_a_plain_one(spark):
    rng = random.Random(9)
    terms = list(rank.WEIGHTS["warm"]["radius"])
    rows = []
    for sid in range(4):
        for p in range(30):
            r = {"session_id": sid, "user_id": sid % 2, "place_id": p, "ordinal": p, "lat": 59.33 + rng.random() * 0.08, "lng": 18.06, "from_lat": 59.33, "from_lng": 18.06, "remaining": 150.0, "visit_minutes": float(rng.choice([20, 60, 100])), "type_domain": rng.choice(["a", "b", "c"]),
                 "facets": rng.sample(["x", "y", "z"], rng.choice([0, 1, 2])), "tiers": rng.choice([["open"], ["open", "official"], ["community"], []]), "is_open": rng.choice([True, False, None]), "closes_at": None, "alpha": rng.choice([0.2, 0.9]), "friction_raw": half_up(rng.random())}
            rows.append(r | {t: half_up(rng.random()) for t in terms})
    cols = list(rows[0])
    kinds = {"session_id": "long", "user_id": "long", "place_id": "long", "ordinal": "long", "type_domain": "string", "facets": "array<string>", "tiers": "array<string>", "is_open": "boolean", "closes_at": "timestamp_ntz"}
    d = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], ", ".join(f"{c} {kinds.get(c, 'double')}" for c in cols))
    gone = spark.createDataFrame([(0, 3), (1, 4)], "session_id long, place_id long")
    got = {(r.session_id, r.place_id): (r.status, r.reason, r.position) for r in feed.plan(d.unionByName(d), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"), k=6, excluded=gone).collect()}

    def greedy(pool):
        left, out, domains, facets, buckets = sorted(pool, key=lambda r: r["ordinal"]), [], {}, set(), set()
        while left and len(out) < 6:
            best = None
            for probing in (True, False):
                for c in left:
                    own = set(c["facets"])
                    if probing and c["alpha"] < 0.7 and len(left) >= 2 and facets and own and own <= facets:
                        continue
                    base = sum(half_up(c["alpha"] * rank.WEIGHTS["warm"]["radius"][t] + (1 - c["alpha"]) * rank.WEIGHTS["cold"]["radius"][t]) * c[t] for t in terms) - 0.25 * c["friction_raw"]
                    whole = half_up(base - 0.15 * min(1.0, 0.5 * domains.get(c["type_domain"], 0)))
                    bucket = "short" if c["visit_minutes"] <= 45 else "medium" if c["visit_minutes"] <= 120 else "long"
                    s = whole + (0.001 if best and bucket not in buckets and best[2] in buckets and abs(whole - best[0]) < 0.02 else 0)
                    if best is None or s > best[0]:
                        best = (s, c, bucket)
                if best:
                    break
            if not best:
                break
            left.remove(best[1])
            domains[best[1]["type_domain"]] = domains.get(best[1]["type_domain"], 0) + 1
            facets |= set(best[1]["facets"])
            buckets.add(best[2])
            out.append(best[1])
        return out

    want = {}
    for sid in range(4):
        pool = []
        for r in (r for r in rows if r["session_id"] == sid and (sid, r["place_id"]) not in {(0, 3), (1, 4)}):
            way = half_up(geo.metres(r["lat"], r["lng"], 59.33, 18.06, 6371.0) * 1.3 / 4.8 * 60, 2)
            if 2 * way + r["visit_minutes"] > 150:
                want[sid, r["place_id"]] = ("unreachable", None, None)
            elif not r["tiers"] or set(r["tiers"]) == {"community"} or r["confidence"] < 0.25:
                want[sid, r["place_id"]] = ("held", "no_evidence" if not r["tiers"] else "tier_d_only" if set(r["tiers"]) == {"community"} else "below_confidence_floor", None)
            else:
                pool.append(r)
        shut = set()
        for _ in range(2):
            picks = greedy([r for r in pool if r["place_id"] not in shut])
            shut |= {r["place_id"] for r in picks if r["is_open"] is False}
        final = [r["place_id"] for r in picks if r["place_id"] not in shut]
        for r in pool:
            p = r["place_id"]
            want[sid, p] = ("served", None, final.index(p) + 1) if p in final else ("closed" if p in shut else "near_miss", None, None)
    assert got == want


def test_selection_is_the_same_without_pruning(spark, monkeypatch):
    rng = random.Random(11)
    terms = list(rank.WEIGHTS["warm"]["radius"])
    rows = []
    for p in range(900):
        near = round(0.5 + rng.random() * 0.02, 5) if rng.random() < 0.5 else rng.random()
        rows.append((p % 3, p, p, rng.choice("ab"), rng.choice([["x"], ["x", "y"], []]), rng.choice([30.0, 90.0, 200.0]), rng.choice([0.2, 0.9]), rng.choice([True, False, None]), 0.0, *([near] * len(terms))))
    d = spark.createDataFrame(rows, "session_id long, place_id long, ordinal long, type_domain string, facets array<string>, total_minutes double, alpha double, is_open boolean, friction_raw double, " + ", ".join(f"{t} double" for t in terms))
    for k, rounds in ((4, 1), (3, 2)):
        run = lambda: sorted(map(tuple, rank.select_verified(d, k, rounds=rounds).collect()), key=repr)  # noqa: B023, E731
        few = run()
        with monkeypatch.context() as m:
            kept = []
            m.setattr(rank, "_inert_out", lambda rows, *_: kept.append(1) or rows)
            assert run() == few and kept
    one_class = spark.range(5000).select(F.lit(0).alias("session_id"), F.col("id").alias("place_id"), F.col("id").alias("ordinal"), F.lit("a").alias("type_domain"), F.array().cast("array<string>").alias("facets"), F.lit(30.0).alias("total_minutes"), F.lit(0.9).alias("alpha"), F.rand(1).alias("whole"))
    assert rank._inert_out(one_class, "session_id", 3).count() < 60


def _crowd(spark, n):
    """n places of five domains in two cells, one of them next to the other, and some without a domain or a place."""
    k = F.col("id")
    domain = F.element_at(F.array(*[F.lit(x) for x in ("historic_heritage", "museum_gallery", "nature_landscape", "food_drink", "practical")]), (k % 5 + 1).cast("int"))
    cell = F.when(k % 11 != 0, F.struct((k % 2).alias("q"), F.lit(0).cast("long").alias("r")))
    return spark.range(n).select(k.alias("place_id"), cell.alias("cell"), F.when(k % 7 != 0, domain).alias("type_domain"))


def test_scout_counts_are_those_of_scouted(spark):
    p = _crowd(spark, 200)
    cells = tiles.ring_cells(p.select(F.col("place_id").alias("session_id"), F.col("cell").alias("origin_cell")), F.lit(900.0))
    counted = sorted(map(tuple, tiles.scout_counts(cells, p).collect()))
    assert counted and counted == sorted(map(tuple, tiles.scouted(cells, p).groupBy("session_id", "scout").agg(F.count("*")).collect()))
    # 60,000 sessions beside 60,000 places: 3.3 billion candidates, which are not made
    many = _crowd(spark, 60_000)
    n = tiles.scout_counts(many.select(F.col("place_id").alias("session_id"), "cell"), many).agg(F.sum("n"), F.count("*")).first()
    assert n[0] > 10**9 and n[1] == 4 * many.where("cell IS NOT NULL").count()


def test_parent_cells_of_crowded_places(spark, tmp_path):
    """G05 as registered counts each place's own disc, though it is made once a cell."""
    import time as clock

    from waymark.plans import registry
    from waymark.plans.base import places

    spark.range(400).selectExpr("id % 3 * 46200 + id AS p_partkey", "'n' AS p_name", "'Brand#1' AS p_brand", "'T' AS p_type", "CAST(id % 50 AS int) AS p_size", "1.0 AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    p = places(spark, str(tmp_path))
    found = registry.QUERIES["g05_parent"](spark, str(tmp_path))
    plain = tiles.occupied(tiles.disc_cells(p.select("place_id", "lat", "lng"), F.lit(6000.0)), p.where("type_domain = 'practical' AND size >= 45")).groupBy("place_id").agg(F.count("*"))
    assert found.columns == ["place_id", "n"] and sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) and found.count() > 300
    began = clock.time()
    spark.range(60_000).selectExpr("id AS p_partkey", "'n' AS p_name", "'Brand#1' AS p_brand", "'T' AS p_type", "CAST(id % 50 AS int) AS p_size", "1.0 AS p_retailprice").write.parquet(f"{tmp_path}/many/part.parquet")
    assert registry.QUERIES["g05_parent"](spark, f"{tmp_path}/many").count() > 50_000 and clock.time() - began < 40


def test_scout_runs_of_crowded_tiles(spark):
    """G10 counts candidates without making them: 60,000 sessions beside 60,000 places within the time of a test."""
    p = _crowd(spark, 60_000)
    cached = spark.createDataFrame([("nearby", (0, 0), "v2", 1), ("nearby", (0, 0), "v1", 1), ("history", (1, 0), "v2", 30), ("curated", (0, 0), "v2", 1)], "scout string, cell struct<q: bigint, r: bigint>, version string, age int")
    now = F.lit("1998-01-01 00:00:00").cast("timestamp")
    cached = cached.select("scout", "cell", "version", (now - F.make_dt_interval(hours=F.col("age"))).alias("filled_at"))
    runs = tiles.scout_runs(p.where("cell IS NOT NULL").select(F.col("place_id").alias("session_id"), "cell"), p, cached, now, "v2")
    by = {(r.scout, r.hits): (r.n, r.tiles, r.filled, r.candidates) for r in runs.groupBy("scout", "hits").agg(F.count("*").alias("n"), F.sum("tiles").alias("tiles"), F.sum("filled").alias("filled"), F.max("candidates").alias("candidates")).collect()}
    sides = {q: p.where(f"cell.q = {q}").count() for q in (0, 1)}
    assert by["nearby", 1][:3] == (sides[0], sides[0], 0) and by["nearby", 0][:3] == (sides[1], sides[1], sides[1]) and by["history", 0][0] == sides[0] + sides[1]
    most = max(p.where(f"cell.q = {q} AND type_domain = 'practical'").count() for q in (0, 1))
    assert by["practical", 0][3] == most and len(by) == 5


def test_pairs_by_likeness_are_those_by_names(spark, monkeypatch):
    """Names compared once a pair of lists give the pairs and scores of names compared pair by pair; more lists are left to that."""
    names = [["Café Nord"], ["cafe nord"], ["Nordic Café", "Nord"], [], None, ["Museum"], ["Østre Museum"], ["  Museum  "]]
    kinds = [("cafe", "food_drink"), ("museum", "museum_gallery"), (None, None), ("park", "nature_landscape")]
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice(names), 59.3 + rng.random() * 0.02, 18.0 + rng.random() * 0.03, *rng.choice(kinds)) for i in range(150)]
    items = spark.createDataFrame(rows, "id long, source string, names array<string>, lat double, lng double, type string, domain string")
    like = resolve.likeness(items)
    by_names = resolve.scored_pairs(resolve.blocked_pairs(items))
    by_code = resolve.scored_pairs(resolve.blocked_pairs(items, like=like), like)
    one, two = (sorted(map(str, x.select(by_names.columns).collect())) for x in (by_names, by_code))
    assert len(one) > 200 and one == two and by_code.columns == by_names.columns
    monkeypatch.setattr(resolve, "FEW_NAMES", 6)
    assert resolve.likeness(items) is None
    plain = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and geo.metres(a[3], a[4], b[3], b[4], geo.RADIUS["match"]) <= 350]
    assert sorted(map(tuple, resolve.near_pairs(items, 350.0).select("a_id", "b_id").collect())) == sorted(plain)


def test_nearest_rows_of_many_vectors(spark, tmp_path):
    """s_embed_cosine as SQL has it, with ties, equal vectors and a null one; 400 queries beside 40,000 rows within 30 s."""
    import time as clock

    duckdb = pytest.importorskip("duckdb")
    from waymark.plans import registry

    vector = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: ((F.hash(F.col("id") % 97, i) % 5) + F.when(i == 0, 7).otherwise(0)).cast("float"))
    spark.range(450).select(F.col("id").alias("vec_id"), F.when(F.col("id") != 300, vector).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet' WHERE vec_id <> 300")
    found = sorted(map(tuple, registry.QUERIES["s_embed_cosine"](spark, str(tmp_path)).collect()))
    assert [r for r in found if r[0] != 300] == sorted(con.execute(registry.ORACLES["s_embed_cosine"]).fetchall()) and len(found) == 25
    assert [r[1:] for r in found if r[0] == 300] == [(i, None) for i in range(5)]
    many = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.hash("id", i) % 1000 / 1000).cast("float"))
    spark.range(40_000).select(F.col("id").alias("vec_id"), many.alias("embedding")).write.parquet(f"{tmp_path}/many/embeddings.parquet")
    began = clock.time()
    assert registry.QUERIES["s_embed_cosine"](spark, f"{tmp_path}/many").count() == 2_000 and clock.time() - began < 30


def test_resolver_reads_the_squares_around(spark):
    """A resolver finds the places within reach, across squares, and no other: as a look at every place has it."""
    from types import SimpleNamespace

    rng, resolver = random.Random(5), resolve._Resolver()
    make = lambda i: SimpleNamespace(id=i, source="osm", external_id=str(i), refs=None, names=[f"{rng.choice('abcd')}{rng.choice('efgh')} street"], lat=59.3 + rng.random() * 0.01, lng=18.0 + rng.random() * 0.02, type=rng.choice(["cafe", "park", None]), domain="food_drink", tier=1)
    for i in range(300):
        item = make(i)
        away = {p: geo.metres(item.lat, item.lng, q.lat, q.lng, geo.RADIUS["match"]) for p, q in resolver.places.items()}
        every = [(f, -k, p) for k, (p, q) in enumerate(resolver.places.items()) if away[p] <= resolve.BLOCK_M and (f := resolve._scored(item, q, away[p], -1.0)) and f[0] >= resolve.REVIEW]
        best = max(every, key=lambda x: (x[0][0], x[1]), default=None)
        found = resolver._best(item)
        assert (found[1:] if found and found[1] != "distinct" else None) == ((best[0][1], best[2]) if best and best[0][1] != "distinct" else None)
        resolver.resolve(item)
    assert len(resolver.squares) > 4 and sum(map(len, resolver.squares.values())) == len(resolver.places)
