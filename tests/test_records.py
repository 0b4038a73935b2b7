"""Paged sources, feeds, personal data, queues, gold files, suggestions, letters and the sun on named cases."""

import json
import unicodedata
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from waymark.functions import text, time
from waymark.operators import privacy, rank, resolve, typeahead
from waymark.sources import paged, readers


def put_pages(root, sizes, meta=None):
    for k, n in sizes.items():
        d = root / f"page={k}"
        d.mkdir(parents=True)
        (d / "part-0.txt").write_text(json.dumps({"results": [{"id": f"{k}.{i}", "t": "é"} for i in range(n)]} | ({"meta": meta} if meta else {})))
    return str(root)


def ids(df):
    return sorted(json.loads(r.record)["id"] for r in df.collect())


def test_pages_stop_where_they_should(spark, tmp_path):
    offset = paged.Adapter("results", 3, 4, False)
    assert len(ids(paged.read_pages(spark, put_pages(tmp_path / "a", {0: 3, 1: 2, 2: 3}), offset))) == 5  # nothing after a short page
    assert len(ids(paged.read_pages(spark, put_pages(tmp_path / "b", {0: 3, 1: 3, 3: 3}), offset))) == 6  # nor after a gap
    assert len(ids(paged.read_pages(spark, put_pages(tmp_path / "c", dict.fromkeys(range(6), 3)), offset))) == 12  # cut at the most pages
    (tmp_path / "none").mkdir()
    assert paged.read_pages(spark, str(tmp_path / "none"), offset).count() == 0
    strict = paged.Adapter("results", None, 2, True, "total_pages")
    assert len(ids(paged.read_pages(spark, put_pages(tmp_path / "d", {0: 3, 1: 3, 2: 3}, {"total_pages": 2}), strict))) == 6  # the source says how many
    with pytest.raises(Exception, match="more than 2 pages"):
        paged.read_pages(spark, put_pages(tmp_path / "e", {0: 3, 1: 3, 2: 3}), strict).count()
    assert paged.ADAPTERS["merimee"].supports("fr") and not paged.ADAPTERS["merimee"].supports("sv")
    with pytest.raises(Exception, match="no paged source"):
        paged.harvested(spark, str(tmp_path), "other")


def test_atom_entries(spark, tmp_path):
    entry = '<entry><title>Grève des bus</title><link rel="self" href="http://s"/><link href="http://x"/><summary>demain</summary><updated>2026-07-14T08:00:00Z</updated></entry>'
    p = tmp_path / "a.xml"
    p.write_text(f"<feed>{entry}<entry><title> </title><summary>grève</summary></entry></feed>")
    (r,) = readers.news(spark, str(p)).collect()
    assert (r.title, r.summary, r.link, r.kind, r.published) == ("Grève des bus", "demain", "http://x", "strike", datetime(2026, 7, 14, 8))


def test_json_values(spark):
    rows = [('{"a":1,"b":{"lat":2,"x":"é"}}',), ("[1,2]",), ('"s"',), ("true",), ("null",), ("1.5",), ("{",), (None,)]
    d = spark.createDataFrame(rows, "j string")
    kinds = [r[0] for r in d.select(privacy.json_kind(F.col("j"))).collect()]
    assert kinds == ["object", "array", "string", "boolean", "null", "number", None, None]
    good = d.limit(2)
    out = good.select(privacy.json_without(F.col("j"), "a").alias("x"), privacy.json_set(F.col("j"), "c", F.lit('{"k":[1]}')).alias("y")).collect()
    assert json.loads(out[0].x) == {"b": {"lat": 2, "x": "é"}} and json.loads(out[0].y) == {"a": 1, "b": {"lat": 2, "x": "é"}, "c": {"k": [1]}}
    assert out[1].x == out[1].y == "[1,2]"


def test_traces_of_those_who_do_not_consent(spark):
    inputs = '{"candidate":{"lat":1.0,"lng":2.0,"name":"n"},"k":3}'
    old, new = datetime(2026, 1, 1), datetime(2026, 3, 1)
    rows = [(1, old, 1.0, 2.0, inputs), (1, new, 1.0, 2.0, inputs), (2, old, 1.0, 2.0, inputs), (3, old, 1.0, 2.0, inputs), (1, old, None, None, '{"k":1}'), (1, old, 1.0, 2.0, None)]
    t = spark.createDataFrame(rows, "user_id long, served_at timestamp, anchor_lat double, anchor_lng double, score_inputs string")
    u = spark.createDataFrame([(1, False), (2, True)], "user_id long, research_consent boolean")
    got = [(r.anchor_lat, json.loads(r.score_inputs) if r.score_inputs else None) for r in privacy.coarsened_traces(t, u, F.lit("2026-02-01").cast("timestamp")).collect()]
    full = json.loads(inputs)
    assert sorted(map(repr, got)) == sorted(map(repr, [(None, {"candidate": {"name": "n"}, "k": 3}), (1.0, full), (1.0, full), (1.0, full), (None, {"k": 1}), (None, None)]))


def test_gold_labels_of_people_stay(spark):
    schema = "a string, b string, label string, labeled_by string"
    new = spark.createDataFrame([("x", "y", "match", "auto"), ("p", "q", "match", "auto"), ("m", "n", None, None), ("c", "d", None, None)], schema)
    old = spark.createDataFrame([("y", "x", "distinct", "human"), ("y", "x", "match", "auto"), ("p", "q", "distinct", "auto"), ("n", "m", "distinct", "auto")], schema)
    got = {r.key: (r.label, r.labeled_by, r.todo) for r in resolve.gold_labels(new, old).collect()}
    assert got == {"x|y": ("distinct", "human", False), "p|q": ("match", "auto", False), "m|n": ("distinct", "auto", False), "c|d": (None, None, True)}


def test_suggestions_keep_slots_for_the_other_lists(spark):
    places = spark.createDataFrame([(k, f"Storgatan {k}") for k in range(10)] + [(20, "storgatan 3"), (21, None), (22, "")], "id long, name string")
    towns = spark.createDataFrame([(1, "Storby"), (2, "STORGATAN 1"), (3, "Lund")], "id long, name string")
    index = typeahead.name_index({"places": places, "towns": towns})
    asked = spark.createDataFrame([("Stor",), ("lund",), ("?",), ("storgatan 3",), (None,)], "q string")
    got: dict[str, list] = {}
    for r in typeahead.suggestions(index, asked).orderBy("q", "position").collect():
        got.setdefault(r.q, []).append((r.position, r.list, r.name))
    assert [n for _, _, n in got["Stor"]][:6] == [f"Storgatan {k}" for k in range(6)] and [(p, n) for p, k, n in got["Stor"] if k] == [(7, "Storby")]  # two towns match, one by a name that is there
    assert got["lund"] == [(1, 1, "Lund")] and "?" not in got
    assert got["storgatan 3"][0][2].lower() == "storgatan 3" and sum(n.lower() == "storgatan 3" for _, _, n in got["storgatan 3"]) == 1


def test_letters_fold_alike_in_both_forms(spark):
    names = ["Straße", "Œuvre d'Æther", "Łódź", "Þórsmörk", "Ðakovo đ", "İstanbul", "Ǻngström", "ﬁnal", "Ĳmuiden", "naïve", "ꜳ", "東京", ""]
    forms = [unicodedata.normalize(f, n) for n in names for f in ("NFC", "NFD")]
    d = spark.createDataFrame([(i, n) for i, n in enumerate(forms)], "i int, n string").select("i", text.fold(F.col("n")).alias("f"))
    got = [r.f for r in sorted(d.collect())]
    assert got[::2] == got[1::2] == [text.fold_of(n) for n in names]
    assert got[::2] == ["strasse", "oeuvre d'aether", "lodz", "thorsmork", "dakovo d", "istanbul", "angstrom", "final", "ijmuiden", "naive", "aa", "東京", ""]
    every = text.letters()
    assert all(v.isascii() and v.isalpha() and v == v.lower() for v in every.values()) and len(every) > 600
    for c in range(0xC0, 0x180):
        assert chr(c) in every or chr(c) in "×÷", chr(c)


def test_article_names(spark):
    raw = ["https://SV.wikipedia.org/wiki/Stor%20kyrkan", "sv:Stor kyrkan", "http://sv.m.wikipedia.org/wiki/Stor_kyrkan#x", "https://example.org/x", "Stor", "", None, "https://sv.wikipedia.org/wiki/A+B"]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").select("i", text.sitelink(F.col("r")).alias("k"))
    want = ["sv:Stor_kyrkan"] * 3 + [None, None, None, None, "sv:A+B"]
    assert [r.k for r in sorted(d.collect(), key=lambda r: r.i)] == want == [text.sitelink_of(r) for r in raw]


def test_sun_over_the_year(spark):
    at = lambda t: F.lit(t).cast("timestamp")
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    noon = one(time.minutes_of_light_left(F.lit(0.0), F.lit(0.0), at("2026-03-20 12:00:00")), time.minutes_of_light_left(F.lit(78.0), F.lit(15.0), at("2026-06-20 12:00:00")), time.minutes_of_light_left(F.lit(78.0), F.lit(15.0), at("2026-12-20 12:00:00")))
    assert abs(noon[0] - 370) <= 3 and noon[1:] == (None, None)
    low = one(time.golden_minutes_left(F.lit(0.0), F.lit(0.0), at("2026-03-20 17:50:00")), time.golden_minutes_left(F.lit(0.0), F.lit(0.0), at("2026-03-20 06:20:00")))
    assert 25 <= low[0] <= 40 and low[1] is None


def test_novelty_of_trips(spark):
    c = spark.createDataFrame([(1, 1, "church", "sacred"), (1, 2, "temple", "sacred"), (1, 3, None, None), (2, 1, "church", "sacred")], "trip_id long, place_id long, type string, type_domain string")
    h = spark.createDataFrame([(1, "church", "sacred", "visited", 0.0), (1, "church", "sacred", "visited", 4.0), (1, "temple", "sacred", "ignored", -1.0), (1, None, None, "visited", 0.0)], "trip_id long, type string, type_domain string, event string, age_days double")
    got = {(r.trip_id, r.place_id): r.novelty for r in rank.with_novelty(c, h).collect()}
    assert got == {(1, 1): round(0.6**1.5, 4), (1, 2): round(0.9**1.5, 4), (1, 3): 1.0, (2, 1): 1.0}
