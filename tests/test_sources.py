import json

from pyspark.sql import functions as F

from waymark.sources import readers, taxonomy


def write(tmp_path, name, what):
    p = tmp_path / name
    p.write_text(what if isinstance(what, str) else json.dumps(what))
    return str(p)


def test_osm(spark, tmp_path):
    e = [
        {"type": "node", "id": 1, "lat": 59.1, "lon": 18.1, "tags": {"tourism": "museum", "name": "M", "alt_name": "N", "wikidata": "Q1"}},
        {"type": "node", "id": 1, "lat": 59.1, "lon": 18.1, "tags": {"tourism": "museum", "name": "M", "alt_name": "N", "wikidata": "Q1"}},
        {"type": "way", "id": 2, "center": {"lat": 59.2, "lon": 18.2}, "tags": {"amenity": "toilets"}}, {"type": "node", "id": 3, "lat": 1, "lon": 1, "tags": {"amenity": "cafe"}}, {"type": "node", "id": 4, "tags": {"shop": "x", "name": "y"}},
    ]
    r = {x.external_id: x for x in readers.osm(readers.read_json(spark, write(tmp_path, "o.json", {"elements": e}), readers.OVERPASS)).collect()}
    assert set(r) == {"node/1", "way/2"}
    assert (r["node/1"].type, r["node/1"].alt_names, r["node/1"].refs, r["way/2"].lat) == ("local_museum", ["N"], {"wikidata": "Q1"}, 59.2)


def test_overture_and_wikidata(spark, tmp_path):
    f = {"features": [{"id": "a", "geometry": {"coordinates": [18.0, 59.0]}, "properties": {"names": {"primary": "P"}, "categories": {"primary": "museum"}, "confidence": 0.9}}, {"id": "", "geometry": {"coordinates": [1, 1]}, "properties": {"names": {"primary": "Q"}, "categories": {"primary": "museum"}}}]}
    r = readers.overture(readers.read_json(spark, write(tmp_path, "v.json", f), readers.OVERTURE), (58, 17, 60, 19)).collect()
    assert [(x.external_id, x.lat, x.lng) for x in r] == [("a", 59.0, 18.0)]
    b = lambda q, c: {"item": {"value": f"http://x/{q}"}, "class": {"value": f"http://x/{c}"}, "coord": {"value": "Point(18.07 59.32)"}, "label_en": {"value": "L"}}
    w = {"results": {"bindings": [b("Q5", "Q99"), b("Q5", "Q16970"), b("Q5", "Q33506"), b("Q6", "Q99")]}}
    r = readers.wikidata(readers.read_json(spark, write(tmp_path, "w.json", w), readers.SPARQL)).collect()
    assert [(x.external_id, x.type, x.lat, x.lng) for x in r] == [("Q5", "church", 59.32, 18.07)]


def test_french_sources(spark, tmp_path):
    m = {"results": [{"reference": "PA1", "titre": "T", "denomination": "Église paroissiale", "coordonnees": {"lat": 43.1, "lon": 7.1}}, {"reference": "PA2", "titre": "U", "denomination": "usine", "coordonnees": {"lat": 1, "lon": 1}}]}
    assert [x.type for x in readers.merimee(readers.read_json(spark, write(tmp_path, "m.json", m), readers.MERIMEE)).collect()] == ["church"]
    d = {"objects": [{"uuid": "u", "label": {"@fr": "Musée"}, "types": ["Thing", "Museum"], "lat": 43.0, "lng": 7.0}]}
    assert [x.name for x in readers.datatourisme(readers.read_json(spark, write(tmp_path, "d.json", d), readers.DATATOURISME), "de").collect()] == ["Musée"]


def test_news_and_gazetteer(spark, tmp_path):
    item = lambda t: f"<item><title>{t}</title><description>about</description><link>http://x</link><pubDate>Tue, 14 Jul 2026 08:00:00 +0000</pubDate></item>"
    p = write(tmp_path, "n.xml", f"<rss><channel>{item('Fermeture du pont')}{item('Une recette')}{item('Grève des bus')}</channel></rss>")
    r = readers.news(spark, p).orderBy("kind").collect()
    assert [x.kind for x in r] == ["closure", "strike"] and r[0].published is not None
    g = {"elements": [{"type": "node", "id": 9, "lat": 1.0, "lon": 2.0, "tags": {"name": "Town", "place": "town", "population": "12 345"}}]}
    assert readers.gazetteer(readers.read_json(spark, write(tmp_path, "g.json", g), readers.OVERPASS), "se").first().population == 12345


def test_types_of_tags(spark):
    cases = [
        ({"tourism": "museum", "museum": "art"}, "art_museum"), ({"tourism": "museum", "museum": "x"}, "local_museum"), ({"historic": "castle", "tourism": "museum"}, "castle"), ({"historic": "x", "natural": "water", "water": "lake"}, "lake"),
        ({"natural": "water"}, None), ({"amenity": "place_of_worship", "building": "chapel"}, "chapel"), ({"amenity": "place_of_worship", "religion": "hindu"}, "temple"), ({"amenity": "place_of_worship"}, "church"),
        ({"amenity": "x", "railway": "halt", "leisure": "park"}, "transport_hub"), ({"leisure": "sauna", "shop": "books"}, "wellness"), ({"shop": "tea"}, "specialty_shop"), ({"place": "square"}, "square"), ({"highway": "bus_stop"}, None), ({}, None),
    ]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, tags map<string,string>")
    got = {r.i: r.k for r in d.select("i", taxonomy.type_of_tags(F.col("tags")).alias("k")).collect()}
    assert [got[i] for i in range(len(cases))] == [k for _, k in cases]
    one = spark.range(1).select(taxonomy.type_of_denomination(F.lit(" Église paroissiale Saint-Pierre")), taxonomy.type_of_denomination(F.lit("maison du gardien du château")), taxonomy.type_of_classes(F.array(F.lit("CulturalSite"), F.lit("Museum")))).first()
    assert tuple(one) == ("church", None, "history_museum")


def test_every_mapped_type_has_a_domain():
    maps = [*taxonomy.TAGS.values(), taxonomy.MUSEUMS, taxonomy.WATERS, taxonomy.WORSHIP_BUILDINGS, taxonomy.CATEGORIES, taxonomy.CLASSES, taxonomy.DENOMINATIONS, taxonomy.ONTOLOGY]
    assert {t for m in maps for t in m.values()} <= set(taxonomy.DOMAIN_OF)
    assert (len(taxonomy.CATEGORIES), len(taxonomy.CLASSES), len(taxonomy.DENOMINATIONS), len(taxonomy.ONTOLOGY)) == (60, 43, 54, 54)
