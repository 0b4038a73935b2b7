"""Place types, their domains, and what each source calls them (F32)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Domains and their place types (fixed values).
DOMAINS = {
    "religious_sacred": "church cathedral chapel monastery abbey shrine temple sacred_cemetery",
    "historic_heritage": "castle fortress ruin monument memorial archaeological_site historic_house city_gate old_town",
    "museum_gallery": "art_museum history_museum science_museum local_museum house_museum gallery",
    "nature_landscape": "viewpoint park garden forest waterfall lake beach cave cliff geological_feature spring",
    "food_drink": "restaurant cafe bakery market food_producer winery brewery distillery deli",
    "arts_culture": "theatre concert_hall cinema cultural_center street_art artist_studio",
    "architecture_urban": "notable_building square bridge tower fountain notable_street",
    "shops_craft": "artisan_workshop bookshop antique_shop specialty_shop craft_studio",
    "activity_recreation": "walking_trail cycling_route beach_recreation sports_venue wellness boat_activity",
    "events": "concert festival market_day exhibition performance seasonal_event",
    "practical": "toilet charging_point pharmacy shelter transport_hub",
}
DOMAIN_OF = {t: d for d, types in DOMAINS.items() for t in types.split()}
PRACTICAL = tuple(DOMAINS["practical"].split())

#: Tags of the map: key, then value and type; keys in order of precedence (fixed values).
TAGS = {
    "historic": {
        "castle": "castle", "fort": "fortress", "fortress": "fortress", "citadel": "fortress", "ruins": "ruin", "monument": "monument", "memorial": "memorial", "wayside_cross": "memorial",
        "archaeological_site": "archaeological_site", "rune_stone": "archaeological_site", "manor": "historic_house", "house": "historic_house", "city_gate": "city_gate",
    },
    "tourism": {"viewpoint": "viewpoint", "museum": "local_museum", "gallery": "gallery", "artwork": "street_art"},
    "natural": {"waterfall": "waterfall", "beach": "beach", "cave_entrance": "cave", "cliff": "cliff", "spring": "spring", "wood": "forest", "rock": "geological_feature", "stone": "geological_feature"},
    "craft": {
        "winery": "winery", "brewery": "brewery", "distillery": "distillery", "pottery": "artisan_workshop", "goldsmith": "artisan_workshop", "jeweller": "artisan_workshop", "leather": "artisan_workshop",
        "shoemaker": "artisan_workshop", "watchmaker": "artisan_workshop", "glassblower": "artisan_workshop", "carpenter": "artisan_workshop", "bookbinder": "artisan_workshop",
    },
    "amenity": {
        "place_of_worship": "church", "restaurant": "restaurant", "cafe": "cafe", "marketplace": "market", "theatre": "theatre", "concert_hall": "concert_hall", "cinema": "cinema", "arts_centre": "cultural_center",
        "fountain": "fountain", "pharmacy": "pharmacy", "toilets": "toilet", "charging_station": "charging_point", "shelter": "shelter", "bus_station": "transport_hub", "ferry_terminal": "transport_hub",
    },
    "railway": {"station": "transport_hub", "halt": "transport_hub"},
    "public_transport": {"station": "transport_hub"},
    "leisure": {"park": "park", "garden": "garden", "beach_resort": "beach_recreation", "sports_centre": "sports_venue", "stadium": "sports_venue", "sauna": "wellness"},
    "man_made": {"tower": "tower"},
    "shop": {
        "bakery": "bakery", "deli": "deli", "cheese": "deli", "books": "bookshop", "antiques": "antique_shop", "chocolate": "specialty_shop", "confectionery": "specialty_shop", "coffee": "specialty_shop",
        "tea": "specialty_shop", "wine": "specialty_shop",
    },
    "place": {"square": "square"},
}
#: Finer types of museums, waters and places of worship (fixed values).
MUSEUMS = {"art": "art_museum", "history": "history_museum", "science": "science_museum", "technology": "science_museum", "local": "local_museum", "house": "house_museum", "person": "house_museum", "open_air": "local_museum"}
WATERS = {"lake": "lake"}
WORSHIP_BUILDINGS = {"cathedral": "cathedral", "chapel": "chapel", "monastery": "monastery", "temple": "temple", "shrine": "shrine"}
TEMPLE_RELIGIONS = ("buddhist", "hindu")

#: Categories of the open map extract (fixed values).
CATEGORIES = {
    "church": "church", "cathedral": "cathedral", "chapel": "chapel", "monastery": "monastery", "mosque": "temple", "synagogue": "temple", "buddhist_temple": "temple", "hindu_temple": "temple", "religious_place": "church",
    "castle": "castle", "fort": "fortress", "historical_landmark": "monument", "monument": "monument", "memorial_site": "memorial", "archaeological_site": "archaeological_site",
    "museum": "local_museum", "art_museum": "art_museum", "history_museum": "history_museum", "science_museum": "science_museum", "art_gallery": "gallery",
    "park": "park", "garden": "garden", "botanical_garden": "garden", "beach": "beach", "waterfall": "waterfall", "cave": "cave", "scenic_point": "viewpoint", "forest": "forest", "lake": "lake",
    "restaurant": "restaurant", "cafe": "cafe", "coffee_shop": "cafe", "bakery": "bakery", "farmers_market": "market", "marketplace": "market", "winery": "winery", "brewery": "brewery", "distillery": "distillery", "delicatessen": "deli",
    "theater": "theatre", "concert_hall": "concert_hall", "movie_theater": "cinema", "cultural_center": "cultural_center", "public_art": "street_art",
    "landmark_and_historical_building": "notable_building", "plaza": "square", "bridge": "bridge", "observation_tower": "tower", "fountain": "fountain",
    "bookstore": "bookshop", "antique_store": "antique_shop", "specialty_food_store": "specialty_shop", "arts_and_crafts_store": "craft_studio",
    "hiking_trail": "walking_trail", "spa": "wellness", "stadium_arena": "sports_venue", "marina": "boat_activity",
    "pharmacy": "pharmacy", "public_toilet": "toilet", "ev_charging_station": "charging_point",
}

#: Classes of the knowledge base (fixed values).
CLASSES = {
    "Q16970": "church", "Q2977": "cathedral", "Q108325": "chapel", "Q44613": "monastery", "Q160742": "abbey", "Q697295": "shrine", "Q39614": "sacred_cemetery",
    "Q23413": "castle", "Q57821": "fortress", "Q109607": "ruin", "Q4989906": "monument", "Q5003624": "memorial", "Q839954": "archaeological_site", "Q35112127": "historic_house", "Q82117": "city_gate",
    "Q33506": "local_museum", "Q207694": "art_museum", "Q588140": "science_museum", "Q1970365": "local_museum", "Q2087181": "house_museum", "Q1007870": "gallery",
    "Q6017969": "viewpoint", "Q22698": "park", "Q167346": "garden", "Q1107656": "garden", "Q34038": "waterfall", "Q23397": "lake", "Q40080": "beach", "Q35509": "cave",
    "Q11707": "restaurant", "Q30022": "cafe", "Q274393": "bakery", "Q330284": "market", "Q156362": "winery", "Q131734": "brewery",
    "Q24354": "theatre", "Q1060829": "concert_hall", "Q41253": "cinema", "Q1329623": "cultural_center", "Q12518": "tower", "Q12280": "bridge", "Q174782": "square", "Q483453": "fountain",
}

#: Denominations of the monument register (fixed values).
DENOMINATIONS = {
    "église": "church", "église paroissiale": "church", "cathédrale": "cathedral", "basilique": "church", "chapelle": "chapel", "abbaye": "abbey", "prieuré": "monastery", "couvent": "monastery", "monastère": "monastery",
    "temple": "temple", "synagogue": "temple", "mosquée": "temple", "cloître": "monastery",
    "château": "castle", "château fort": "castle", "manoir": "castle", "palais": "castle", "édifice fortifié": "fortress", "fortification d'agglomération": "fortress", "fort": "fortress", "citadelle": "fortress",
    "enceinte": "fortress", "donjon": "fortress", "tour": "tower", "porte de ville": "city_gate",
    "site archéologique": "archaeological_site", "dolmen": "archaeological_site", "menhir": "archaeological_site", "tumulus": "archaeological_site", "oppidum": "archaeological_site", "aqueduc": "archaeological_site",
    "théâtre antique": "archaeological_site", "amphithéâtre": "archaeological_site", "arc de triomphe": "monument",
    "monument": "monument", "monument aux morts": "memorial", "croix monumentale": "monument", "croix de chemin": "monument", "croix de cimetière": "monument", "calvaire monumental": "monument", "fontaine": "fountain",
    "pont": "bridge", "moulin": "notable_building", "moulin à vent": "notable_building", "hôtel de ville": "notable_building", "beffroi": "tower", "halle": "market",
    "théâtre": "theatre", "opéra": "theatre", "musée": "history_museum", "bibliothèque": "cultural_center", "hôtel": "historic_house", "demeure": "historic_house", "villa": "historic_house",
}

#: Classes of the tourism ontology, the most specific first: the first that an object has counts (fixed values).
ONTOLOGY = {
    "Winery": "winery", "BreweryOrDistillery": "brewery", "BistroOrWineBar": "cafe", "BrasserieOrTavern": "restaurant", "GourmetRestaurant": "restaurant", "CafeOrCoffeeShop": "cafe", "CafeOrTeahouse": "cafe", "BarOrPub": "cafe",
    "Bakery": "bakery", "FoodProducer": "food_producer", "CoveredMarket": "market", "Market": "market", "Restaurant": "restaurant",
    "Museum": "history_museum", "ArtGalleryOrExhibitionGallery": "gallery", "InterpretationCentre": "cultural_center", "CulturalCentre": "cultural_center", "Theater": "theatre", "Theatre": "theatre", "Opera": "theatre",
    "ConcertHall": "concert_hall", "Cinema": "cinema", "Castle": "castle", "Citadel": "fortress", "Fortification": "fortress", "RemarkableBuilding": "notable_building", "ArcheologicalSite": "archaeological_site",
    "ArchaeologicalSite": "archaeological_site", "RemembranceSite": "memorial", "TechnicalHeritage": "notable_building", "ReligiousSite": "church", "Church": "church", "Cathedral": "cathedral", "Abbey": "abbey", "CulturalSite": "cultural_center",
    "CraftsmanShop": "artisan_workshop", "ArtCraft": "artisan_workshop", "BoutiqueOrLocalShop": "specialty_shop",
    "ParkAndGarden": "park", "Park": "park", "Garden": "garden", "NaturalHeritage": "geological_feature", "Beach": "beach", "Lake": "lake", "Cave": "cave", "Viewpoint": "viewpoint", "HikingTrail": "walking_trail", "WalkingTour": "walking_trail",
    "CyclingTour": "cycling_route", "SwimmingPool": "wellness", "SpaAndWellness": "wellness", "AmusementPark": "sports_venue", "ThemePark": "sports_venue", "StadiumOrArena": "sports_venue",
}


def mapped(value: Column, table: dict[str, str]) -> Column:
    """The table's entry for a value; null where it has none."""
    return F.when(value.isNotNull(), F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value))


def type_of_tags(tags: Column) -> Column:
    """The type of the first key, in their order, whose value is known."""
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    found = {k: mapped(tag(k), table) for k, table in TAGS.items()}
    found["tourism"] = F.when(tag("tourism") == "museum", F.coalesce(mapped(tag("museum"), MUSEUMS), F.lit(TAGS["tourism"]["museum"]))).otherwise(found["tourism"])
    found["natural"] = F.when(tag("natural") == "water", mapped(tag("water"), WATERS)).otherwise(found["natural"])
    of_building = {k: F.when(tag("building") == k, F.lit(t)) for k, t in WORSHIP_BUILDINGS.items()}
    of_building["temple"] = F.when((tag("building") == "temple") | tag("religion").isin(*TEMPLE_RELIGIONS), F.lit("temple"))
    worship = F.coalesce(*of_building.values(), F.lit(TAGS["amenity"]["place_of_worship"]))
    found["amenity"] = F.when(tag("amenity") == "place_of_worship", worship).otherwise(found["amenity"])
    return F.coalesce(*found.values())


def type_of_denomination(name: Column) -> Column:
    """The denomination as a whole, else its first word."""
    key = F.lower(F.trim(name))
    return F.coalesce(mapped(key, DENOMINATIONS), mapped(F.substring_index(key, " ", 1), DENOMINATIONS))


def type_of_classes(classes: Column, table: dict[str, str] = ONTOLOGY) -> Column:
    """The type of the first class of the table that is among classes."""
    return mapped(F.get(F.filter(F.array(*[F.lit(k) for k in table]), lambda k: F.array_contains(classes, k)), F.lit(0)), table)
