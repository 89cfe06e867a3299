"""A reference list against observed stores, and addresses against a gazetteer."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.storage import materialise


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"_city": text.city(F.col("city")), "_name": text.store_name(F.col("name"))})


def matched(reference: DataFrame, observed: DataFrame) -> DataFrame:
    """Rows of the reference (city, name) with an observed store of equal normalised city and name."""
    keys = _keyed(observed).select("_city", "_name").distinct()
    return _keyed(reference).join(keys.hint("merge"), ["_city", "_name"], "left_semi").drop("_city", "_name")


def unmatched(reference: DataFrame, observed: DataFrame) -> DataFrame:
    keys = _keyed(observed).select("_city", "_name").distinct()
    return _keyed(reference).join(keys.hint("merge"), ["_city", "_name"], "left_anti").drop("_city", "_name")


def match_totals(reference: DataFrame, observed: DataFrame) -> DataFrame:
    keys = _keyed(observed).select("_city", "_name").distinct().withColumn("hit", F.lit(True))
    out = _keyed(reference).join(keys.hint("merge"), ["_city", "_name"], "left")
    return out.agg(F.count("*").alias("total"), F.count_if(F.col("hit")).alias("matched"), F.count_if(F.col("hit").isNull()).alias("unmatched"))


def keys_by_city(df: DataFrame) -> DataFrame:
    return _keyed(df).groupBy(F.col("_city").alias("city_key")).agg(F.count_distinct("_name").alias("keys"))


def complete_cities(reference: DataFrame, observed: DataFrame) -> DataFrame:
    """city, missing, complete: whether all reference keys of a city are observed."""
    keys = _keyed(observed).select("_city", "_name").distinct().withColumn("hit", F.lit(True))
    own = _keyed(reference).select("city", "_city", "_name").distinct().join(keys.hint("merge"), ["_city", "_name"], "left")
    return own.groupBy("city").agg(F.count_if(F.col("hit").isNull()).alias("missing")).withColumn("complete", F.col("missing") == 0)


def gap_fill(reference: DataFrame, observed: DataFrame, gazetteer: DataFrame, brand: str) -> DataFrame:
    """Unmatched reference rows that a second list finds under their name or brand + name.

    ``gazetteer`` has city and name; a row is filled when the found name normalises to its own key.
    """
    left = unmatched(reference, observed)
    tries = left.select("city", "name", F.posexplode(F.array(F.col("name"), F.concat(F.lit(brand), "name"))).alias("pos", "tried"))
    known = gazetteer.select(text.city(F.col("city")).alias("_city"), F.col("name").alias("tried")).distinct()
    found = tries.withColumn("_city", text.city(F.col("city"))).join(known.hint("merge"), ["_city", "tried"])
    own = found.where(text.store_name(F.col("tried")) == text.store_name(F.col("name")))
    return own.groupBy("city", "name").agg(F.min_by("tried", "pos").alias("found_name"))


def lookup(addresses: DataFrame, gazetteer: DataFrame, provider: str = "amap") -> DataFrame:
    """Addresses (address) with the hit of their normalised form; the key has no city, so the first by ``seq`` counts."""
    cache = gazetteer.withColumn("_norm", text.one_space(F.col("address"))).withColumn("_score", text.confidence(F.col("level"))).where(text.acceptable(F.col("_score")))
    best = cache.groupBy("_norm").agg(F.min_by(F.struct("lng", "lat", F.col("_score").alias("confidence")), "seq").alias("hit"))
    own = addresses.withColumn("_norm", text.one_space(F.col("address")))
    return own.join(best.hint("merge"), "_norm", "left").drop("_norm").withColumn("provider", F.lit(provider))


def cascade(records: DataFrame, gazetteer: DataFrame, pois: DataFrame, centres: DataFrame, key: str = "id") -> DataFrame:
    """Coordinates for records by the first hit of: addresses x cities, name among points of interest, city centre.

    Every candidate of a record is a row (stage, address place, city place) of one equi-join
    against the three lists together; the smallest place wins.
    """
    cities = text.city_candidates(F.col("address"), F.col("city"))
    places = F.array_distinct(F.array_compact(F.concat(F.array(text.blank_to_null(F.col("address"))), F.coalesce(text.address_fallbacks(F.col("address")), F.array().cast("array<string>")), F.array(text.join_region(F.col("province"), F.col("city"), F.col("district"))))))
    tries = F.concat(
        F.transform(places, lambda a: F.struct(F.lit(0).alias("stage"), text.one_space(a).alias("what"))),
        F.array_compact(F.array(F.when(F.coalesce(F.col("name"), F.lit("")) != "", F.struct(F.lit(1).alias("stage"), F.col("name").alias("what"))))),
    )
    cross = F.flatten(F.transform(tries, lambda t, p: F.transform(cities, lambda city, c: F.struct(t["stage"].alias("stage"), t["what"].alias("what"), F.coalesce(city, F.lit("")).alias("city"), p.alias("p"), c.alias("c")))))
    towns = F.transform(cities, lambda city, c: F.struct(F.lit(2).alias("stage"), city.alias("what"), F.coalesce(city, F.lit("")).alias("city"), F.lit(0).alias("p"), c.alias("c")))
    # dealt by record once, so that few large input splits are not exploded and sorted by as few tasks
    asked = records.repartition(key).select(key, F.explode(F.concat(cross, F.filter(towns, lambda t: t["what"].isNotNull()))).alias("a")).select(key, "a.*")
    score = text.confidence(F.col("level"))
    known = gazetteer.where(text.acceptable(score)).select(F.lit(0).alias("stage"), text.one_space(F.col("address")).alias("what"), F.coalesce("city", F.lit("")).alias("city"), "lng", "lat", F.col("address").alias("formatted"))
    known = known.unionByName(pois.select(F.lit(1).alias("stage"), F.col("name").alias("what"), F.coalesce("city", F.lit("")).alias("city"), "lng", "lat", text.poi_address(F.col("district"), F.col("address")).alias("formatted")))
    known = known.unionByName(centres.select(F.lit(2).alias("stage"), F.col("city").alias("what"), "city", "lng", "lat", F.lit(None).cast("string").alias("formatted")))
    known = known.groupBy("stage", "what", "city").agg(F.min(F.struct("lng", "lat", "formatted")).alias("hit"))
    # only what is asked for: where that is little, Spark's size check broadcasts it, and no hot question is a skewed key
    questions = asked.select("stage", "what", "city").distinct()
    known = materialise(known.join(questions.hint("merge"), ["stage", "what", "city"], "left_semi"), "known")
    hits = asked.join(known, ["stage", "what", "city"])
    return hits.groupBy(key).agg(F.min_by(F.struct(F.col("stage"), F.col("hit.lng").alias("lng"), F.col("hit.lat").alias("lat"), F.col("hit.formatted").alias("formatted")), F.struct("stage", "p", "c")).alias("h")).select(key, "h.*")


def enrich(records: DataFrame, hits: DataFrame, key: str = "id") -> DataFrame:
    """Records with missing coordinates filled from ``hits``; damaged texts take the hit's address."""
    found = hits.select(key, F.col("lng").alias("h_lng"), F.col("lat").alias("h_lat"), F.col("formatted").alias("h_address"))
    both = records.join(found.hint("merge"), key, "left")
    use = (F.col("lng").isNull() | F.col("lat").isNull()) & (F.coalesce("address", F.lit("")) != "") & F.col("h_lng").isNotNull()
    mend = use & (text.damaged(F.col("address")) | text.damaged(F.col("name"))) & (F.coalesce("h_address", F.lit("")) != "") & ~text.damaged(F.col("h_address"))
    return both.select(
        *(c for c in records.columns if c not in ("lng", "lat", "coordinate_system", "address")),
        F.when(mend, F.col("h_address")).otherwise(F.col("address")).alias("address"),
        F.when(use, F.col("h_lng")).otherwise(F.col("lng")).alias("lng"),
        F.when(use, F.col("h_lat")).otherwise(F.col("lat")).alias("lat"),
        F.when(use, F.lit("WGS84")).otherwise(F.col("coordinate_system")).alias("coordinate_system"),
    )
