"""Statistics from open-data feeds. `as_of` is always given; nothing asks for the current time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .urls import dedupe_first, fresh, keep_checkpoints


def latest_only(df: DataFrame, column: str) -> DataFrame:
    """Rows with the column's greatest value: one partial maximum, one row broadcast."""
    latest = fresh(df, "_latest")
    return df.join(F.broadcast(df.agg(F.max(column).alias(latest))), F.col(column) == F.col(latest)).drop(latest)


def latest_available_year(df: DataFrame, year: str, as_of: int, back: int = 2) -> DataFrame:
    return latest_only(df.where(F.col(year).between(as_of - back, as_of)), year)


def crime_stats(df: DataFrame, district: str | None = None, category: str | None = None) -> DataFrame:
    """Latest year: offences and mean frequency by district and title. df: year, district, municipality, title, offences, frequency.

    Rows with a district count; only if no row has one, those of a municipality with "rich" in its name, whose null
    districts go and whose empty ones are 'Gesamt'. `district` is a number from 1 to 12, or 'kreis N', and matches whole.
    """
    rows = latest_only(df, "year")
    named = F.coalesce("district", F.lit("")) != ""
    has = rows.agg(F.coalesce(F.bool_or(named), F.lit(False)).alias("_has"))
    rows = rows.crossJoin(F.broadcast(has)).where(F.when(F.col("_has"), named).otherwise(F.lower("municipality").contains("rich") & F.col("district").isNotNull())).drop("_has")
    if district:
        number = district.lower().strip().removeprefix("kreis ")
        if number not in {str(n) for n in range(1, 13)}:
            raise ValueError(f"no district {district!r}")
        rows = rows.where(F.col("district") == f"Kreis {number}")
    rows = rows.where(F.lower("title").contains(category.lower())) if category else rows
    label = F.when(F.col("district") == "", "Gesamt").otherwise(F.col("district"))
    return rows.groupBy(label.alias("district"), "title").agg(F.sum("offences").alias("offences"), F.bround(F.avg("frequency"), 1).alias("frequency")).orderBy(F.desc("offences"), "district", "title")


def rent_prices(df: DataFrame, quarter: str | None = None, rooms: str | None = None, nonprofit: bool = False) -> DataFrame:
    """Latest year's net rents of flats. The name is looked up in area, and in area_group if no area has it; rooms
    are chosen after that.
    """
    rows = latest_only(df, "year").where((F.col("price_kind") == "net") & (F.col("unit") == "flat") & (F.col("nonprofit") == nonprofit))
    if quarter:
        in_area, in_group = (F.lower(c).contains(quarter.lower()) for c in ("area", "area_group"))
        hits = F.broadcast(rows.agg(F.count_if(in_area).alias("_hits")))
        rows = rows.crossJoin(hits).where(F.when(F.col("_hits") > 0, in_area).otherwise(in_group)).drop("_hits")
    rows = rows.where(F.col("rooms") == rooms) if rooms else rows
    return rows.select("year", "area", "rooms", *[F.bround(c).cast("long").alias(c) for c in ("qu25", "qu50", "mean", "qu75")])


def latest_readings(df: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """The last non-null value of each column by key; rows with a null key go."""
    rows = df.dropna(subset=keys)
    return rows.groupBy(*keys).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in columns])


def limit_check(df: DataFrame, keys: list[str], value: str, limit: str) -> DataFrame:
    """Adds ok (value within its limit; null limits hold) and all_ok by key."""
    ok = F.coalesce(F.col(value) <= F.col(limit), F.lit(True))
    return df.withColumn("ok", ok).withColumn("all_ok", F.bool_and("ok").over(W.partitionBy(*keys)))


def water_quality(df: DataFrame, location: str | None = None, key_parameters: list[str] | None = None) -> DataFrame:
    """Latest non-null value and limit by location and parameter, of the parameters whose name holds a key one; ok,
    all_ok by location and overall_ok for all.
    """
    rows = df.where(F.lower("location").contains(location.lower())) if location else df
    if key_parameters is not None:
        rows = rows.where(F.exists(F.array(*map(F.lit, key_parameters)), lambda k: F.contains(F.col("parameter"), k)))
    last = limit_check(latest_readings(rows, ["location", "parameter"], "day", ["value", "max_value"]), ["location"], "value", "max_value")
    return last.crossJoin(F.broadcast(last.agg(F.bool_and("ok").alias("overall_ok"))))


#: Limits of the key pollutants.
POLLUTANT_LIMITS = {"NO2": 80.0, "PM10": 50.0, "PM2.5": 25.0, "O3": 120.0, "O3_max_h1": 120.0, "SO2": 100.0, "CO": 8.0}


def air_quality(df: DataFrame, names: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """(station, name, day, measurements, key_pollutants) of the latest day's stations.

    df: day, station, parameter, value (text), unit, status. measurements: all of them in order, values that are no
    numbers null; key_pollutants: those with a number of the limits' keys, with their limit. names: (station, name),
    a station's own id where it has none.
    """
    limits = POLLUTANT_LIMITS if limits is None else limits
    limit = F.try_element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("parameter"))
    rows = latest_only(df, "day").withColumn("number", F.col("value").try_cast("double"))
    one = F.struct("parameter", F.col("number").alias("value"), "unit", "status")
    key = F.when(F.col("number").isNotNull() & limit.isNotNull(), F.struct("parameter", F.col("number").alias("value"), "unit", limit.alias("limit")))
    found = rows.groupBy("day", "station").agg(F.array_sort(F.collect_list(one)).alias("measurements"), F.array_sort(F.collect_list(key)).alias("key_pollutants"))
    return found.join(names, "station", "left").select("station", F.coalesce("name", "station").alias("name"), "day", "measurements", "key_pollutants")


def sensor_latest_and_mean(df: DataFrame, key: str, ts: str, val: str, hours: int, as_of: str, zone: str = "Europe/Zurich") -> DataFrame:
    """Of the last `hours` (1 to 24): the latest reading (local time) and the mean, cut to a whole number."""
    end = F.lit(as_of).cast("timestamp")
    rows = df.where((F.col(ts) <= end) & (F.col(ts) >= end - F.make_interval(hours=F.lit(min(24, max(1, hours))))))
    return rows.groupBy(key).agg(
        F.date_format(F.from_utc_timestamp(F.max(ts), zone), "yyyy-MM-dd HH:mm:ss").alias("latest_at"),
        F.max_by(val, ts).alias("latest"),
        F.avg(val).cast("long").alias("mean"),
        F.count("*").alias("n"),
    )


def trailing_window(df: DataFrame, ts: str, hours: int) -> DataFrame:
    """Rows of the hours before the last reading, with that reading's time as last_at."""
    last = F.broadcast(df.agg(F.max(ts).alias("last_at")))
    return df.crossJoin(last).where(F.col(ts) >= F.col("last_at") - F.make_interval(hours=F.lit(hours)))


def electricity_load(df: DataFrame, ts: str, kw: str, as_of: str, hours: int = 4) -> DataFrame:
    rows = trailing_window(df.where(F.col(kw).isNotNull()), ts, hours)
    lag = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_at")) / 3600
    return rows.select(F.col(ts).alias("ts"), F.round(F.col(kw) / 1000, 1).alias("mw"), F.round(lag, 1).alias("lag_hours"))


def latest_kpis(df: DataFrame) -> DataFrame:
    return latest_only(df, "day").select("day", "label", "value", "unit")


def last_n(df: DataFrame, test: Column, ts: str, n: int) -> DataFrame:
    return df.where(test).orderBy(F.desc(ts)).limit(n).orderBy(ts)


def number(column: str, kind: str) -> Column:
    return F.coalesce(F.col(column).try_cast(kind), F.lit(0).cast(kind))


def voting_results(df: DataFrame, date_prefix: str | None = None, level: str | None = None, district: int | None = None, n: int = 10) -> DataFrame:
    """Votes grouped by date, text and level with their results nested; the newest n; how many there are in all.

    If yes or no does not parse both are 0, and likewise for the three percentages.
    """
    rows = df
    if date_prefix:
        rows = rows.where(F.col("day").startswith(date_prefix))
    if level:
        rows = rows.where(F.lower("level").contains(level.lower()))
    if district:
        rows = rows.where(F.col("district_no").try_cast("int") == district)
    if not (date_prefix or level or district):
        rows = latest_only(rows, "day")
    counts = [F.col(c).try_cast("long") for c in ("yes", "no")]
    whole = counts[0].isNotNull() & counts[1].isNotNull()
    shares = [F.col(c).try_cast("double") for c in ("turnout", "yes_share", "no_share")]
    parsed = shares[0].isNotNull() & shares[1].isNotNull() & shares[2].isNotNull()
    result = F.struct(
        F.col("area"),
        *[F.when(whole, c).otherwise(0).alias(x) for c, x in zip(counts, ("yes", "no"))],
        *[F.when(parsed, c).otherwise(0.0).alias(x) for c, x in zip(shares, ("turnout", "yes_share", "no_share"))],
    )
    # the newest votes first, so that results are gathered for n votes alone
    keys = rows.select("day", "text", "level").distinct()
    newest = keys.orderBy(F.desc("day"), "text", "level").limit(n).select(*[F.col(c).alias(f"_{c}") for c in keys.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys.columns]
    groups = rows.join(F.broadcast(newest), same).groupBy("day", "text", "level").agg(F.array_sort(F.collect_list(result)).alias("results"))
    return groups.crossJoin(F.broadcast(keys.agg(F.count("*").alias("total"))))


def upcoming(df: DataFrame, zip_: str | None, days: int, as_of: str) -> DataFrame:
    """Rows whose day parses and is within `days` from as_of."""
    day = F.try_to_date(F.col("day"), "yyyy-MM-dd")
    rows = df.where(F.col("zip").startswith(zip_)) if zip_ else df
    start = F.lit(as_of).cast("date")
    return rows.withColumn("date", day).where(F.col("date").between(start, F.date_add(start, days)))


def waste_schedule(df: DataFrame, kind: str, zip_: str | None, days: int, as_of: str, n: int = 30) -> DataFrame:
    """The first n dates of a kind, one row a date and zip, with the total."""
    rows = dedupe_first(upcoming(df.where(F.col("kind") == kind), zip_, days, as_of), ["date", "zip"], [F.col("station")])
    total = F.broadcast(rows.agg(F.count("*").alias("total")))
    return rows.orderBy("date", "zip").limit(n).crossJoin(total).select("kind", F.date_format("date", "dd.MM.yyyy").alias("date"), "zip", "station", "total")


def mobile_schedule(df: DataFrame, zip_: str | None, days: int, as_of: str) -> DataFrame:
    return upcoming(df, zip_, days, as_of).select(F.date_format("date", "dd.MM.yyyy").alias("date"), "zip", "station")


def all_schedules(df: DataFrame, mobile: DataFrame, zip_: str | None, days: int, as_of: str, first: int = 5, first_mobile: int = 3) -> DataFrame:
    """The first dates of every kind, and of the mobile one, in one table."""
    fixed = dedupe_first(upcoming(df, zip_, days, as_of), ["kind", "date", "zip"], [F.col("station")]).select("kind", "date", "zip", "station")
    rows = fixed.unionByName(upcoming(mobile, zip_, days, as_of).select(F.lit("mobile").alias("kind"), "date", "zip", "station"))
    rank = F.row_number().over(W.partitionBy("kind").orderBy("date", "zip", "station"))
    # the plain limit is what Spark applies before the shuffle, in every task
    some = rows.withColumn("n", rank).where(F.col("n") <= max(first, first_mobile))
    return some.where(F.col("n") <= F.when(F.col("kind") == "mobile", first_mobile).otherwise(first))


def collection_points(df: DataFrame, materials: list[str], zip_: str | None = None, material: str | None = None, synonyms: dict[str, str] | None = None) -> DataFrame:
    """Stations with the materials that an x marks; `material` may be one of the synonyms of one."""
    marked = F.array_compact(F.array(*[F.when(F.lower(F.trim(m)) == "x", F.lit(m)) for m in materials]))
    rows = df.withColumn("materials", marked)
    rows = rows.where(F.col("zip").startswith(zip_)) if zip_ else rows
    material = (synonyms or {}).get(material.lower().strip(), material) if material else material
    return rows.where(F.array_contains("materials", material)) if material else rows


def parking_occupancy(df: DataFrame, text: str | None = None) -> DataFrame:
    """Whole per cent, half to even, for open lots with places."""
    rows = df.where(F.lower("name").contains(text.lower()) | F.lower("address").contains(text.lower())) if text else df
    share = F.when((F.col("state") == "open") & (F.col("total") > 0), F.bround((1 - F.col("free") / F.col("total")) * 100).cast("long"))
    return rows.withColumn("occupancy", share)


def bath_lookup(df: DataFrame, name: str, seasonal: DataFrame) -> DataFrame:
    """Baths whose name contains the one asked for or is contained in it; listed ones without data as seasonal."""
    asked = F.lit(name.lower())
    match = lambda c: F.lower(c).contains(asked) | F.contains(asked, F.lower(c))
    here = df.where(match(F.col("title"))).select("title", "temperature", F.lit(False).alias("seasonal"))
    rest = seasonal.where(match(F.col("title"))).join(here.select("title"), "title", "left_anti")
    return here.unionByName(rest.select("title", F.lit(None).cast("double").alias("temperature"), F.lit(True).alias("seasonal")))


def zip_forecast(df: DataFrame, arrays: list[str], codes: DataFrame) -> DataFrame:
    """Parallel arrays as rows; weather codes looked up, 'Unknown' if not listed."""
    rows = df.select(F.explode(F.arrays_zip(*arrays)).alias("x")).select("x.*")
    return rows.join(codes, "code", "left").withColumn("label", F.coalesce("label", F.lit("Unknown")))


def departures(df: DataFrame) -> DataFrame:
    """board: array<struct<category,number,to,delay>>."""
    row = df.select("station", F.explode("board").alias("b"))
    return row.select("station", F.concat(F.col("b.category"), F.coalesce("b.number", F.lit(""))).alias("line"), F.col("b.to").alias("to"), F.coalesce("b.delay", F.lit(0)).alias("delay"))


def duration_text(value: Column) -> Column:
    """00d01:05:00 as '1h 5min'; days count as 24 hours."""
    part = lambda i: F.coalesce(F.regexp_extract(value, r"^(\d+)d(\d+):(\d+):(\d+)$", i).try_cast("int"), F.lit(0))
    hours = part(1) * 24 + part(2)
    return F.when(hours > 0, F.concat(hours, F.lit("h "), part(3), F.lit("min"))).otherwise(F.concat(part(3), F.lit("min")))


def connections(df: DataFrame) -> DataFrame:
    """sections: array<struct<line,walk>>, walk in seconds; a walk becomes minutes, rounded down."""
    text = F.transform("sections", lambda s: F.when(s["walk"].isNotNull(), F.concat(F.lit("walk "), F.floor(s["walk"] / 60), F.lit(" min"))).otherwise(s["line"]))
    return df.select("id", duration_text(F.col("duration")).alias("duration"), F.array_join(text, " > ").alias("route"))


def events_upcoming(df: DataFrame, rubrics: DataFrame, as_of: str, n: int, category: str | None = None) -> DataFrame:
    rows = df.join(rubrics, "rubric_id", "left").withColumn("rubric", F.coalesce("rubric", F.lit("Sonstige"))).where(F.col("begin") >= F.lit(as_of).cast("timestamp"))
    rows = rows.where(F.lower("rubric").contains(category.lower())) if category else rows
    return rows.orderBy("begin", "id").limit(n).select("id", "rubric", F.date_format("begin", "dd.MM.yyyy").alias("day"))


#: Entities that descriptions use.
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&auml;": "ä", "&ouml;": "ö", "&uuml;": "ü", "&Auml;": "Ä", "&Ouml;": "Ö", "&Uuml;": "Ü",
    "&szlig;": "ß", "&eacute;": "é", "&egrave;": "è", "&agrave;": "à", "&ccedil;": "ç", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&bull;": "•", "&amp;": "&",
}


def strip_html(text: Column) -> Column:
    """Entities resolved, then tags taken out, blanks squeezed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    for entity, sign in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"(?U)\s+", " "))


#: Day names.
DAYS = {"Mo": "Mon", "Tu": "Tue", "We": "Wed", "Th": "Thu", "Fr": "Fri", "Sa": "Sat", "Su": "Sun"}
HOURS = r"^([A-Za-z,]+)\s+(\d{2}:\d{2}):\d{2}-(\d{2}:\d{2}):\d{2}"


def opening_hours(entries: Column) -> Column:
    """'Mo,Tu 09:00:00-18:00:00' entries as 'Mon,Tue 09:00-18:00', joined by '; '; others are left out."""

    def one(entry: Column) -> Column:
        days = F.regexp_extract(entry, HOURS, 1)
        for short, name in DAYS.items():
            days = F.replace(days, F.lit(short), F.lit(name))
        return F.concat(days, F.lit(" "), F.regexp_extract(entry, HOURS, 2), F.lit("-"), F.regexp_extract(entry, HOURS, 3))

    return F.coalesce(F.array_join(F.transform(F.filter(entries, lambda e: e.rlike(HOURS)), one), "; "), F.lit(""))


#: What kinds of places are called.
PLACE_KINDS = {
    "Restaurant": "restaurant", "BarOrPub": "bar", "CafeOrCoffeeShop": "cafe", "Hotel": "hotel", "Hostel": "hostel", "BedAndBreakfast": "b&b", "Museum": "museum", "CivicStructure": "attraction",
    "LocalBusiness": "venue", "Place": "place", "TouristAttraction": "attraction", "LandmarksOrHistoricalBuildings": "landmark",
}


def venues(df: DataFrame, n: int, name: str | None = None) -> DataFrame:
    """Named places: df has identifier, name_de, name_en, description, full_description, hours (array), category (map),
    kind, custom_kind, street, postcode, city, lat, lon.

    With a name the first n whose name holds it; without one only the first n raw rows count, and nameless ones go.
    """
    rows = df if name else df.orderBy("identifier").limit(n)
    label = F.coalesce(F.nullif("name_de", F.lit("")), F.nullif("name_en", F.lit("")))
    kinds = F.array_sort(F.map_keys(F.map_filter("category", lambda k, v: F.coalesce(F.length(v), F.lit(0)) > 0)))
    text = lambda c: F.coalesce(c, F.lit(""))
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in PLACE_KINDS.items() for x in pair]), text("kind"))
    address = F.concat(text("street"), F.lit(", "), text("postcode"), F.lit(" "), text("city"))
    number = lambda c: F.when(F.col(c) != 0, F.col(c).cast("double"))
    rows = rows.select(
        "identifier",
        label.alias("name"),
        F.coalesce(F.lower(F.nullif("custom_kind", F.lit(""))), known, F.lit("venue")).alias("kind"),
        strip_html(F.col("description")).alias("description"),
        F.substring(strip_html(F.col("full_description")), 1, 500).alias("full_description"),
        opening_hours(F.col("hours")).alias("opening_hours"),
        F.array_join(F.coalesce(kinds, F.array().cast("array<string>")), ", ").alias("kinds"),
        F.btrim(address, F.lit(", ")).alias("address"),
        number("lat").alias("lat"),
        number("lon").alias("lon"),
    ).where("name is not null")
    return rows.where(F.lower("name").contains(name.lower())).orderBy("identifier").limit(n) if name else rows


def poi_tag_for(query: Column, terms: list[tuple[str, str, str]], brands: list[str]) -> Column:
    """key=value of the first term in the query; name~brand for brands; else name~query."""
    text = F.lower(query)
    out = F.concat(F.lit("name~"), text)
    for brand in reversed(brands):
        out = F.when(text.contains(brand), F.lit(f"name~{brand}")).otherwise(out)
    for term, key, value in reversed(terms):
        out = F.when(text.contains(term), F.lit(f"{key}={value}")).otherwise(out)
    return out


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6_371_000 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


#: Places of a cell beyond which cells are split, and how often at most (2 ** 20 of 15 km are 15 mm).
PLACES_IN_CELL, SPLITS = 128, 20


def poi_nearest(points: DataFrame, pois: DataFrame, radius_m: float, k: int) -> DataFrame:
    """(point_id, poi_id, metres, rank): the k nearest places within the radius, below 80 degrees of latitude.

    Cells as wide as the radius are split in four until none holds more than PLACES_IN_CELL places. Points look into
    their own and the eight cells around it, first among the smallest cells; one that finds k places within a cell's
    width has its k nearest and stops, the others go on with cells twice as wide. So in a dense quarter a point meets
    few places, however many the quarter has. Of places at one spot only the first k can count. Rows without coordinates are left out.
    """
    spot = F.row_number().over(W.partitionBy("lat", "lon").orderBy("poi_id"))
    places = pois.select("poi_id", "lat", "lon").where("lat is not null and lon is not null").withColumn("_n", spot).where(F.col("_n") <= k).drop("_n")
    left = points.select("point_id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1")).where("lat1 is not null and lon1 is not null")
    side = radius_m / 111_000

    def cell(lat: str, lon: str, level: int) -> tuple[Column, Column]:
        return F.floor(F.col(lat) / (side / 2**level)).alias("gy"), F.floor(F.col(lon) / (side / 0.17 / 2**level)).alias("gx")

    level = 0
    most = lambda level: places.groupBy(*cell("lat", "lon", level)).count().agg(F.max("count")).first()[0] or 0
    while level < SPLITS and most(level) > PLACES_IN_CELL:
        level += 1
    if level:
        keep_checkpoints(points.sparkSession)
        places = places.checkpoint()
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    rank = F.row_number().over(W.partitionBy("point_id").orderBy("m", "poi_id"))
    done = None
    for at in range(level, -1, -1):
        looked = left.select("*", *cell("lat1", "lon1", at)).withColumn("d", F.explode(around))
        looked = looked.select("point_id", "lat1", "lon1", (F.col("gy") + F.col("d.dy")).alias("gy"), (F.col("gx") + F.col("d.dx")).alias("gx"))
        both = looked.join(places.select("*", *cell("lat", "lon", at)), ["gy", "gx"])
        near = both.withColumn("m", haversine(F.col("lat1"), F.col("lon1"), F.col("lat"), F.col("lon"))).where(F.col("m") <= radius_m / 2**at)
        found = near.withColumn("rank", rank).where(F.col("rank") <= k).select("point_id", "poi_id", F.col("m").cast("long").alias("metres"), "rank")
        if at:
            found = found.checkpoint()
            full = found.where(F.col("rank") == k).select("point_id")
            found, left = found.join(full, "point_id", "left_semi"), left.join(full, "point_id", "left_anti").checkpoint()
        done = found if done is None else done.unionByName(found)
    return done
