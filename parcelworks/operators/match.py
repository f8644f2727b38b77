"""Matching of parcels and lots by number, in both directions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelworks.functions.maps import effective_scale, estimated_area, is_arbitrary, normalize_municipality
from parcelworks.functions.numbers import branch_of, joined_number, match_level, parent_of, whole_number
from parcelworks.operators import spatial
from parcelworks.sources.scratch import dealt, written

LEVELS = ("exact", "parent", "near")


def priority(level: Column) -> Column:
    return F.when(level == "exact", 0).when(level == "parent", 1).when(level == "near", 2)


def oaza_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of distinct district names that are equal or of which one begins the other. Each name is
    joined to the prefixes of the other list, so that this is an equi-join both ways."""
    a = left.select("oaza_name").where("oaza_name <> ''").distinct().select(F.col("oaza_name").alias("a"))
    b = right.select("oaza_name").where("oaza_name <> ''").distinct().select(F.col("oaza_name").alias("b"))
    heads = lambda df, c: df.select(c, F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(F.col(c), F.lit(1), n))).alias("head"))
    one = heads(a, "a").join(b, F.col("head") == F.col("b")).select("a", "b")
    two = heads(b, "b").join(a, F.col("head") == F.col("a")).select("a", "b")
    return one.union(two).distinct()


def municipality_fits(lot_name: Column, map_name: Column) -> Column:
    """A lot stays unless both names are there and the map's does not contain the lot's."""
    return (F.coalesce(lot_name, F.lit("")) == "") | (F.coalesce(map_name, F.lit("")) == "") | F.contains(map_name, lot_name)


def lot_numbers(lots: DataFrame) -> DataFrame:
    """``lots`` whose parent_no and branch_no are text: null, empty and the number 0 are empty, whole numbers have no decimals."""
    kinds = dict(lots.dtypes)

    def text(c: str) -> Column:
        if kinds[c] == "string":
            return F.coalesce(c, F.lit(""))
        whole = F.when(F.col(c) == F.floor(c), F.floor(c).cast("bigint").cast("string")).otherwise(F.col(c).cast("string"))
        return F.coalesce(F.when(F.col(c) != 0, whole), F.lit(""))

    return lots.withColumns({c: text(c) for c in ("parent_no", "branch_no")})


def _nested(levels) -> bool:
    """Whether no level is asked for without those before it: then the best key of a pair is that of its level."""
    return set(levels) == set(LEVELS[: len(set(levels))])


#: First characters of the keys under which two numbers of a level meet.
KINDS = {"exact": "=", "parent": "^", "near": "~"}


def _key_list(parent: Column, branch: Column, levels) -> list[Column]:
    """A key for each level: the joined number; the parent; its length with all but its last character."""
    size = F.length(parent)
    text = {"exact": joined_number(parent, branch), "parent": parent, "near": F.concat(size.cast("string"), F.lit(":"), F.substring(parent, F.lit(1), size - 1))}
    return [F.concat(F.lit(KINDS[x]), text[x]) for x in LEVELS if x in levels]


def _keys(parent: Column, branch: Column, levels) -> Column:
    return F.array(*_key_list(parent, branch, levels))


def _meeting_key(parent: Column, branch: Column, levels) -> Column:
    """The key of the widest of the levels: numbers of a narrower one have it in common as well."""
    return _key_list(parent, branch, levels)[-1]


def _lot_keys(parent: Column, branch: Column, levels) -> Column:
    """``_meeting_key`` of a lot, and that of its joined number cut at the first hyphen, under which a parcel of the same joined number stands where the lot's parent has a hyphen."""
    head = F.element_at(F.split(joined_number(parent, branch), "-", 2), 1)
    return F.array_distinct(F.array(_meeting_key(parent, branch, levels), _meeting_key(head, F.lit(""), levels)))


def _equal() -> Column:
    return F.col("p_joined") == F.col("q_joined")


def _same() -> Column:
    return F.col("p_parent") == F.col("q_parent")


def _hit(levels, may_be_near: Column | None = None) -> Column:
    """Whether a parcel and a lot (p_joined, p_parent; q_joined, q_parent, ``place`` of the lot's key) that meet under a key match at one of the levels: under the lot's first key, its own, they are near at least."""
    near = ~_equal() & ~_same() & (F.col("place") == 0)
    hits = {"exact": _equal(), "parent": ~_equal() & _same(), "near": near if may_be_near is None else near & may_be_near}
    return reduce(Column.__or__, [hits[x] for x in LEVELS if x in levels])


def _hit_level() -> Column:
    return F.when(_equal(), "exact").when(_same(), "parent").otherwise("near")


def _numbered(parcels: DataFrame) -> DataFrame:
    return parcels.withColumns({"p_parent": parent_of(F.col("chiban")), "p_branch": branch_of(F.col("chiban"))}).where("p_parent <> ''")


#: Stands for all districts; no district has this name.
ALL = "*"


def _sides(parcels: DataFrame, lots: DataFrame, areas: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Parcels and lots with ``b``, a name that both have where the lot is one of the parcel's districts. Lots also stand under ``ALL``,
    where parcels without a limit look: those without a district, or without an area for it. By name, or by ``areas`` (admin_id, name, geom)
    that lots (geom) meet."""
    named = parcels.withColumn("a", F.coalesce("oaza_name", F.lit("")))
    under_all = lots.withColumn("b", F.lit(ALL))
    if areas is None:
        names = oaza_pairs(parcels, lots).unionByName(F.broadcast(parcels.sparkSession.createDataFrame([("", ALL)], "a string, b string")))
        return named.join(names, "a"), lots.where("oaza_name IS NOT NULL").withColumn("b", F.col("oaza_name")).unionByName(under_all)
    covered = oaza_pairs(parcels, areas.select(F.col("name").alias("oaza_name"))).join(areas.select(F.col("name").alias("b"), "admin_id", "geom"), "b").select("a", "admin_id", "geom")
    inside = spatial.meeting_pairs(lots.select(F.col("lot_id").alias("key"), "geom"), covered.withColumn("admin_id", F.struct("a", "admin_id")))
    inside = inside.select(F.col("key").alias("lot_id"), F.col("admin_id.a").alias("b")).distinct()
    limited = named.join(covered.select("a").distinct().withColumn("b", F.col("a")), "a", "left").withColumn("b", F.coalesce("b", F.lit(ALL)))
    return limited, lots.join(inside, "lot_id").unionByName(under_all)


def _text(c: str) -> Column:
    return F.coalesce(c, F.lit("")).alias(c)


#: What a parcel's matches hang on, but for its map and id.
KIND = ("oaza_name", "municipality_name", "p_parent", "p_branch")


def _looks(parcels: DataFrame, lots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(municipality_name, look) and (lot_municipality, look) of the distinct names: a lot and a parcel fit by ``municipality_fits`` where they have a look in common, and then just one. A name
    looks for lots that it contains, and for those without a name; a parcel without one for all. Containment is looked up by grams, not by comparing all names with all."""
    from parcelworks.operators.search import texts_in_numbers

    names = written(parcels.select(_text("municipality_name")).distinct(), "map-names")
    asked = written(lots.select(F.coalesce("municipality_name", F.lit("")).alias("lot_municipality")).distinct(), "lot-names")
    held = texts_in_numbers(names.select(F.col("municipality_name").alias("number")), asked.select(F.col("lot_municipality").alias("text")))
    held = written(held.select(F.col("number").alias("municipality_name"), F.col("text").alias("lot_municipality"), F.concat(F.lit("="), "number").alias("look")), "fitting-names")
    free, unnamed = asked.where("lot_municipality = ''").withColumn("look", F.lit("")), names.where("municipality_name = ''").withColumn("look", F.lit(ALL))
    ours = held.select("municipality_name", "look").distinct().union(names.where("municipality_name <> ''").crossJoin(free.select("look"))).union(unnamed)
    theirs = held.select("lot_municipality", "look").union(free).union(asked.crossJoin(unnamed.select("look")))
    return written(ours, "looks-of-maps"), written(theirs, "looks-of-lots")


def _looking_lots(names: DataFrame, lots: DataFrame, areas: DataFrame | None, looks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(oaza_name, b) of the parcels' distinct districts ``names``, and (lot_id, b, look, q_parent, q_branch) of the lots."""
    named, q = _sides(written(names, "names-of-districts"), lot_numbers(lots), areas)
    q = q.select("lot_id", "b", F.coalesce("municipality_name", F.lit("")).alias("lot_municipality"), F.col("parent_no").alias("q_parent"), F.col("branch_no").alias("q_branch"))
    return written(named.select("oaza_name", "b"), "districts"), q.join(looks, "lot_municipality").drop("lot_municipality")


def _stored_numbers(parcels: DataFrame, levels, *columns: Column) -> DataFrame:
    """Parcels that have a parent, with ``columns``, their numbers and ``_meeting_key``, written: as columns of a join, numbers would be parsed again in each filter, key and level that asks for them."""
    rows = parcels.select("xml_meta_id", "fude_id", "chiban", *columns, parent_of(F.col("chiban")).alias("p_parent"), branch_of(F.col("chiban")).alias("p_branch"))
    rows = rows.withColumn("key", _meeting_key(F.col("p_parent"), F.col("p_branch"), levels))
    return written(rows, "numbered-parcels").where("p_parent <> ''")


def _once_and_more(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parcels of which there is but one row, and the rows of the others, whose results must be compared for repeats. They are told apart by hashes of map and id, so that
    whole rows need not be shuffled for it; parcels of one hash count among the others. ``rows`` are read three times."""
    hashed = rows.withColumn("__h", F.xxhash64("xml_meta_id", "fude_id"))
    again = written(hashed.groupBy("__h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__h"), "repeated-parcels")
    return hashed.join(again, "__h", "left_anti").drop("__h"), hashed.join(again, "__h", "left_semi").drop("__h")


#: Lots that a row of ``_lots_of_numbers`` has, about, at most.
LOTS = 10_000


def _lots_of_numbers(q: DataFrame, number: list[str]) -> DataFrame:
    """(the columns ``number``, lots): distinct lot_ids that have them in common, written. Those of a number with many lots are dealt over several rows."""
    kind = dict(q.dtypes)["lot_id"]
    many = written(q.groupBy(*number).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LOTS), "numbers-of-many-lots")
    rows = q.join(many, number, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64("lot_id"), F.ceil(F.col("n") / LOTS)), F.lit(0)))
    none = F.when(F.count_if(F.col("lot_id").isNull()) > 0, F.array(F.lit(None).cast(kind))).otherwise(F.array().cast(f"array<{kind}>"))
    sets = rows.groupBy(*number, "__part").agg(F.concat(F.collect_set("lot_id"), none).alias("lots")).drop("__part")
    return written(dealt(sets), "lots-of-numbers")


def number_matches(parcels: DataFrame, lots: DataFrame, levels=LEVELS, digits_only: bool = False, areas: DataFrame | None = None) -> DataFrame:
    """(xml_meta_id, fude_id, chiban, lot_id, level). Parcels: xml_meta_id, fude_id, oaza_name, chiban,
    municipality_name; a parcel without a district meets all lots, also those without one, a parcel without a parent none.
    ``areas`` limits lots by geometry instead of by name; ``digits_only`` lets only numbers of digits be near.

    Equi-join on (district, municipality, key of the widest level): a parcel is one row, and lots stand under every district and municipality that looks for them, so that what meets but
    does not match is rare. Parcels whose key no lot has go first. Lots of one number are one row, so that a parcel is compared with a number and not with each of its lots, and these rows are dealt over all tasks, since a small table of them may have most of the pairs; two numbers are near if they meet under the first key of the lot, its own. Pairs are compared for repeats only where a parcel stands in several districts. The near
    key of one-character parents is hot: AQE splits it, but its pairs grow with the square of a district."""
    numbered = _stored_numbers(parcels, levels, _text("oaza_name"), _text("municipality_name"))
    ours, theirs = _looks(numbered, lots)
    named, q = _looking_lots(numbered.select("oaza_name").distinct(), lots, areas, theirs)
    digits = lambda c: F.col(c).rlike(r"^\p{Nd}+$") if digits_only else F.lit(True)
    own_first = F.posexplode_outer(_lot_keys(F.col("q_parent"), F.col("q_branch"), levels)).alias("place", "key")
    q = q.select("lot_id", "b", "look", "q_parent", joined_number(F.col("q_parent"), F.col("q_branch")).alias("q_joined"), digits("q_parent").alias("q_digits"), own_first)
    q = _lots_of_numbers(written(dealt(q, "lot_id"), "keys-of-lots").join(named, "b"), ["oaza_name", "look", "key", "place", "q_parent", "q_joined", "q_digits"])
    p = numbered.select("*", joined_number(F.col("p_parent"), F.col("p_branch")).alias("p_joined"), digits("p_parent").alias("p_digits"))
    met_keys = written(q.select("oaza_name", "look", "key").distinct(), "met-keys")
    p = written(p.join(ours, "municipality_name").drop("municipality_name", "p_branch").join(met_keys, ["oaza_name", "look", "key"], "left_semi"), "asking-parcels")

    def met(rows: DataFrame) -> DataFrame:
        found = rows.join(q, ["oaza_name", "look", "key"]).where(_hit(levels, F.col("q_digits") & F.col("p_digits")))
        found = found.select("xml_meta_id", "fude_id", "chiban", _hit_level().alias("level"), "lots")
        return found.select("xml_meta_id", "fude_id", "chiban", F.explode("lots").alias("lot_id"), "level")

    once, more = _once_and_more(p)
    return met(once).unionByName(met(more).distinct())


def best_lots(parcels: DataFrame, lots: DataFrame, levels=LEVELS, areas: DataFrame | None = None) -> DataFrame:
    """``best_matches(number_matches(...))`` without its pairs: of the lots of a key only the one of the smallest id is kept, and those that have the key of the widest level in common form one row, a map as
    large as a district has distinct numbers alike but for the last character of the parent. A parcel so is one row that meets one. A key's level holds for a lot where no better key finds one, so the smallest (level, id) is right. Where a
    level is asked for without those before it, the pairs are needed."""
    if not _nested(levels):
        return best_matches(number_matches(parcels, lots, levels, areas=areas))
    numbered = _stored_numbers(parcels, levels, _text("oaza_name"), _text("municipality_name"))
    ours, theirs = _looks(numbered, lots)
    named, q = _looking_lots(numbered.select("oaza_name").distinct(), lots, areas, theirs)
    keys = _keys(F.col("q_parent"), F.col("q_branch"), levels)
    head = F.element_at(F.split(joined_number(F.col("q_parent"), F.col("q_branch")), "-", 2), 1)
    meets = [_meeting_key(head, F.lit(""), levels) if n == 0 and len(set(levels)) > 1 else F.element_at(keys, -1) for n in range(len(set(levels)))]
    q = q.select("lot_id", "b", "look", F.explode(F.arrays_zip(keys.alias("key"), F.array(*meets).alias("meet"))).alias("k")).select("lot_id", "b", "look", "k.*")
    least = q.groupBy("b", "look", "meet", "key").agg(F.min("lot_id").alias("lot_id")).join(named, "b").groupBy("oaza_name", "look", "meet", "key").agg(F.min("lot_id").alias("lot_id"))
    least = least.withColumn("m", F.struct(_place(F.col("key")).alias("p"), "lot_id"))
    least = least.groupBy("oaza_name", "look", "meet").agg(F.map_from_entries(F.collect_list(F.struct("key", "m"))).alias("least"))

    def met(rows: DataFrame) -> DataFrame:
        p = rows.withColumnRenamed("key", "meet").join(least, ["oaza_name", "look", "meet"])
        found = F.coalesce(*[F.try_element_at("least", k) for k in _key_list(F.col("p_parent"), F.col("p_branch"), levels)])
        return p.select("xml_meta_id", "fude_id", "chiban", found.alias("m")).where("m IS NOT NULL")

    once, more = _once_and_more(numbered.join(ours, "municipality_name").drop("municipality_name"))
    found = met(once).unionByName(met(more).groupBy("xml_meta_id", "fude_id", "chiban").agg(F.min("m").alias("m")))
    return found.select("xml_meta_id", "fude_id", "chiban", "m.lot_id", F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("m.p") + 1).alias("level"))


def _place(key: Column) -> Column:
    """``priority`` of the level of a key."""
    kind = F.substring(key, 1, 1)
    return F.when(kind == "=", 0).when(kind == "^", 1).otherwise(2)


def best_matches(matches: DataFrame) -> DataFrame:
    """The best lot of each parcel: smallest priority, then lot id; partial aggregates, no window."""
    least = F.min(F.struct(priority(F.col("level")).alias("p"), "lot_id", "level"))
    return matches.groupBy("xml_meta_id", "fude_id", "chiban").agg(least.alias("m")).select("xml_meta_id", "fude_id", "chiban", F.col("m.lot_id").alias("lot_id"), F.col("m.level").alias("level"))


def _shown(pivot: Column, level: Column, near: bool) -> Column:
    """The level at which a match of a pivot is shown, or null: an exact pivot shows all levels (near ones only if ``near``), a parent pivot
    exact matches, as parent ones, a near pivot nothing."""
    return F.when(pivot == "exact", F.when((level != "near") | F.lit(near), level)).when((pivot == "parent") & (level == "exact"), "parent")


def mutual_matches(best: DataFrame, parcels: DataFrame, lots: DataFrame, near: bool = False) -> DataFrame:
    """(xml_meta_id, lot_id, fude_id, chiban, level): parcels of the same map that match the best lot of a parcel.

    A parcel and a pivot meet under one key and show one level, so pairs are compared for repeats only where a parcel, or a lot with other numbers, is there more than once."""
    levels = LEVELS if near else ("exact", "parent")
    q = written(lot_numbers(lots).select("lot_id", F.col("parent_no").alias("q_parent"), F.col("branch_no").alias("q_branch")).distinct(), "numbers-of-lots")
    several = written(q.groupBy("lot_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("lot_id"), "lots-of-several-numbers")
    keyed = q.select("lot_id", "q_parent", joined_number(F.col("q_parent"), F.col("q_branch")).alias("q_joined"), F.posexplode(_lot_keys(F.col("q_parent"), F.col("q_branch"), levels)).alias("place", "key"))
    pivots = best.where("level <> 'near'").select("xml_meta_id", "lot_id", F.col("level").alias("pivot")).repartition("lot_id").distinct()
    pivots = written(pivots.join(keyed, "lot_id"), "keys-of-pivots")
    p = _stored_numbers(parcels, levels).withColumn("p_joined", joined_number(F.col("p_parent"), F.col("p_branch"))).drop("p_branch")

    def met(rows: DataFrame, asked: DataFrame) -> DataFrame:
        found = rows.join(asked, ["xml_meta_id", "key"]).where(_hit(levels)).withColumn("level", _shown(F.col("pivot"), _hit_level(), near)).where("level IS NOT NULL")
        return found.select("xml_meta_id", "lot_id", "fude_id", "chiban", "level")

    once, more = _once_and_more(p)
    if several.isEmpty():
        return met(once, pivots).unionByName(met(more, pivots).distinct())
    lone, other = pivots.join(several, "lot_id", "left_anti"), pivots.join(several, "lot_id", "left_semi")
    return met(once, lone).unionByName(met(more, lone).unionByName(met(p, other)).distinct())


def mutual_lots(best: DataFrame, parcels: DataFrame, lots: DataFrame, near: bool = False, areas: DataFrame | None = None) -> DataFrame:
    """(lot_id, xml_meta_id, fude_id, other_lot_id, level): the other way round, lots that match the best parcel of a lot (``best``: lot_id,
    xml_meta_id, fude_id, level), within its district and municipality."""
    pivots = best.where("level <> 'near'").select("lot_id", "xml_meta_id", "fude_id", F.col("level").alias("pivot"))
    chosen = parcels.join(pivots.select("xml_meta_id", "fude_id").distinct(), ["xml_meta_id", "fude_id"], "left_semi")
    found = number_matches(chosen, lots, LEVELS if near else ("exact", "parent"), areas=areas).withColumnRenamed("lot_id", "other_lot_id")
    met = pivots.join(found, ["xml_meta_id", "fude_id"]).withColumn("level", _shown(F.col("pivot"), F.col("level"), near)).where("level IS NOT NULL")
    return met.select("lot_id", "xml_meta_id", "fude_id", "other_lot_id", "level").distinct()


def matches_in_maps(chosen: DataFrame, lots: DataFrame, parcels: DataFrame, levels=LEVELS) -> DataFrame:
    """(lot_id, xml_meta_id, fude_id, chiban, level, other_map): parcels that match each lot in its chosen map, whatever their district;
    where there is none, in the one of the other maps with a parcel of the selected district that has the best level (the smallest id on
    ties). ``chosen``: lot_id, xml_meta_id, oaza_name (the selected district). Lots without a parent match nothing.

    Parcels of maps that are not asked go first, and a parcel is one row, under the key of the widest level. Lots without a match in their map, which so holds none of their keys, are not spread over the
    district's maps: of a district and number, then of a district and key, the smallest map is kept, and only the best one is asked."""
    q = lot_numbers(lots).select("lot_id", F.col("parent_no").alias("q_parent"), F.col("branch_no").alias("q_branch")).where("q_parent <> ''").join(chosen.select("lot_id", "xml_meta_id", "oaza_name"), "lot_id")
    q = written(dealt(q.distinct(), "lot_id"), "asking-lots")

    def met(rows: DataFrame, maps: DataFrame) -> DataFrame:
        p = written(parcels.select("xml_meta_id", "fude_id", "chiban").join(written(maps.distinct(), "asked-maps"), "xml_meta_id", "left_semi"), "parcels-of-asked-maps")
        p = _numbered(p.distinct()).select("xml_meta_id", "fude_id", "chiban", "p_parent", joined_number(F.col("p_parent"), F.col("p_branch")).alias("p_joined"), _meeting_key(F.col("p_parent"), F.col("p_branch"), levels).alias("key"))
        keyed = rows.select("lot_id", "xml_meta_id", "q_parent", joined_number(F.col("q_parent"), F.col("q_branch")).alias("q_joined"), F.posexplode(_lot_keys(F.col("q_parent"), F.col("q_branch"), levels)).alias("place", "key"))
        found = keyed.join(p, ["xml_meta_id", "key"]).where(_hit(levels))
        return found.select("lot_id", "xml_meta_id", "fude_id", "chiban", _hit_level().alias("level"))

    here = written(met(q, q.select("xml_meta_id")), "matches-in-chosen-maps").withColumn("other_map", F.lit(False))
    rest = written(q.join(here.select("lot_id").distinct(), "lot_id", "left_anti"), "lots-without-a-match")
    maps = parcels.where("oaza_name <> ''").select("oaza_name", "xml_meta_id").join(rest.select("oaza_name").distinct(), "oaza_name", "left_semi")
    maps = written(maps.distinct(), "maps-of-districts")
    if not _nested(levels):
        asked = rest.withColumnRenamed("xml_meta_id", "own").join(maps, "oaza_name").where("own <> xml_meta_id").select("lot_id", "q_parent", "q_branch", "xml_meta_id")
        every = written(met(asked, maps.select("xml_meta_id")), "matches-in-other-maps")
        best = every.groupBy("lot_id").agg(F.min(F.struct(priority(F.col("level")).alias("p"), "xml_meta_id")).alias("m")).select("lot_id", "m.xml_meta_id")
        return here.unionByName(every.join(best, ["lot_id", "xml_meta_id"]).select("lot_id", "xml_meta_id", "fude_id", "chiban", "level", F.lit(True).alias("other_map")))
    asked = written(rest.withColumn("key", F.explode(_keys(F.col("q_parent"), F.col("q_branch"), levels))).select("lot_id", "q_parent", "q_branch", "oaza_name", "key"), "asked-keys")
    held = written(parcels.select("xml_meta_id", "chiban").join(maps, "xml_meta_id").groupBy("oaza_name", "chiban").agg(F.min("xml_meta_id").alias("xml_meta_id")), "numbers-of-districts")
    held = _numbered(held).select("oaza_name", "xml_meta_id", F.explode(_keys(F.col("p_parent"), F.col("p_branch"), levels)).alias("key")).groupBy("oaza_name", "key").agg(F.min("xml_meta_id").alias("other"))
    best = asked.join(held, ["oaza_name", "key"]).groupBy("lot_id", "q_parent", "q_branch").agg(F.min(F.struct(_place(F.col("key")).alias("p"), "other")).alias("m"))
    best = written(best.select("lot_id", "q_parent", "q_branch", F.col("m.other").alias("xml_meta_id")), "lots-in-other-maps")
    return here.unionByName(met(best, best.select("xml_meta_id")).withColumn("other_map", F.lit(True)))


def _suffixes(text: Column) -> Column:
    """All ends of a text, itself and the empty one included."""
    return F.transform(F.sequence(F.lit(0), F.length(text)), lambda n: F.substring(text, n + 1, F.length(text)))


def municipality_matches(names: DataFrame, references: DataFrame) -> DataFrame:
    """(name, ref) of (name) and (ref, ord): the reference of the same name, else the first by ``ord`` that equals the normalized name or
    of which one ends with the other. The shorter one is an end of the longer, so both are joined by ends, and by the whole name."""
    keyed = names.select("name", normalize_municipality(F.col("name")).alias("key"))
    refs = references.select("ref", "ord")
    found = keyed.select("name", F.explode(_suffixes(F.col("key"))).alias("ref")).join(refs, "ref")
    found = found.unionByName(refs.select("ref", "ord", F.explode(_suffixes(F.col("ref"))).alias("key")).join(keyed, "key").select("name", "ref", "ord"))
    found = found.unionByName(keyed.join(refs, keyed["name"] == refs["ref"]).select("name", "ref", "ord"))
    best = F.min(F.struct((F.col("name") != F.col("ref")).alias("other"), "ord", "ref"))
    return found.groupBy("name").agg(best.alias("m")).select("name", "m.ref")


def lots_of_municipalities(names: DataFrame, lots: DataFrame) -> DataFrame:
    """(municipality_name, n): the lots (municipality_name) that fit each of the distinct ``names`` by ``municipality_fits``: those whose name it contains, or have none; all of them if it is empty. Containment
    is looked up by grams, not by comparing all names with all."""
    from parcelworks.operators.search import texts_in_numbers

    counts = lots.groupBy(F.coalesce("municipality_name", F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("k"))
    asked = names.select("municipality_name", F.coalesce("municipality_name", F.lit("")).alias("number"))
    held = texts_in_numbers(asked.select("number").distinct(), counts.select("text")).join(counts, "text").groupBy("number").agg(F.sum("k").alias("held"))
    sums = counts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("text") == "", F.col("k"))), F.lit(0)).alias("free")).withColumn("one", F.lit(1))
    told = asked.join(held, "number", "left").withColumn("one", F.lit(1)).join(sums, "one")
    return told.select("municipality_name", F.when(F.col("number") == "", F.col("all")).otherwise(F.col("free") + F.coalesce("held", F.lit(0))).alias("n"))


def export_names(parcels: DataFrame, clicked: DataFrame | None = None) -> DataFrame:
    """(xml_meta_id, oaza_name, export_name): the youngest number of each set names it; a set of parcels without numbers is named by its
    district alone; ``clicked`` (xml_meta_id, oaza_name, chiban) names the sets that it holds by their number as it is."""
    fixed = lambda size, digits: F.struct(F.lit(size).alias("size"), F.lit(digits).alias("digits"))
    number = lambda c, other: F.when(F.col(c).rlike(r"^[0-9]+$"), whole_number(F.col(c))).otherwise(other)
    rows = parcels.select("xml_meta_id", "oaza_name", "chiban", parent_of(F.col("chiban")).alias("parent"), branch_of(F.col("chiban")).alias("branch"))
    young = F.struct(number("parent", fixed(6, "999999")).alias("p"), number("branch", fixed(0, "")).alias("b"), F.col("chiban").alias("c"), "parent", "branch")
    rows = rows.select("xml_meta_id", "oaza_name", "chiban", F.when(F.col("chiban").isNotNull(), young).alias("young"))
    sets = rows.groupBy("xml_meta_id", "oaza_name").agg(F.min("young").alias("y"), F.count("chiban").alias("n"))
    many = F.concat("oaza_name", F.lit("_"), joined_number(F.col("y.parent"), F.col("y.branch")), F.lit("他"))
    name = F.when(F.col("n") == 0, F.col("oaza_name")).when(F.col("n") == 1, F.concat("oaza_name", F.lit("_"), F.col("y.c"))).otherwise(many)
    if clicked is None:
        return sets.select("xml_meta_id", "oaza_name", name.alias("export_name"))
    own = clicked.select("xml_meta_id", "oaza_name", F.concat("oaza_name", F.lit("_"), "chiban").alias("__own"))
    return sets.join(own, ["xml_meta_id", "oaza_name"], "left").select("xml_meta_id", "oaza_name", F.coalesce("__own", name).alias("export_name"))


def first_wins(rows: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row for each key, the first in ``order``, or the last."""
    turn = (lambda c: c.desc_nulls_last()) if last else (lambda c: c.asc_nulls_first())
    at = Window.partitionBy(*keys).orderBy(*[turn(F.col(c)) for c in order])
    return rows.withColumn("__n", F.row_number().over(at)).where("__n = 1").drop("__n")


def export_rows(parcels: DataFrame, matches: DataFrame) -> DataFrame:
    """The matched parcels of maps that have matches, all parcels of the others."""
    hits = matches.select("xml_meta_id", "fude_id").distinct()
    return parcels.join(hits, ["xml_meta_id", "fude_id"], "left_semi").unionByName(parcels.join(hits.select("xml_meta_id").distinct(), "xml_meta_id", "left_anti").select(parcels.columns))


def export_table(parcels: DataFrame, meta: DataFrame, matches: DataFrame) -> DataFrame:
    """(xml_meta_id, fude_id, oaza_name, chiban, est_area, scale, geom) of ``export_rows``, for maps on the ground only: maps of arbitrary coordinates are refused.
    Parcels: coord_type, area_sqm, geom; meta: id, crs_type, scale_denominator, map_name."""
    maps = meta.where(~is_arbitrary(F.col("crs_type"))).select(F.col("id").alias("xml_meta_id"), effective_scale(F.col("scale_denominator"), F.col("map_name")).alias("scale"))
    rows = export_rows(parcels, matches).join(maps, "xml_meta_id")
    return rows.select("xml_meta_id", "fude_id", "oaza_name", "chiban", estimated_area(F.col("area_sqm"), F.col("coord_type"), F.col("scale")).alias("est_area"), "scale", "geom")


def best_maps(parcels: DataFrame, lots: DataFrame, levels=LEVELS) -> DataFrame:
    """(lot_id, xml_meta_id, fude_id, level): for each lot the map and parcel of the best level, then of the smallest ids, within its district.
    Of the parcels of one district, municipality and number, then of a key, only the one of the smallest ids is kept before they meet the lots, unless a level is asked for
    without those before it."""
    if not _nested(levels):
        least = F.min(F.struct(priority(F.col("level")).alias("p"), "xml_meta_id", "fude_id", "level")).alias("m")
        return number_matches(parcels, lots, levels).groupBy("lot_id").agg(least).select("lot_id", "m.xml_meta_id", "m.fude_id", "m.level")
    rows = _numbered(parcels).select(_text("oaza_name"), _text("municipality_name"), "p_parent", "p_branch", F.struct("xml_meta_id", "fude_id").alias("m"))
    kinds = written(rows.groupBy(*KIND).agg(F.min("m").alias("m")), "kinds")
    ours, theirs = _looks(kinds, lots)
    named, q = _looking_lots(kinds.select("oaza_name").distinct(), lots, None, theirs)
    keyed = kinds.select("oaza_name", "municipality_name", "m", F.explode(_keys(F.col("p_parent"), F.col("p_branch"), levels)).alias("key"))
    keyed = keyed.groupBy("oaza_name", "municipality_name", "key").agg(F.min("m").alias("m"))
    least = keyed.join(ours, "municipality_name").join(named, "oaza_name").groupBy("b", "look", "key").agg(F.min("m").alias("m"))
    met = q.withColumn("key", F.explode(_keys(F.col("q_parent"), F.col("q_branch"), levels))).join(least, ["b", "look", "key"])
    best = met.groupBy("lot_id").agg(F.min(F.struct(_place(F.col("key")).alias("p"), "m")).alias("r"))
    return best.select("lot_id", "r.m.xml_meta_id", "r.m.fude_id", F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("r.p") + 1).alias("level"))
