"""Rosters, metadata, match catalogue, player lookup and profile tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .tracking import match_id_of

TINY_BYTES = 4096


def _plain_letters() -> dict[str, str]:
    """Lower-case Latin letters with a plain compatibility form, and that form."""
    out = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if plain and chr(code) == chr(code).lower():
            out[chr(code)] = plain.lower()
    return out


LETTERS = _plain_letters()

def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``(match_id, home_team_id)`` from objects or one-element arrays."""
    d = spark.read.schema(schemas.METADATA).option("multiLine", True).json(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*?)(?:_metadata)?\.json$", 1)
    return d.select(name.alias("match_id"), F.col("homeTeam.id").alias("home_team_id"))


def parse_metadata(lines: DataFrame, text: str = "value") -> DataFrame:
    """``(match_id, home_team_id)`` from JSON text, object or one-element array."""
    return lines.select("match_id", F.get(F.from_json(text, schemas.METADATA_LIST), 0)["homeTeam"]["id"].alias("home_team_id"))


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """Roster records from plain lists or from objects with ``players`` or ``roster``."""
    d = spark.read.schema(schemas.ROSTER).option("multiLine", True).json(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*?)(?:_roster)?\.json$", 1)
    return roster_rows(d.withColumn("match_id", name))


def roster_rows(d: DataFrame) -> DataFrame:
    own = F.array(F.struct("player", "team", "positionGroupType", "shirtNumber"))
    many = F.when(F.size("players") > 0, F.col("players")).when(F.size("roster") > 0, F.col("roster")).otherwise(own)
    return d.select("match_id", F.inline(many)).where(F.col("player.id").isNotNull())


def outfield_roster(roster: DataFrame, metadata: DataFrame) -> DataFrame:
    """Outfield players with id, nickname, team, shirt, position code and home/away side."""
    code = F.upper(F.coalesce("positionGroupType", F.lit("")))
    d = roster.join(metadata, "match_id").where((code != "") & (code != "GK"))
    return d.select(
        "match_id", F.col("player.id").try_cast("bigint").alias("player_id"), F.coalesce("player.nickname", "player.name").alias("nickname"),
        F.col("team.id").try_cast("bigint").alias("team_id"), F.col("shirtNumber").alias("shirt"), code.alias("position"),
        F.when(F.col("team.id") == F.col("home_team_id"), "home").otherwise("away").alias("side"),
    )


def fold(c: Column) -> Column:
    """Lower case with accents removed; other non-ASCII letters are dropped."""
    single = {a: p for a, p in LETTERS.items() if len(p) == 1}
    plain = F.translate(F.lower(c), "".join(single), "".join(single.values()))
    for a, p in LETTERS.items():
        if len(p) > 1:
            plain = F.replace(plain, F.lit(a), F.lit(p))
    return F.regexp_replace(plain, r"[^\x00-\x7F]", "")


def resolve_players(needles: DataFrame, roster: DataFrame, order: str = "player_id") -> DataFrame:
    """First outfield player per (match, needle): an exact id, else a folded substring of the nickname.

    ``needles`` has ``(match_id, needle)``. Ids are an equi-join. Names are folded once per side and meet
    on the needle's rarest gram in its match (three letters, fewer for shorter needles), then by value.
    """
    tag = F.struct(F.col(order).alias("o"), "player_id", "nickname")
    byid = needles.join(roster.withColumn("needle", F.col("player_id").cast("string")), ["match_id", "needle"])
    byid = byid.select("match_id", "needle", F.struct(F.lit(False).alias("byname"), tag.alias("t")).alias("x"))

    def grams(text: str, n):
        places = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.array_distinct(F.transform(places, lambda i: F.substring(F.col(text), i, n)))

    names = roster.select("match_id", fold(F.col("nickname")).alias("name"), tag.alias("t"))
    listed = names.select("match_id", "name", "t", F.explode(F.array_distinct(F.concat(*[grams("name", F.lit(n)) for n in range(4)]))).alias("gram"))
    sought = needles.select("match_id", "needle", fold(F.col("needle")).alias("part")).distinct()
    sought = sought.withColumn("g", grams("part", F.least(F.length("part"), F.lit(3))))
    freq = listed.groupBy("match_id", "gram").agg(F.count("*").alias("n"))
    seen = sought.select("match_id", "needle", "part", F.size("g").alias("all"), F.explode("g").alias("gram")).join(freq, ["match_id", "gram"])
    # a gram that no name has rules the needle out
    rare = seen.groupBy("match_id", "needle", "part", "all").agg(F.count("*").alias("known"), F.min_by("gram", F.struct("n", "gram")).alias("gram")).where(F.col("known") == F.col("all"))
    byname = rare.join(listed, ["match_id", "gram"]).where(F.contains("name", "part"))
    byname = byname.select("match_id", "needle", F.struct(F.lit(True).alias("byname"), F.col("t")).alias("x"))
    best = F.min("x").getField("t").alias("b")
    d = byid.union(byname)
    return d.groupBy("match_id", "needle").agg(best).select("match_id", "needle", "b.player_id", "b.nickname")


def match_catalogue(tracking: DataFrame, roster: DataFrame, metadata: DataFrame) -> DataFrame:
    """Complete (tracking, roster, metadata) triples from three ``(path, length)`` listings.

    Tiny ``.json`` tracking files are left out; the first path per match wins.
    """
    def side(listing: DataFrame, name: str, pattern: str) -> DataFrame:
        mid = F.regexp_extract("path", pattern, 1)
        d = listing.select(mid.alias("match_id"), F.col("path").alias(name)).where(F.col("match_id") != "")
        return d.groupBy("match_id").agg(F.min(name).alias(name))

    tiny = F.lower("path").endswith(".json") & (F.col("length") < TINY_BYTES)
    t = tracking.where(~tiny).select(match_id_of(F.col("path")).alias("match_id"), F.col("path").alias("tracking"))
    t = t.where(F.col("match_id").isNotNull()).groupBy("match_id").agg(F.min("tracking").alias("tracking"))
    r = side(roster, "roster", r"([^/]*?)(?:_roster)?\.json$")
    m = side(metadata, "metadata", r"([^/]*?)(?:_metadata)?\.json$")
    return t.join(r, "match_id").join(m, "match_id")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """File listing only: no content column is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PROFILE).option("header", True).csv(path)


def profile_slice(profiles: DataFrame, level: str, group: str, metric: str) -> DataFrame:
    return profiles.where((F.col("level") == level) & (F.col("group") == group) & (F.col("metric") == metric))
