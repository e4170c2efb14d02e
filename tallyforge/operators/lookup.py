"""Longest-prefix joins: the nearest configuration above a path, and the longest alias that a module's name begins with.

Both explode a key into the few prefixes that can match, join on equality and keep the best match by aggregation, so the
plan is the same for any number of configurations and aliases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import paths as P

ALIASES = "place string, pattern string, places array<string>"


def folder_of(path: Column | str) -> Column:
    """The folder of a path, the empty text at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def folders_above(folder: Column | str) -> Column:
    """The folder and all above it, down to the root (the empty text) at position 0."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def nearest_places(paths: DataFrame, configs: DataFrame) -> DataFrame:
    """paths (path), configs (place) -> (path, place): the configuration in a path's folder or the next above that has one.

    Of several in one folder the first by rank and name counts. A path without any has none (null).
    """
    best = configs.groupBy(folder_of("place").alias("above")).agg(F.min(F.struct(P.config_rank("place").alias("rank"), "place")).alias("best"))
    folders = paths.select(folder_of("path").alias("folder")).distinct()
    steps = folders.select("folder", F.posexplode(folders_above("folder")).alias("depth", "above"))
    found = steps.join(best, "above").groupBy("folder").agg(F.max_by("best.place", "depth").alias("place"))
    return paths.select("path", folder_of("path").alias("folder")).join(found, "folder", "left").select("path", "place")


def alias_heads(aliases: DataFrame) -> DataFrame:
    """ALIASES -> (place, pattern, head, tail, star, places): the parts of a pattern before and after its *.

    A pattern without * that ends in / stands for all that begins with it.
    """
    folder = ~F.col("pattern").contains("*") & F.col("pattern").endswith("/")
    full = F.when(folder, F.concat("pattern", F.lit("*"))).otherwise(F.col("pattern"))
    places = F.when(folder, F.transform("places", lambda p: F.concat(F.regexp_replace(p, "/+$", ""), F.lit("/*")))).otherwise(F.col("places"))
    at = F.instr(full, "*")
    head = F.when(at > 0, F.substring(full, F.lit(1), at - 1)).otherwise(full)
    tail = F.when(at > 0, F.substring(full, at + 1, F.length(full))).otherwise(F.lit(""))
    return aliases.select("place", "pattern", head.alias("head"), tail.alias("tail"), (at > 0).alias("star"), places.alias("places"))


def matched_aliases(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names (place, specifier), aliases (ALIASES) -> (place, specifier, pattern, bases): the paths that the best alias gives.

    The longest beginning goes first, then the pattern in order of letters. Names that no alias matches have no row.
    """
    heads = alias_heads(aliases)
    lengths = heads.groupBy("place").agg(F.collect_set(F.length("head")).alias("lengths"))  # at most as many as a pattern has letters
    tries = names.select("place", "specifier").distinct().join(lengths, "place")
    tries = tries.select("place", "specifier", F.explode(F.filter("lengths", lambda n: n <= F.length("specifier"))).alias("n"))
    tries = tries.withColumn("head", F.substring(F.col("specifier"), F.lit(1), F.col("n")))
    j = tries.join(heads, ["place", "head"])
    fits = F.when(F.col("star"), F.col("specifier").endswith(F.col("tail")) & (F.length("specifier") >= F.col("n") + F.length("tail"))).otherwise(F.col("specifier") == F.col("head"))
    inner = F.when(F.col("star"), F.substring(F.col("specifier"), F.col("n") + 1, F.length("specifier") - F.col("n") - F.length("tail"))).otherwise(F.lit(""))
    put = F.transform("places", lambda p: F.regexp_replace(F.when(F.instr(p, "*") > 0, F.concat(F.substring_index(p, "*", 1), inner, F.substring(p, F.instr(p, "*") + 1, F.length(p)))).otherwise(p), r"^\./", ""))
    best = j.filter(fits).select("place", "specifier", F.struct((-F.col("n")).alias("order"), "pattern", put.alias("bases")).alias("hit"))
    best = best.groupBy("place", "specifier").agg(F.min_by("hit", F.struct("hit.order", "hit.pattern")).alias("hit"))
    return best.select("place", "specifier", "hit.pattern", "hit.bases")
