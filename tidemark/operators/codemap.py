"""A map of modules: document frequencies, homes of terms, and scores of modules for words and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.session import settle, shuffle_width

#: Points of a match, by where it is: folder segment, in a folder, file name, in a file name, description.
SEGMENT, FOLDER, NAME, IN_NAME, DESCRIPTION = 5, 2, 5, 3, 2
#: Certainty of a match by stem; letters that a word has at least for it.
STEM_CERTAINTY, STEM_LEAST = 0.6, 6
HOMES = 3
#: Rows of queries and modules that one task adds up at most, about.
PARTITION_ROWS = 1_000_000
#: Rows of words and modules that are broadcast at most.
BROADCAST_ROWS = 4_000_000


def parts(modules: DataFrame) -> DataFrame:
    """path, folder, name and description of modules, folded, with the length of the name."""
    name = F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"\.[^.]*$", "")
    return modules.select("path", tx.fold(F.regexp_extract("path", "^(.*)/[^/]+$", 1)).alias("folder"), tx.fold(name).alias("name"), tx.fold(F.col("description")).alias("about"))


def field_score(word: Column) -> Column:
    """How well a word matches a module; 0 if it doesn't. Longer shares of the name count a little more."""
    folder = F.when(F.array_contains(F.split("folder", "/"), word), SEGMENT).when(F.contains(F.col("folder"), word), FOLDER).otherwise(0)
    name = F.when(F.col("name") == word, NAME).when(F.contains(F.col("name"), word), IN_NAME).otherwise(0)
    where = folder + name + F.when(F.contains(F.col("about"), word), DESCRIPTION).otherwise(0)
    return F.when(where > 0, where + F.length(word) / (F.length("name") + 1)).otherwise(0.0)


def _hits(modules: DataFrame, wanted: DataFrame) -> DataFrame:
    """word, path, score of all modules that a word matches in the form that is wanted.

    A word matches inside of names and descriptions, so the join is by the distinct tokens that hold it: tokens are taken apart into their
    substrings as long as a wanted word, and met by equality; no module is held against every word.
    """
    tokens = modules.select("path", F.explode(F.array_distinct(F.concat(F.split("folder", "[^a-z0-9]+"), F.split("name", "[^a-z0-9]+"), F.split("about", "[^a-z0-9]+")))).alias("token")).where("token != ''")
    longest = wanted.agg(F.coalesce(F.max(F.length("form")), F.lit(3)).alias("longest"))
    pieces = tokens.select("token").distinct().join(longest).where("length(token) >= 3")
    starts = pieces.select("token", "longest", F.explode(F.expr("sequence(1, length(token) - 2)")).alias("at"))
    inside = starts.select("token", F.explode(F.expr("transform(sequence(3, greatest(3, least(longest, length(token) - at + 1))), n -> substring(token, at, n))")).alias("form")).distinct()
    matched = inside.join(wanted, "form").select("word", "form", "token").join(tokens, "token").select("word", "form", "path").distinct()
    return matched.join(modules, "path").withColumn("score", field_score(F.col("form"))).where("score > 0").select("word", "pid", "path", "score")


def find(modules: DataFrame, queries: DataFrame, query_col: str = "q", k: int | None = None) -> DataFrame:
    """query, path, score for queries of several words: the sum of scores weighed by rarity, times the weight of the words matched.

    Words have at least 3 letters or digits; one that matches more than a third of all modules is dropped; one that matches none is looked up by its stem.
    What a word contributes to a module is computed once, however many queries share the word; queries only add up. With k, only the k best of each query.
    """
    # Numbers stand for modules, in the order of their paths, and for sets of words while rows are many; texts come back at the end.
    known = settle(parts(modules).orderBy("path").withColumn("pid", F.monotonically_increasing_id()))
    n = known.agg(F.count("*").alias("n_modules"))
    words = settle(queries.where(F.col(query_col).isNotNull()).select(F.col(query_col).alias("query")).distinct().select("query", F.explode(F.array_distinct(F.regexp_extract_all(tx.fold(F.col("query")), F.lit("([a-z0-9]{3,})"), F.lit(1)))).alias("word")))
    vocabulary = words.select("word").distinct()
    exact = settle(_hits(known, vocabulary.withColumn("form", F.col("word"))).withColumn("certainty", F.lit(1.0)))
    missed = vocabulary.join(exact.select("word").distinct(), "word", "left_anti").where(F.length("word") >= STEM_LEAST)
    stemmed = _hits(known, missed.withColumn("form", tx.stem(F.col("word")))).withColumn("certainty", F.lit(STEM_CERTAINTY))
    both = settle(exact.unionByName(stemmed))
    rarity = both.groupBy("word").agg(F.count("*").alias("hits"), F.first("certainty").alias("certainty")).join(F.broadcast(n)).where("hits <= n_modules / 3").select("word", "hits", (F.log(F.col("n_modules") / F.col("hits")) * F.col("certainty")).alias("weight"))
    rarity = settle(rarity.withColumn("wid", F.monotonically_increasing_id()))
    weighted = settle(both.join(rarity, "word").select("wid", "pid", "weight", (F.col("score") * F.col("weight")).alias("part")))
    # Queries of the same words that count have the same answer.
    asked = settle(words.join(rarity, "word").groupBy("query").agg(F.sort_array(F.collect_list("wid")).alias("wids"), F.sum("hits").alias("hits")))
    sets = settle(asked.groupBy("wids").agg(F.first("hits").alias("hits")).withColumn("sid", F.monotonically_increasing_id()))
    rows = sets.agg(F.coalesce(F.sum("hits"), F.lit(0))).first()[0]
    apart = sets.repartition(shuffle_width(sets.sparkSession, rows, PARTITION_ROWS), "sid").select("sid", F.explode("wids").alias("wid"))
    # Broadcast while it is small: the rows of a set then stay in their task until its best are known.
    met = F.broadcast(weighted) if weighted.count() <= BROADCAST_ROWS else weighted
    scored = apart.join(met, "wid").groupBy("sid", "pid").agg((F.sum("part") * F.sum("weight")).alias("score"))
    if k:
        order = Window.partitionBy("sid").orderBy(F.col("near").desc(), "pid")
        scored = scored.withColumn("near", F.round("score", 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return scored.join(sets, "sid").join(asked.select("query", "wids"), "wids").join(known.select("pid", "path"), "pid").select("query", "path", "score")


def best(found: DataFrame, k: int = 12) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.round(F.col("score"), 6).desc(), "path")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "path", F.round("score", 4).alias("score"))


def homes(words: DataFrame, least: int = 2) -> DataFrame:
    """term, file, n, home of the files that use a term most (at least so often), at most HOMES; of equal ones the smaller file."""
    counts = words.groupBy("term", "file").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    order = Window.partitionBy("term").orderBy(F.col("n").desc(), "file")
    return counts.withColumn("home", F.row_number().over(order)).where(F.col("home") <= HOMES)
