"""Ranked search and substring lookup by an inverted index.

Every step is an equi-join, so neither terms nor queries have to fit anywhere:

* grams: the distinct pieces of one to three characters of a term's text. What holds a
  word holds the word's rarest piece of three, so one posting list is read for a
  word, and only its members are compared. Words of terms and their beginnings are
  found by this too.
* deletions: each distinct word of the terms with one character left out, and whole.
  Words one edit apart (also by a swap) share such a key.

``build_index`` makes the lists; they can be written and read again, so a vocabulary is
indexed once and asked often.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.text import tokens, within_one_edit, word_score

#: Characters of a piece.
GRAM = 3
#: Parts that all terms are dealt over for queries without a word.
_PARTS = 64
#: Shortest word that is compared by edits.
EDITED = 4


def grams(text: Column, size: int) -> Column:
    """The distinct pieces of ``size`` characters of a text."""
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def deletions(word: Column) -> Column:
    """A word and all it gives with one character left out."""
    without = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.when(F.length(word) > 0, F.array_distinct(F.concat(F.array(word), without))).otherwise(F.array(word))


def postings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (gram, key) of the pieces of one to GRAM characters of each text."""
    every = F.flatten(F.array(*[grams(F.col(text), k) for k in range(1, GRAM + 1)]))
    return texts.select(F.explode(every).alias("gram"), F.col(key).alias("key"))


def holding(lists: DataFrame, needles: DataFrame) -> DataFrame:
    """Rows (needle, key): the members of the shortest posting list of each needle's pieces.

    A text that holds the needle is always among them; texts that only hold the piece are
    too. Empty needles have none.
    """
    pieces = F.when(F.length("needle") >= GRAM, grams(F.col("needle"), GRAM)).otherwise(F.array("needle"))
    wanted = needles.select("needle").distinct().select("needle", F.explode(pieces).alias("gram"))
    held = lists.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    counted = wanted.join(held, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("needle").agg(F.min(F.struct("n", "gram")).alias("least")).where("least.n > 0").select("needle", "least.gram")
    return rarest.join(lists, "gram").select("needle", "key")


def containing(texts: DataFrame, needles: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (needle, and all columns of ``texts``) where the text holds the needle (one character or more)."""
    found = holding(postings(texts, key, text), needles)
    return found.withColumnRenamed("key", key).join(texts, key).where(F.contains(F.col(text), F.col("needle"))).select("needle", *texts.columns)


@dataclass(frozen=True)
class TermIndex:
    """Terms (iri, local, words, hay) with the lists (gram, key), (token, iri) and (deleted, token)."""

    terms: DataFrame
    grams: DataFrame
    tokens: DataFrame
    deletions: DataFrame

    def write(self, path: str) -> None:
        """Writes all lists, each sorted by what it is asked by."""
        self.terms.write.parquet(f"{path}/terms")
        for name, by in (("grams", "gram"), ("tokens", "token"), ("deletions", "deleted")):
            getattr(self, name).repartitionByRange(by).sortWithinPartitions(by).write.parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str) -> TermIndex:
    return TermIndex(*[spark.read.parquet(f"{path}/{name}") for name in ("terms", "grams", "tokens", "deletions")])


def build_index(terms: DataFrame) -> TermIndex:
    """The lists of terms (iri, local, prefix); an IRI is indexed once."""
    own = terms.dropDuplicates(["iri"]).select("iri", "local", tokens(F.col("local")).alias("words"), F.lower(F.concat_ws(" ", "local", "prefix", "iri")).alias("hay"))
    words = own.select(F.explode(F.array_distinct("words")).alias("token"), "iri")
    # A word of a query has EDITED characters or more, so one edit away there is one less at least.
    apart = words.select("token").distinct().where(F.length("token") >= EDITED - 1).select(F.explode(deletions(F.col("token"))).alias("deleted"), "token")
    return TermIndex(own, postings(own, "iri", "hay"), words, apart)


def word_hits(index: TermIndex, words: DataFrame) -> DataFrame:
    """T5 for words (column word): rows (word, iri, local, score) with a score of 1 or more."""
    asked = words.select("word").distinct()
    inside = holding(index.grams, asked.withColumnRenamed("word", "needle")).select(F.col("needle").alias("word"), F.col("key").alias("iri"))
    keys = asked.where(F.length("word") >= EDITED).select("word", F.explode(deletions(F.col("word"))).alias("deleted"))
    near = keys.join(index.deletions, "deleted").select("word", "token").distinct().where(within_one_edit(F.col("word"), F.col("token")))
    apart = near.join(index.tokens, "token").select("word", "iri")
    rows = inside.unionByName(apart).distinct().join(index.terms, "iri")
    return rows.select("word", "iri", "local", word_score(F.col("word"), F.col("words"), F.col("hay")).alias("score")).where("score > 0")


def search(terms: DataFrame | TermIndex, queries: DataFrame) -> DataFrame:
    """Ranked terms for each query of a table.

    ``terms`` has iri, local, prefix, or is an index of them; ``queries`` has query.
    Bands: ``match`` if every word scores 2 or more, ``close`` if at least half score at
    all, ``all`` for a query without a word, which has every term. place is the rank
    within a query.
    """
    index = terms if isinstance(terms, TermIndex) else build_index(terms)
    split = F.filter(F.split(F.lower(F.trim("query")), "\\s+"), lambda w: w != "")
    asked = queries.select("query").distinct().withColumn("asked", split)
    each = asked.where(F.size("asked") > 0).select("query", F.size("asked").alias("n"), F.explode("asked").alias("word"))
    scored = each.join(word_hits(index, each), "word").groupBy("query", "iri").agg(
        F.max("n").alias("n"), F.max("local").alias("local"), F.sum("score").alias("score"), F.count("*").alias("hit"), F.count_if(F.col("score") >= 2).alias("good")
    )
    band = F.when(F.col("good") == F.col("n"), "match").when(F.col("hit") * 2 >= F.col("n"), "close")
    found = scored.withColumn("band", band).where("band is not null").select("query", "iri", "local", "band", F.col("score").cast("int").alias("score"))
    blank = asked.where(F.size("asked") == 0).select("query", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))).alias("part"))
    dealt = index.terms.select("iri", "local", F.pmod(F.hash("iri"), F.lit(_PARTS)).alias("part"))
    every = blank.join(dealt, "part").select("query", "iri", "local", F.lit("all").alias("band"), F.lit(0).alias("score"))
    order = Window.partitionBy("query").orderBy(F.col("band") == "close", F.desc("score"), F.length("local"), "local", "iri")
    return found.unionByName(every).withColumn("place", F.row_number().over(order))
