"""Finds benchmark passages in documents by a prefix-filtered join of word windows.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. A window is `length`
consecutive words of an item; an item with fewer words, but at least one, is one window.

Since a window has to occur whole, one prefix token is necessary: its rarest word, by counts
over all documents. A document word that equals a prefix token is a candidate; the token's
position in the window fixes the only place where that window can start, windows that would
reach over either end of the text are dropped by length, and the words around the candidate are
compared with the window word by word.

Benchmark words are looked up in sets of at most `block` entries inside the scan of the
documents; a larger benchmark is worked off in several such blocks, with the same rows as result.

Defined results: null and empty texts have no words; a null item text has no window; an item
with a null id is ignored; repeated rows each get the full result; items that repeat a text are
found together; an empty benchmark or document table gives no hits. Only built-in functions run
here, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, store

WORD_BREAK = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
LENGTH = 10
BLOCK = 20_000
CANDIDATES = "array<struct<token: string, place: int, around: array<string>>>"


def _words(text: Column) -> Column:
    """Words in their own spelling; A-Z never separate words, so case can wait."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def _blocks(values: DataFrame, column: str, block: int) -> list[list[str]]:
    """The distinct values in lists of at most `block`. One list is held at a time by a scan; what
    the driver holds are the words of the benchmark, never of the documents."""
    found = sorted(r[0] for r in values.select(column).distinct().collect())
    return [found[i:i + block] for i in range(0, len(found), block)]


def benchmark_windows(benchmark: DataFrame, length: int = LENGTH) -> DataFrame:
    """Distinct windows: item_id, words (lower case)."""
    items = benchmark.where("item_id is not null").select(
        F.col("item_id").cast("string").alias("item_id"),
        F.transform(_words(F.col("text")), ascii_lower).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - F.lit(length - 1), F.lit(1)))
    return (items.where(F.size("words") > 0)
            .select("item_id", "words", F.explode(starts).alias("start"))
            .select("item_id", F.slice("words", F.col("start"), F.lit(length)).alias("words")).distinct())


def _folded(w: Column) -> Column:
    """Cheap lower case that maps words equal under A-Z folding to equal words."""
    return F.lower(w)


def _near(words: str, tokens: list[str], reach: int) -> Column:
    """For each word in `tokens`: the word, its place from 1 and the words up to `reach` around it."""
    placed = F.filter(F.transform(words, lambda w, i: F.struct(_folded(w).alias("token"), (i + 1).alias("place"))),
                      lambda x: x["token"].isin(tokens))
    return F.transform(placed, lambda x: F.struct(
        x["token"].alias("token"), x["place"].alias("place"),
        F.slice(F.col(words), F.greatest(x["place"] - F.lit(reach), F.lit(1)), F.lit(2 * reach + 1)).alias("around")))


def _split_rows(docs: DataFrame) -> DataFrame:
    """doc_id, digest (tells rows of one id apart by their text) and words."""
    return docs.select("doc_id", F.xxhash64("text").alias("digest"), _words(F.col("text")).alias("words"))


def rarest_first(split: DataFrame, windows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Windows with their prefix token: item_id, words, token, at (its place from 1)."""
    tokens = windows.select(F.explode("words").alias("word")).select("word", _folded(F.col("word")).alias("token"))
    counts = None
    for part in _blocks(tokens, "token", block):
        # the outer form: Spark turns a plain explode into a filter as well and would split the text twice
        found = split.select(F.explode_outer(F.filter(F.transform("words", _folded), lambda w: w.isin(part))).alias("token"))
        found = found.where("token is not null").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        counts = found if counts is None else counts.unionByName(found)
    placed = windows.select("item_id", "words", F.posexplode("words").alias("at", "word"))
    placed = placed.withColumn("token", _folded(F.col("word")))
    if counts is not None:
        placed = placed.join(counts, "token", "left")
    else:
        placed = placed.withColumn("n", F.lit(None).cast("long"))
    first = F.min_by(F.struct("token", (F.col("at") + 1).alias("at")), F.struct(F.coalesce("n", F.lit(0)), "token", "at"))
    return placed.groupBy("item_id", "words").agg(first.alias("first")).select("item_id", "words", "first.*")


def occurrences(split: DataFrame, prefixed: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """Every occurrence of a window: doc_id, digest, n_words, start (from 0), size, item_id; and one
    row without an occurrence for each row of the documents."""
    parts = _blocks(prefixed, "token", block) or [[]]
    out = None
    for number, part in enumerate(parts):
        rows = split.select(
            "doc_id", "digest", F.size("words").alias("n_words"),
            (_near("words", part, length - 1) if part else F.expr(f"cast(array() as {CANDIDATES})")).alias("near"))
        if number == 0:  # the row itself stands beside its candidates: nothing is joined back to the texts
            rows = rows.withColumn("near", F.concat(F.expr(f"cast(array(null) as {CANDIDATES})"), "near"))
        rows = rows.select("doc_id", "digest", "n_words", F.explode_outer("near").alias("c")).select(
            "doc_id", "digest", "n_words", "c.*")
        out = rows if out is None else out.unionByName(rows.where("token is not null"))
    # rows without a token get a key of their own (words have no blanks), so they do not meet in one task
    out = out.withColumn("key", F.coalesce("token", F.concat(F.lit(" "), F.col("digest").cast("string"))))
    joined = out.drop("token").join(prefixed.withColumnRenamed("token", "key"), "key", "left")
    begin = F.col("place") - F.col("at")  # of the window in the text, from 0
    size = F.size("words")
    before = F.least(F.col("place") - 1, F.lit(length - 1))  # words of `around` before the token
    fits = (begin >= 0) & (begin + size <= F.col("n_words"))
    there = F.slice("around", F.greatest(before - F.col("at") + 2, F.lit(1)), size)
    equal = fits & (F.transform(there, ascii_lower) == F.col("words"))
    return joined.where(F.col("place").isNull() | equal).select(
        "doc_id", "digest", "n_words", F.when(F.col("place").isNotNull(), begin).alias("start"), size.alias("size"), "item_id")


def scan(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, items (sorted ids), digest of the text."""
    split = _split_rows(docs)
    windows = store(benchmark_windows(benchmark, length), "windows")
    prefixed = store(rarest_first(split, windows, block), "prefixes")
    found = store(occurrences(split, prefixed, length, block), "occurrences")
    rows = found.groupBy("doc_id", "digest").agg(
        F.first("n_words").alias("n_words"), F.count_if(F.col("start").isNull()).alias("copies"))
    hits = found.where("start is not null")
    covered = (hits.select("doc_id", "digest", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("at"))
               .distinct().groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n_hit")))
    items = (hits.select("doc_id", "digest", "item_id").distinct().groupBy("doc_id", "digest")
             .agg(F.sort_array(F.collect_list("item_id")).alias("items")))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:  # a null doc_id is a value of its own
        renamed = right.withColumnsRenamed({"doc_id": "_d", "digest": "_h"})
        return left.join(renamed, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("digest") == F.col("_h")), "left").drop("_d", "_h")

    full = beside(beside(rows, covered), items)
    return full.select("doc_id", "digest", F.col("n_words").cast("long").alias("n_words"),
                       F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                       F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                       F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def clean_rows(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of `docs` that hold no passage of the benchmark, with their columns."""
    hit = scan(docs, benchmark, length).where("n_hit > 0").select(
        F.col("doc_id").alias("_d"), F.col("digest").alias("_h")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(docs["text"]) == F.col("_h")), "left_anti")
