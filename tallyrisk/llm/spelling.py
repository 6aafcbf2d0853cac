"""Groups spelling variants: words one inserted, deleted or replaced code point apart.

Words are counted over all texts; a task hands its counts on when it has `block` different words.

Permuterm rotations: a word w = a x b, marked by a terminator $, is rotated so that the edited code
point x comes last, b $ a x. What stands before x is the key b $ a. The rotations of all words are
sorted by key; words that differ by a replacement at that place share the key, and the word a b,
whose own rotation is the key itself, stands in the same group: x is what an insertion adds to it.
So a group holds at most one shorter word and one longer word per letter of the alphabet, which
bounds it, whatever the table. Each member of a group gets the number of its neighbours there and
the best of them; no pair is listed. Of a letter that is repeated only the first place counts for
insertions and deletions, so a pair of words meets once.

Keys of over `literal` code points (two runs of letters without a break) are kept as 128-bit hashes
of b and a, and such words as a hash, so a word of n letters makes n rows of bounded size.

A form has ten times the occurrences of its word or more, so chains of forms are short (their length
is at most the number of digits of the largest count); they are followed by doubling steps.

Defined results: null and empty texts have no words; equal rows all count; long texts and long words
are taken whole; among near words of equal count the one smallest in code points is the form; extra
columns do not matter; an empty table gives no words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import store

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
MODULUS = (1 << 127) - 1
BASE = 0x9E3779B97F4A7C15F39CC0605CEDC835


@dataclass(frozen=True)
class Rule:
    min_chars: int = 7
    min_count: int = 2
    factor: int = 10
    literal: int = 64
    block: int = 200_000


def word_counts(docs: DataFrame, rule: Rule = Rule(), prepare: Callable[[object], Callable[[str], str]] | None = None,
                text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, n: the words of the texts, A-Z lower-cased. `prepare` gets a doc_id and returns a function that
    may change the words of that document."""
    def run(batches: Iterator[pa.RecordBatch]):
        counts: Counter[str] = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for number, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                # lower() of bytes changes A-Z only
                found = Counter(LETTERS.findall((value or b"").lower().decode(errors="replace")))
                if prepare is None:
                    found = {w: n for w, n in found.items() if len(w) >= rule.min_chars}
                    for word, n in found.items():
                        counts[word] += n
                else:
                    change = prepare(number)
                    for word, n in found.items():
                        if len(word) >= rule.min_chars and len(word := change(word)) >= rule.min_chars:
                            counts[word] += n
                if len(counts) > rule.block:
                    yield rows()
                    counts.clear()
        yield rows()

    found = docs.select(doc_id, text).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rule.min_count)


def reference(word: str, literal: int) -> str:
    """The word itself, or '#' and a hash where it is long."""
    return word if len(word) <= literal else "#" + xxhash.xxh3_128_hexdigest(word)


def _hashed_keys(word: str) -> tuple[list[int], list[int], list[int]]:
    """Polynomial hashes of all beginnings and of all ends of a long word."""
    front, back, power = [0], [0] * (len(word) + 1), 1
    for ch in word:
        front.append((front[-1] * BASE + ord(ch)) % MODULUS)
    for i in range(len(word) - 1, -1, -1):
        back[i] = (back[i + 1] + ord(word[i]) * power) % MODULUS
        power = power * BASE % MODULUS
    return front, back


def rotations(word: str, literal: int) -> tuple[list[str], list[str | None], list[bool]]:
    """Keys, the code point that the key leaves out (null: none), and whether the pair with the shorter word
    counts at this place."""
    size, turned = len(word), f"{word}${word}"
    if size <= literal:
        shorter = [turned[i:i + size + 1] for i in range(size + 1)]
        longer = [turned[i + 1:i + 1 + size] for i in range(size)]
    else:
        front, back = _hashed_keys(word)
        # both parts with their lengths: key = '#', length, hash of the end, hash of the beginning
        shorter = [f"#{size}:{back[i]:x}:{i}:{front[i]:x}" for i in range(size + 1)]
        if size - 1 <= literal:
            longer = [turned[i + 1:i + 1 + size] for i in range(size)]
        else:
            longer = [f"#{size - 1}:{back[i + 1]:x}:{i}:{front[i]:x}" for i in range(size)]
    first = [i == 0 or word[i] != word[i - 1] for i in range(size)]
    return shorter + longer, [None] * (size + 1) + list(word), [True] * (size + 1) + first


def _rotated(words: DataFrame, literal: int) -> DataFrame:
    """key, skipped, first, ref, n: all rotations of all words."""
    def run(batches: Iterator[pa.RecordBatch]):
        def rows():
            out = pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(skipped, pa.string()), pa.array(first, pa.bool_()), pa.array(refs, pa.string()),
                 pa.array(counts, pa.int64())], names=["key", "skipped", "first", "ref", "n"])
            for held in (keys, skipped, first, refs, counts):
                held.clear()
            return out

        keys, skipped, first, refs, counts = [], [], [], [], []
        for batch in batches:
            for word, n in zip(*(c.to_pylist() for c in batch.columns)):
                k, s, f = rotations(word, literal)
                keys += k
                skipped += s
                first += f
                refs += [reference(word, literal)] * len(k)
                counts += [n] * len(k)
                if len(keys) > 50_000:
                    yield rows()
        yield rows()

    return words.select("word", "n").mapInArrow(run, "key string, skipped string, first boolean, ref string, n long")


def neighbours(words: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """ref, near, best_n, best: per word and group the number of near words there, and the best of them."""
    turned = _rotated(words, rule.literal)
    # in a group: longer words first, by count, then by the skipped code point, which is the order of the words
    order = Window.partitionBy("key").orderBy(F.col("skipped").isNull(), F.desc("n"), "skipped")
    group = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    longer, joined = F.col("skipped").isNotNull(), F.col("skipped").isNotNull() & F.col("first")
    item = F.struct("n", "ref")
    seen = turned.select(
        "ref", "n", longer.alias("longer"), "first", F.row_number().over(order).alias("place"),
        F.count(F.when(longer, 1)).over(group).alias("all_longer"), F.count(F.when(joined, 1)).over(group).alias("joined"),
        F.first(F.when(longer, item), True).over(group).alias("top"), F.nth_value(F.when(longer, item), 2).over(group).alias("second"),
        F.first(F.when(joined, item), True).over(group).alias("top_joined"), F.first(F.when(~longer, item), True).over(group).alias("shorter"))
    other = F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("top"))  # of the longer words, not itself
    below = F.when(F.col("first"), F.col("shorter"))
    rank = lambda c: F.struct((-c["n"]).alias("minus"), c["ref"].alias("ref"))
    near = F.when(F.col("longer"), F.col("all_longer") - 1 + F.when(below.isNotNull(), 1).otherwise(0)).otherwise(F.col("joined"))
    return seen.select("ref", near.alias("near"), *[
        F.when(F.col("longer"), a).otherwise(b).alias(name) for name, a, b in (
            ("one", F.when(other.isNotNull(), rank(other)), F.when(F.col("top_joined").isNotNull(), rank(F.col("top_joined")))),
            ("two", F.when(below.isNotNull(), rank(below)), F.lit(None)))]).where("near > 0")


def variants(words: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """word, n, n_near, form, form_n of every row of `words` (word, n; stored by the caller)."""
    known = words.select("word", "n", F.when(F.length("word") <= rule.literal, F.col("word")).alias("ref"))
    if_long = F.length("word") > rule.literal

    def named(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            refs = pa.array([reference(w, rule.literal) for w in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, refs], names=["word", "n", "ref"])

    long = words.where(if_long).select("word", "n").mapInArrow(named, "word string, n long, ref string")
    known = known.where(~if_long).unionByName(long)
    found = store(neighbours(words, rule), "neighbours")
    counted = found.select("ref", "near", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("minus"))
    picks = found.select("ref", F.explode(F.array("one", "two")).alias("p")).where("p is not null").select(
        "ref", F.lit(0).cast("long").alias("near"), F.col("p.ref").alias("other"), F.col("p.minus").alias("minus"))
    hashed = F.col("other").startswith("#")
    named_picks = picks.where(hashed).join(long.select(F.col("ref").alias("other"), "word"), "other").select(
        "ref", "near", F.col("word").alias("other"), "minus")
    own = known.select("ref", F.lit(0).cast("long").alias("near"), F.lit(None).cast("string").alias("other"),
                       F.lit(None).cast("long").alias("minus"), "word", "n")
    rows = counted.unionByName(picks.where(~hashed)).unionByName(named_picks).withColumns(
        {"word": F.lit(None).cast("string"), "n": F.lit(None).cast("long")}).unionByName(own)
    best = F.min(F.when(F.col("other").isNotNull(), F.struct("minus", "other"))).alias("best")
    merged = rows.groupBy("ref").agg(F.max("word").alias("word"), F.max("n").alias("n"), F.sum("near").alias("n_near"), best)
    enough = -F.col("best.minus") >= rule.factor * F.col("n")
    return merged.select("word", "n", "n_near", F.when(enough, F.col("best.other")).alias("form"),
                         F.when(enough, -F.col("best.minus")).alias("form_n"))


def with_roots(found: DataFrame) -> DataFrame:
    """Adds root: from the word, follow forms to the last. `found` (word, form, ...) is stored by the caller."""
    links = store(found.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = store(links.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went")), "roots")
        links = moved.drop("went")
        if moved.where("went").isEmpty():
            break
    rooted = found.join(links, "word", "left")
    return rooted.withColumn("root", F.coalesce("root", "word"))


def groups(docs: DataFrame, rule: Rule = Rule(), prepare: Callable[[object], Callable[[str], str]] | None = None) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the texts."""
    words = store(word_counts(docs, rule, prepare), "words")
    return with_roots(store(variants(words, rule), "variants"))
