"""Quality rules whose cutoffs are certified on labelled holdouts.

Every rule measures a share of a text that is high in junk. A cutoff may be used only where
an exact binomial bound on the held-out clean rows shows that it rejects at most `risk` of
the clean rows of a stratum. The bound is split over all strata and rules (Bonferroni); along
the cutoffs of one rule, from lenient to strict, testing stops at the first that fails, which
needs no further correction. Among the certified cutoffs the one with the best gain on the
other labelled rows (rejected junk minus `penalty` times rejected clean rows) is used, and none
where no cutoff gains anything. Strata without enough labels get no cutoff, so they keep rows.

Defined results: a null or empty text has no words and fails the base rules; a null or unlisted
stratum value belongs to the stratum "other"; several labels of one document count as the best
of them; labels that are null or name no document are ignored; repeated rows are judged one by
one; an empty table gives an empty table. Only built-in functions run here, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name, store

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_marks")


@dataclass(frozen=True)
class Rules:
    """Production parameters. `strata` lists the values that get cutoffs of their own, which
    bounds the table of cutoffs; `cells` is the number of cutoffs tried per rule."""
    strata: tuple[str, ...] = ("de", "en", "es", "fr")
    risk: float = 0.05
    doubt: float = 0.05
    penalty: int = 20
    cells: int = 200
    min_words: int = 10
    max_repeat_percent: int = 20


# share measured by each rule: numerator and denominator
SHARES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "marks": ("n_marks", "n_words"),
}


def _occurrences(text: Column, chars: str) -> Column:
    bare = text
    for ch in chars:
        bare = F.replace(bare, F.lit(ch), F.lit(""))
    return F.length(text) - F.length(bare)


def measure(docs: DataFrame, into: str, text: str = "text") -> DataFrame:
    """Add a struct of MEASURES for the whole text.

    Five-word windows are compared by a 64-bit hash inside one text; positions are sorted only
    in texts where some window repeats. Steps are kept in separate columns that are used more
    than once each, so that Spark does not evaluate a word list again for every window.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    blanks = plain
    for ch in "\t\n\x0b\f\r":
        blanks = F.replace(blanks, F.lit(ch), F.lit(" "))
    step = docs.select(
        F.struct("*").alias("_row"),
        F.array_remove(F.split(blanks, " "), "").alias("_words"),
        F.filter(F.split(plain, "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\f\r")) != "").alias("_lines"),
        _occurrences(plain, SYMBOLS).alias("_symbols"),
        _occurrences(plain, "!").alias("_marks"))
    step = step.select(
        "_row", "_symbols", "_marks", F.size("_words").alias("_size"),
        F.length(F.array_join("_words", "")).alias("_chars"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
        F.size("_lines").alias("_all_lines"), F.size(F.array_distinct("_lines")).alias("_own_lines"))
    step = step.withColumn("_grams", F.expr(
        f"transform(slice(_hashes, 1, greatest(_size - {WINDOW - 1}, 0)), (h, i) -> xxhash64(h, "
        + ", ".join(f"get(_hashes, i + {k})" for k in range(1, WINDOW)) + "))")).drop("_hashes")
    step = step.withColumn("_sorted", F.expr(
        "case when size(array_distinct(_grams)) < size(_grams)"
        " then sort_array(transform(_grams, (h, i) -> struct(h as h, i as i)))"
        " else cast(array() as array<struct<h: bigint, i: int>>) end")).drop("_grams")
    step = step.withColumn("_found", F.expr(
        "sort_array(transform(filter(_sorted, (e, j) -> e.h = get(_sorted, j + 1).h or e.h = get(_sorted, j - 1).h),"
        " e -> e.i))")).drop("_sorted")
    covered = F.expr(
        f"aggregate(transform(_found, (p, j) -> least({WINDOW}, coalesce(get(_found, j + 1) - p, {WINDOW}))),"
        " 0L, (a, x) -> a + x)")
    values = F.struct(
        F.col("_size").cast("long").alias("n_words"),
        F.col("_chars").cast("long").alias("word_chars"),
        F.col("_symbols").cast("long").alias("n_symbols"),
        F.col("_all_lines").cast("long").alias("n_lines"),
        (F.col("_all_lines") - F.col("_own_lines")).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.col("_marks").cast("long").alias("n_marks"),
    )
    return step.select("_row.*", values.alias(into))


def _cell(rules: Rules, measures: str, rule: str) -> Column:
    part, whole = SHARES[rule]
    share = F.col(f"{measures}.{part}") * rules.cells / F.greatest(F.col(f"{measures}.{whole}"), F.lit(1))
    return F.least(F.floor(share), F.lit(rules.cells)).cast("int")


def _stratum(rules: Rules, column: Column) -> Column:
    return F.when(column.isin(list(rules.strata)), column).otherwise(F.lit("other"))


def calibrate(measured: DataFrame, labels: DataFrame, rules: Rules, measures: str,
              stratum: str = "lang", label: str = "quality") -> DataFrame:
    """One row per stratum and rule with a certified, useful cutoff: stratum, rule, cutoff.

    Counts per cutoff cell are added up before anything is compared, so a stratum that holds
    most rows costs no more than the others.
    """
    known = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("good"))
    rows = measured.select(
        F.col("doc_id"), _stratum(rules, F.col(stratum)).alias("stratum"),
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), _cell(rules, measures, r).alias("cell"))
                            for r in SHARES])).alias("at"))
    fold = F.when(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8", "fit").otherwise("held")
    rows = rows.join(known, "doc_id").withColumn("fold", fold)
    counts = rows.groupBy("stratum", "at.rule", "at.cell").agg(
        F.count_if((F.col("fold") == "held") & (F.col("good") > 0)).alias("held_good"),
        F.count_if((F.col("fold") == "fit") & (F.col("good") > 0)).alias("fit_good"),
        F.count_if((F.col("fold") == "fit") & (F.col("good") <= 0)).alias("fit_bad"))
    tests = (len(rules.strata) + 1) * len(SHARES)
    risk, doubt = rules.risk / len(SHARES), rules.doubt / tests
    # `most`: the largest number of rejected held-out clean rows that the bound still certifies
    return measured.sparkSession.sql(f"""
        with size as (
          select stratum, rule, sum(held_good) as n from {{counts}} group by stratum, rule),
        bound as (
          select stratum, rule, aggregate(
            sequence(0L, cast(ceil(n * {risk}) as bigint)),
            named_struct('term', n * ln(1 - {risk}), 'total', 0D, 'most', -1L),
            (a, i) -> named_struct(
              'term', case when n > i then a.term + ln((n - i) / (i + 1D)) + ln({risk} / (1 - {risk})) else a.term end,
              'total', a.total + exp(a.term),
              'most', case when a.total + exp(a.term) <= {doubt} then i else a.most end)).most as most
          from size),
        reach as (
          select stratum, rule, cell,
            sum(held_good) over up as held_good, sum(fit_good) over up as fit_good, sum(fit_bad) over up as fit_bad
          from {{counts}} where cell > 0
          window up as (partition by stratum, rule order by cell desc))
        select stratum, rule, max_by(cell, struct(fit_bad - {rules.penalty} * fit_good, cell)) as cutoff
        from reach join bound using (stratum, rule)
        where held_good <= most and fit_bad - {rules.penalty} * fit_good > 0
        group by stratum, rule""", counts=counts)


def judge(docs: DataFrame, labels: DataFrame, rules: Rules = Rules(), stratum: str = "lang",
          text_needed: bool = True) -> tuple[DataFrame, str]:
    """All rows and columns of `docs` with one struct more, and the name of that struct. Without
    `text_needed` the text is left out and not stored either.

    The struct holds MEASURES, base_failed and kept. Rows are measured once and stored in the
    shared folder; the cutoffs, at most strata x rules rows, are broadcast.
    """
    into = free_name(docs, "_rules")
    measured = measure(docs, into)
    measured = store(measured if text_needed else measured.drop("text"), "measured")
    cutoffs = calibrate(measured, labels, rules, into, stratum).groupBy("stratum").pivot(
        "rule", list(SHARES)).agg(F.first("cutoff"))
    return _decide(measured, store(cutoffs, "cutoffs"), rules, into, stratum), into


def _decide(measured: DataFrame, cutoffs: DataFrame, rules: Rules, into: str, stratum: str) -> DataFrame:
    cuts = cutoffs.select(F.col("stratum").alias("_stratum"), F.struct(*SHARES).alias("_cutoffs"))
    rows = measured.select(F.struct("*").alias("_row"), _stratum(rules, F.col(stratum)).alias("_stratum"))
    joined = rows.join(F.broadcast(cuts), "_stratum", "left")
    measures = f"_row.{into}"
    n = F.col(f"{measures}.n_words")
    failed = (n < rules.min_words) | (F.col(f"{measures}.n_repeat_words") * 100 > n * rules.max_repeat_percent)
    rejected = F.lit(False)
    for rule in SHARES:
        rejected = rejected | F.coalesce(_cell(rules, measures, rule) >= F.col(f"_cutoffs.{rule}"), F.lit(False))
    verdict = F.struct(*[F.col(f"{measures}.{m}").alias(m) for m in MEASURES],
                       failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))
    return joined.select(*[F.col(f"_row.`{c}`") for c in measured.columns if c != into], verdict.alias(into))


def kept_rows(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows that pass, with the columns of `docs`."""
    judged, into = judge(docs, labels, rules)
    return judged.where(F.col(f"{into}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
