"""Registered queries over the text operators, with SQL where SQL can express them."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (decontaminate, licenses, line_dedup, packing, periodic_runs, pii, quality_rules, simhash, spelling, suffix_dedup,
               toxicity, url_filter, warc)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def _quality_measures_sql(docs: str) -> str:
    """CTEs up to `measured`: one row per row of `docs` with doc_id, lang and the measures."""
    return f"""
numbered as (select row_number() over () as rid, * from {docs}),
split as (
  select rid, doc_id, lang, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls
  from numbered),
grams as (
  select rid, i, array_to_string(ws[i:i+4], ' ') as g
  from (select rid, ws, unnest(range(1, len(ws) - 3)) as i from split)),
again as (select rid, i from grams qualify count(*) over (partition by rid, g) > 1),
covered as (select rid, count(distinct i + o) as n from again, range(0, 5) r(o) group by rid),
measured as (
  select rid, doc_id, lang, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols, len(ls) as n_lines,
    len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words,
    length(t) - length(replace(t, '!', '')) as n_marks
  from split left join covered using (rid))"""


def quality_sql(docs: str = "documents", rules: quality_rules.Rules = quality_rules.Rules()) -> str:
    """CTEs up to `judged`: the measures with base_failed and kept."""
    listed = ", ".join(f"'{s}'" for s in rules.strata)
    risk, tests = rules.risk / 4, (len(rules.strata) + 1) * 4
    cells = ", ".join(
        f"('{name}', least(floor({part} * {rules.cells} / greatest({whole}, 1)), {rules.cells}))"
        for name, (part, whole) in quality_rules.SHARES.items())
    return f"""{_quality_measures_sql(docs)},
strata as (select *, case when lang in ({listed}) then lang else 'other' end as stratum from measured),
placed as (select rid, doc_id, stratum, rule, cell from strata, lateral (values {cells}) v(rule, cell)),
known as (select doc_id, max(quality) as good from labels where quality is not null group by doc_id),
cell_counts as (
  select stratum, rule, cell,
    count(*) filter (not fit and good > 0) as held_good, count(*) filter (fit and good > 0) as fit_good,
    count(*) filter (fit and good <= 0) as fit_bad
  from (select *, substring(md5(doc_id::varchar), 1, 1) < '8' as fit from placed join known using (doc_id))
  group by all),
sizes as (select stratum, rule, sum(held_good) as n from cell_counts group by all),
terms as (
  select stratum, rule, i, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
      + i * ln({risk}) + (n - i) * ln(1 - {risk}))) over (partition by stratum, rule order by i) as total
  from (select stratum, rule, n, unnest(range(0, cast(ceil(n * {risk}) as bigint) + 1)) as i from sizes) where i <= n),
bound as (
  select stratum, rule, coalesce(max(i) filter (total <= {rules.doubt / tests!r}), -1) as most from terms group by all),
reach as (
  select stratum, rule, cell, sum(held_good) over up as held_good, sum(fit_good) over up as fit_good,
    sum(fit_bad) over up as fit_bad
  from cell_counts where cell > 0 window up as (partition by stratum, rule order by cell desc)),
certified as (
  select stratum, rule, cell, fit_bad - {rules.penalty} * fit_good as gain from reach join bound using (stratum, rule)
  where held_good <= most and fit_bad - {rules.penalty} * fit_good > 0),
cutoffs as (
  select stratum, rule, cell as cutoff from certified
  qualify row_number() over (partition by stratum, rule order by gain desc, cell desc) = 1),
rejected as (select distinct rid from placed join cutoffs using (stratum, rule) where cell >= cutoff),
judged as (
  select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words as base_failed,
    not base_failed and rid not in (select rid from rejected) as kept
  from measured)"""


@query("op10_quality_rules", f"""with {quality_sql()}
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed, kept from judged""")
def op10_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged, at = quality_rules.judge(docs, table(spark, sf_dir, "labels"), text_needed=False)
    return judged.select("doc_id", *[F.col(f"{at}.{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def contamination_sql(docs: str = "documents") -> str:
    """CTEs up to `contamination`: per row of `docs` the words hit and the items found."""
    words = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
             " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
    return f"""
doc_rows as (select row_number() over () as did, doc_id, {words} as dw from {docs}),
item_words as (select item_id::varchar as item_id, {words} as iw from benchmark where item_id is not null),
item_windows as (
  select distinct item_id, least(len(iw), 10) as size, array_to_string(iw[i:i+9], ' ') as w
  from (select *, unnest(range(1, greatest(len(iw) - 9, 1) + 1)) as i from item_words where len(iw) > 0)),
doc_windows as (
  select did, i, size, array_to_string(dw[i:i+size-1], ' ') as w
  from (select did, dw, size, unnest(range(1, len(dw) - size + 2)) as i
        from doc_rows, (select distinct size from item_windows))),
found as (select did, i, size, item_id from doc_windows join item_windows using (size, w)),
hit_words as (select did, count(distinct i + o) as n_hit from found, range(0, 10) r(o) where o < size group by did),
hit_items as (
  select did, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as items
  from found group by did),
contamination as (
  select did, doc_id, len(dw) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    coalesce(items, '') as items
  from doc_rows left join hit_words using (did) left join hit_items using (did))"""


@query("op9_benchmark_decontamination", f"""with {contamination_sql()}
select doc_id, n_words::bigint as n_words, n_hit::bigint as n_hit, n_items::bigint as n_items,
  sha256(items) as items_sha256, n_hit > 0 as contaminated from contamination""")
def op9_benchmark_decontamination(spark, sf_dir):
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query("op4_simhash_near_duplicates")
def op4_simhash_near_duplicates(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op1_personal_data")
def op1_personal_data(spark, sf_dir):
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "spans")
    kinds = [F.expr(f"size(filter(spans, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in pii.KINDS]
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select("doc_id", *kinds[:pii.BASE], F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"), kinds[pii.BASE])


def vocabulary() -> tuple[str, str, tuple[tuple[str, int], ...]]:
    """Path, split pattern and added tokens of the byte-level vocabulary; the same ids as byte_bpe_50k.json."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as described:
        added = json.load(described)["added_tokens"]
    return (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tuple((t["content"], t["id"]) for t in added))


@query("op5_sequence_packing")
def op5_sequence_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), *vocabulary(), with_ids=False)


@query("op2_warc_records")
def op2_warc_records(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
             ("block", "com/de/")]


@query("op8_url_filter")
def op8_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_table(spark, URL_RULES))


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), with_kept=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        "kept_sha256")


def _licenses_sql() -> str:
    """Containment of every template in every window, without MinHash."""
    rows = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(licenses.TEMPLATES))
    words = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9\\x{80}-\\x{10FFFF}]+'), lambda x: x <> '')"
    return f"""with templates(template, license, text) as (values {rows}),
template_words as (select template, license, {words} as ws from templates),
template_shingles as (
  select distinct template, license, array_to_string(ws[i:i+4], ' ') as s
  from (select *, unnest(range(1, len(ws) - 3)) as i from template_words)),
sizes as (
  select template, count(*) as n, pow(2, ceil(log2(count(*))))::int as width from template_shingles group by template),
doc_rows as (select row_number() over () as rid, doc_id, text from documents),
doc_shingles as (
  select rid, i - 1 as p, array_to_string(ws[i:i+4], ' ') as s
  from (select rid, ws, unnest(range(1, len(ws) - 3)) as i from (select rid, {words} as ws from doc_rows))),
held as (
  select distinct rid, template, license, n, p // width - o as number, s
  from doc_shingles join template_shingles using (s) join sizes using (template), range(0, 2) r(o) where p // width - o >= 0),
found as (
  select distinct rid, template, license from (
    select rid, template, license, n, number from held group by all having count(*) >= {licenses.CONTAINMENT} * n)),
per_row as (
  select rid, string_agg(distinct license, ',' order by license) as licenses, count(distinct template) as n_templates
  from found group by rid)
select doc_id, coalesce(licenses, '') as licenses, coalesce(n_templates, 0)::bigint as n_templates
from doc_rows left join per_row using (rid)"""


@query("op7_license_scan", _licenses_sql())
def op7_license_scan(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents"), licenses.templates_table(spark))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_templates")


_LINE_DEDUP_SQL = f"""with doc_lines as (
  select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (
  select rid, doc_id, i, ls[i] as line,
    translate(trim(ls[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select *, unnest(range(1, len(ls) + 1)) as i from doc_lines)),
frequent as (
  select k, max(doc_id) as keep from lines where length(k) >= {line_dedup.Rule.min_chars}
  group by k having count(distinct doc_id) >= {line_dedup.Rule.min_docs}),
judged as (select rid, doc_id, i, line, keep is not null and doc_id <> keep as gone from lines left join frequent using (k))
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from judged group by rid"""


@query("op13_line_dedup", _LINE_DEDUP_SQL)
def op13_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.deduplicated(docs, "n_lines", "n_dropped")
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten, by its doc_id, repeat from some word on; without a doc_id they stay."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    period, left = words[a:a + p], len(words) - a
    return words[:a] + (period * (left // p + 1))[:left]


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.with_runs(docs, "runs", "kept", prepare=planted_period)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.s")).alias("start"), F.col("top.l").alias("length"),
        (-F.col("top.p")).alias("period"), F.expr("1000 * top.l div -top.p").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))


def planted_deletion(doc_id: int | None) -> Callable[[str], str]:
    """Deletes a code point from one word in 31 of a document; a null doc_id counts as empty text."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())

    def change(word: str) -> str:
        h = zlib.crc32(word.encode(), start)
        if h % 31:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1:]

    return change


@query("op12_spelling_variants")
def op12_spelling_variants(spark, sf_dir):
    found = spelling.groups(table(spark, sf_dir, "documents"), prepare=planted_deletion)
    return found.select("word", "form", "root", "n", "n_near", "form_n")
