"""Personal data: patterns, and terms that give away whom a text is about.

Base kinds, leftmost and non-overlapping per kind, offsets in code points: email, ip, card
(16 to 19 digits with a valid check digit) and phone (8 to 15 digits).

Terms: the values of the base kinds are the protected entities. For every entity and every word
near it (`reach` words either side of a mention) the corpus gives how often they stand together
(rows), how often the word stands anywhere (rows) and how often the entity does. A word is disclosing
if, for some entity, at least `share` of all rows with the word have the entity near it, and if it
raises the chance of the entity by `bits` bits or more. The second must not be luck: if the chance of
the entity in a row with the word were only 2^bits times its share of all rows, then what was seen would
have a probability of at most `doubt`. That is the binomial tail, by its Chernoff bound, which is exact
where every row with the word has the entity. What counts as seen are different surroundings, so copies of a
document are no evidence. There is no least length, kind or number: in a large corpus one or
two surroundings are enough, in a small one they are not. All occurrences of a disclosing word become spans
of the kind "term", except inside base spans.

Words are what white space separates, lower-cased and without punctuation at the ends. Counts cover
all rows; a task hands them on when it has `block` words. Words near mentions, and disclosing words,
stay tables that are joined to the words of the texts; the driver sees only a bit map of them, of 64 bits
a word and 8 MB at most, and a fuller map only lets more words reach the join.

Defined results: null and empty texts have no spans; repeated rows each get theirs; a term that is
disclosing for several entities is one span; long texts are taken whole, in time linear in their length;
extra columns are kept, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import bit_map, free_name, map_bits, store

KINDS = ("email", "ip", "card", "phone", "term")
BASE = 4

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a run of digits is tried at its start only: starts inside it would end at the same place
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_EDGES = ".,;:!?()[]{}<>\"'*#$%&|"


@dataclass(frozen=True)
class Disclosure:
    reach: int = 8
    share: float = 0.8
    bits: float = 4.0
    doubt: float = 0.05
    block: int = 200_000


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Goes from @ to @, so a long run of name characters costs no retries."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        else:
            done = max(done, at + 1)  # what stands before an @ is not part of a later name
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and then start."""
    spans = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            spans.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                spans.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                spans.append((3, m.start(), m.end()))
    return spans


def term_of(token: str) -> str | None:
    return token.strip(_EDGES).lower() or None


def _contexts(text: str, reach: int) -> set[tuple[int, str, int]]:
    """(entity, term, surroundings) of every mention in a text."""
    spans = base_spans(text)
    if not spans:
        return set()
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    covered, i = [False] * len(tokens), 0
    ordered = sorted(spans, key=lambda s: s[1])
    first: dict[tuple[int, int, int], tuple[int, int]] = {}
    for span in ordered:  # by start, so the first token of a span never moves back
        while i < len(tokens) and tokens[i][1] <= span[1]:
            i += 1
        j = i
        while j < len(tokens) and tokens[j][0] < span[2]:
            covered[j] = True
            j += 1
        first[span] = (i, j)
    found = set()
    for kind, start, end in ordered:
        i, j = first[kind, start, end]
        value = xxhash.xxh64_intdigest(f"{KINDS[kind]}:{text[start:end].lower()}") >> 1
        near = [k for k in (*range(max(i - reach, 0), i), *range(j, min(j + reach, len(tokens)))) if not covered[k]]
        terms = [t for k in near if (t := term_of(text[tokens[k][0]:tokens[k][1]]))]
        place = xxhash.xxh64_intdigest(" ".join(terms)) >> 1
        found.update((value, t, place) for t in terms)
    return found


def _mentions(docs: DataFrame, reach: int) -> DataFrame:
    """One row per row of the table, entity, term and surroundings; the row is a number within its task."""
    def run(batches):
        n = 0
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                n += 1
                if text:
                    rows.extend((n, *c) for c in _contexts(text, reach))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()),
                 pa.array(columns[3], pa.int64())], names=["row", "entity", "term", "place"])

    return docs.select("text").mapInArrow(run, "row long, entity long, term string, place long").withColumn(
        "task", F.spark_partition_id())


def _terms(text: str) -> set[str]:
    return {t for token in set(text.split()) if (t := term_of(token))}


def _bit(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term)


def _sent(docs: DataFrame, terms: DataFrame):
    """The bit map of a table of terms as a broadcast value, and its number of bits."""
    bits = map_bits(terms.count())
    return docs.sparkSession.sparkContext.broadcast(bytes(bit_map(terms.select("term"), _bit, bits))), bits


def _row_counts(docs: DataFrame, terms: DataFrame, block: int) -> DataFrame:
    """term, rows: in how many rows each of the terms occurs; a task hands its counts on when it has `block` words."""
    sent, bits = _sent(docs, terms)

    def run(batches):
        counts: dict[str, int] = {}
        held = sent.value

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                              names=["term", "rows"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for term in _terms(text or ""):
                    if held[(at := _bit(term) % bits) >> 3] >> (at & 7) & 1:
                        counts[term] = counts.get(term, 0) + 1
                if len(counts) > block:
                    yield rows()
                    counts.clear()
        yield rows()

    counted = docs.select("text").mapInArrow(run, "term string, rows long").groupBy("term").agg(F.sum("rows").alias("rows"))
    out = store(counted.join(terms, "term", "left_semi"), "term_rows")
    sent.destroy()
    return out


def _hits(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """_digest, _terms: the disclosing terms of each different text that has any. The bit map keeps most
    other words out of the join; what passes it by chance finds no term there."""
    sent, bits = _sent(docs, terms)

    def run(batches):
        held = sent.value
        for batch in batches:
            digests, found = [], []
            for digest, text in zip(*(c.to_pylist() for c in batch.columns)):
                here = [t for t in _terms(text or "") if held[(at := _bit(t) % bits) >> 3] >> (at & 7) & 1]
                digests += [digest] * len(here)
                found += here
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), pa.array(found, pa.string())], names=["_digest", "term"])

    passed = docs.select(F.xxhash64("text"), "text").mapInArrow(run, "_digest long, term string")
    out = store(passed.join(terms, "term").groupBy("_digest").agg(F.collect_set("term").alias("_terms")), "term_hits")
    sent.destroy()
    return out


def measured_terms(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """term, entity, together, places (different surroundings), rows, entity_rows, total of every word near an entity."""
    mentions = store(_mentions(docs, rule.reach), "mentions")
    together = mentions.groupBy("entity", "term").agg(
        F.count_distinct("task", "row").alias("together"), F.count_distinct("place").alias("places"))
    entities = mentions.groupBy("entity").agg(F.count_distinct("task", "row").alias("entity_rows"))
    counts = _row_counts(docs, store(mentions.select("term").distinct(), "near_terms"), rule.block)
    return together.join(counts, "term").join(entities, "entity").withColumn("total", F.lit(docs.count()))


def disclosing_terms(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """The measures, share and bits of the words over the thresholds."""
    found = measured_terms(docs, rule)
    share = F.col("together") / F.col("rows")
    lucky = F.lit(2.0 ** rule.bits) * F.col("entity_rows") / F.col("total")
    # of the surroundings with the word, k of n have the entity; n times the divergence of k / n from luck
    n = F.ceil(F.col("places") / share)
    part = F.col("places") / n
    apart = part * F.ln(part / lucky) + F.when(part < 1, (1 - part) * F.ln((1 - part) / (1 - lucky))).otherwise(0.0)
    found = found.where((share >= rule.share) & (lucky < part)).withColumns(
        {"share": share, "bits": F.log2(share * F.col("total") / F.col("entity_rows")), "_evidence": n * apart})
    return store(found.where(F.col("_evidence") >= math.log(1 / rule.doubt) - 1e-12).drop("_evidence"), "disclosing")


def term_spans(text: str, wanted: set[str], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not wanted:
        return []
    starts, ends = [], []  # base spans as disjoint runs
    for start, end in sorted((s, e) for _, s, e in base):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    found = []
    for m in _TOKEN.finditer(text):
        token = m.group()
        if term_of(token) in wanted:
            start = m.start() + len(token) - len(token.lstrip(_EDGES))
            end = start + len(token.strip(_EDGES))
            before = bisect_left(starts, end) - 1  # the last run that starts before the word ends
            if before < 0 or ends[before] <= start:
                found.append((4, start, end))
    return found


def sanitised(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, or run of overlapping spans, replaced by the name of its kind."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def with_spans(docs: DataFrame, into: str, rule: Disclosure = Disclosure(), rewrite: bool = False,
               text: str = "text") -> DataFrame:
    """Add all spans (kind, start, end) of the whole text; with `rewrite` also replace them in the text."""
    plain = docs.select(F.col(text).alias("text"))
    hits = _hits(plain, store(disclosing_terms(plain, rule).select("term").distinct(), "terms"))
    at, names = docs.columns.index(text), [*docs.columns, into]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = docs.select("*", F.expr("cast(null as array<struct<kind: string, start: bigint, end: bigint>>)").alias(into)).schema
    digest, held = free_name(docs, "_digest"), free_name(docs, "_terms")
    hits = hits.withColumnsRenamed({"_digest": digest, "_terms": held})
    rows = docs.withColumn(digest, F.xxhash64(F.col(text))).join(hits, digest, "left").select(*[F.col(f"`{c}`") for c in docs.columns], held)

    def run(batches):
        for batch in batches:
            spans, texts = [], []
            for value, wanted in zip(batch.column(at).to_pylist(), batch.column(len(names) - 1).to_pylist()):
                found = base_spans(value or "")
                found += term_spans(value or "", set(wanted or ()), found)
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e in found])
                texts.append(sanitised(value, found) if rewrite and found else value)
            columns = list(batch.columns[:-1])
            if rewrite:
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], names=names)

    return rows.mapInArrow(run, schema)


def sanitised_rows(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """All rows of `docs` with its columns, personal data replaced in the text."""
    into = free_name(docs, "_spans")
    return with_spans(docs, into, rule, rewrite=True).select(*[F.col(f"`{c}`") for c in docs.columns])
