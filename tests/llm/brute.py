"""Plain Python versions of what the text operators compute, for small tables."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib

import numpy as np
import xxhash

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    text = text or ""
    found = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return found


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = BLANK.findall(text)
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts: dict[tuple, int] = {}
    for g in grams:
        counts[g] = counts.get(g, 0) + 1
    repeated = {i + o for i, g in enumerate(grams) if counts[g] > 1 for o in range(5)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated),
            n < 10 or 100 * len(repeated) > 20 * n)


def binomial_most(n, risk, doubt):
    total, most = 0.0, -1
    for i in range(math.ceil(n * risk) + 1):
        if i <= n:
            total += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                              + i * math.log(risk) + (n - i) * math.log(1 - risk))
            if total <= doubt:
                most = i
    return most


def fingerprint(text):
    words = BLANK.findall(fold(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def simhash_classes(rows, distance=2):
    """doc ids -> smallest reachable doc id."""
    prints = [(i, fingerprint(t)) for i, t in rows]
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= distance:
                parent[find(a)] = find(b)
    best: dict[int, int] = {}
    for k, (i, _) in enumerate(prints):
        best[find(k)] = min(best.get(find(k), i), i)
    return {i: (p, best[find(k)]) for k, (i, p) in enumerate(prints)}


def contamination(text, items, length=10):
    """n_words, n_hit and the sorted ids of the items found."""
    words = WORD.findall(fold(text))
    hit, found = set(), set()
    for item, passage in items:
        own = WORD.findall(fold(passage))
        if not own:
            continue
        windows = {tuple(own[i:i + length]) for i in range(max(1, len(own) - length + 1))}
        size = min(length, len(own))
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def suffix_dedup(rows, length):
    """doc id -> n_bytes, n_removed, n_spans, kept_sha256."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        covered = np.zeros(len(data) + 1, int)
        for p in range(len(data) - length + 1):
            if data[p:p + length] in seen:
                covered[p] += 1
                covered[p + length] -= 1
            else:
                seen.add(data[p:p + length])
        gone = np.cumsum(covered)[:-1] > 0
        starts = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i] = (len(data), int(gone.sum()), starts, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def warc(rows):
    """page id -> bytes, digest, type, refers_to."""
    first, out = {}, {}
    for page, html in sorted(rows):
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        origin = first.setdefault(digest, page)
        out[page] = (len(data), digest, "response" if origin == page else "revisit", None if origin == page else origin)
    return out


def rule_for(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = fold(host)
    best = None
    for verdict, rule in rules:
        at = rule.index("/")
        domain, start = rule[:at], rule[at:]
        if (host == domain or host.endswith("." + domain)) and path.startswith(start) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def propagate(seeds, edges, damping, rounds):
    """Trust over edges {(src, dst): weight}, from seeds {host: share}."""
    hosts = set(seeds) | {h for e in edges for h in e}
    rank = {h: seeds.get(h, 0.0) for h in hosts}
    out = {h: sum(w for (s, _), w in edges.items() if s == h) for h in hosts}
    for _ in range(rounds):
        lost = sum(rank[h] for h in hosts if not out[h])
        rank = {h: (1 - damping + damping * lost) * seeds.get(h, 0.0)
                + damping * sum(rank[s] * w / out[s] for (s, d), w in edges.items() if d == h) for h in hosts}
    return rank


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


EDGES = ".,;:!?()[]{}<>\"'*#$%&|"


def term_measures(rows, reach=8):
    """(entity, term): together, places, rows, entity rows, number of rows; by plain loops over all rows."""
    together, places, held, entity_rows = {}, {}, {}, {}
    for n, (_, text) in enumerate(rows):
        text = text or ""
        tokens = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        term = lambda k: text[tokens[k][0]:tokens[k][1]].strip(EDGES).lower()  # noqa: E731, B023
        for t in {term(k) for k in range(len(tokens))} - {""}:
            held.setdefault(t, set()).add(n)
        spans = personal(text)
        covered = {k for k, (a, b) in enumerate(tokens) if any(s < b and a < e for _, s, e in spans)}
        for kind, start, end in spans:
            value = f"{kind}:{text[start:end].lower()}"
            entity_rows.setdefault(value, set()).add(n)
            first = next(k for k, (a, b) in enumerate(tokens) if b > start)
            last = next((k for k, (a, b) in enumerate(tokens) if a >= end), len(tokens))
            near = [k for k in (*range(max(first - reach, 0), first), *range(last, min(last + reach, len(tokens)))) if k not in covered]
            words = [w for k in near if (w := term(k))]
            for w in words:
                together.setdefault((value, w), set()).add(n)
                places.setdefault((value, w), set()).add(" ".join(words))
    return {k: (len(v), len(places[k]), len(held[k[1]]), len(entity_rows[k[0]]), len(rows)) for k, v in together.items()}


def disclosing(rows, share=0.8, bits=4.0, doubt=0.05):
    """Terms over the thresholds; luck by the Chernoff bound of the binomial tail."""
    found = set()
    for (_, term), (both, seen, all_rows, of_entity, total) in term_measures(rows).items():
        part, luck = both / all_rows, 2 ** bits * of_entity / total
        n = math.ceil(seen / part)
        k = seen / n
        if part >= share and luck < k:
            tail = math.exp(-n * (k * math.log(k / luck) + ((1 - k) * math.log((1 - k) / (1 - luck)) if k < 1 else 0.0)))
            if tail <= doubt * (1 + 1e-9):
                found.add(term)
    return found


def term_spans(text, terms):
    base = personal(text)
    out = []
    for m in re.finditer(r"\S+", text or ""):
        word = m.group().strip(EDGES)
        if word.lower() in terms:
            start = m.start() + len(m.group()) - len(m.group().lstrip(EDGES))
            if not any(s < start + len(word) and start < e for _, s, e in base):
                out.append(("term", start, start + len(word)))
    return out
