"""Plain versions of the operators, one document at a time, that the tests hold the queries against."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fingerprint(text):
    from xxhash import xxh64_intdigest

    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def groups(prints, budget=3):
    """Least id reachable over links of at most ``budget`` bits, for each (id, fingerprint)."""
    ids, values = [i for i, _ in prints], np.array([v for _, v in prints], np.uint64)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(values[a] ^ values[a + 1 :]) <= budget).tolist():
            ra, rb = find(a), find(a + 1 + b)
            parent[ra if ids[ra] > ids[rb] else rb] = rb if ids[ra] > ids[rb] else ra
    return {i: ids[find(k)] for k, i in enumerate(ids)}


def text_stats(text):
    text = text or ""
    words = WORD.findall(text)
    n, seen, dup = len(words), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    counts = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    covered = {i + k for i in range(n - 7) if counts[tuple(words[i : i + 8])] > 1 for k in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return n, sum(map(len, words)), symbols, dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        c = int(c) * (1 + i % 2)
        total += c - 9 * (c > 9)
    return total % 10 == 0


def base_spans(text):
    def valid(kind, x):
        digits = re.sub("[^0-9]", "", x)
        if kind == "ip":
            return all(int(p) <= 255 for p in x.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and luhn(digits)
        return kind != "phone" or 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k in PII for m in re.finditer(PII[k], text or "") if valid(k, m.group())]


def best_fit_bins(lengths, capacity):
    """How many bins best-fit decreasing uses, one item at a time."""
    rooms, made = [], 0
    for length in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, length)
        if i < len(rooms):
            room = rooms.pop(i)
        else:
            room, made = capacity, made + 1
        bisect.insort(rooms, room - length)
    return made


def archive(pages):
    """(page_id, bytes, digest, type, refers to) of every (page_id, html)."""
    same = defaultdict(list)
    for page_id, html in pages:
        same[(html or "").encode()].append(page_id)
    rows = []
    for page_id, html in pages:
        data = (html or "").encode()
        first = max(same[data])
        revisit = len(data) >= 1000 and page_id != first
        rows.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return rows
