"""Plain versions of what the operators compute, row by row."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from hashlib import sha256

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def license_row(text):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    own, places = words(text), {}
    for label, phrase in phrases.items():
        p = phrase.split()
        if found := [i for i in range(len(own) - len(p) + 1) if own[i : i + len(p)] == p]:
            places[label] = found
    starts = [s for found in places.values() for s in found]
    return len(own), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(places))


def rules_row(text):
    text = text or ""
    own = SPACED.findall(text)
    windows = Counter(tuple(own[i : i + 8]) for i in range(len(own) - 7))
    covered = {j for i in range(len(own) - 7) if windows[tuple(own[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if SPACED.search(line)]
    failed = len(own) < 20 or 100 * len(covered) > 30 * len(own)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(own), sum(map(len, own)), symbols, len(lines) - len(set(lines)), len(covered), failed


def contamination_rows(texts, items, width=13):
    windows = defaultdict(set)
    for item_id, text in items:
        own = words(text)
        for i in range(max(0, len(own) - width) + 1 if own else 0):
            windows[tuple(own[i : i + width])].add(item_id)
    lengths = {len(w) for w in windows}
    for text in texts:
        own, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(own) - n + 1):
                if (w := tuple(own[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w]
        digest = sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        yield len(own), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(own)


def _luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1])) % 10 == 0


def personal_row(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    spans, counts = [], []
    for kind, pattern in patterns.items():
        n = 0
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and _luhn(digits),
                "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]()
            if good:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
                n += 1
        counts.append(n)
    return *counts, ",".join(spans)


def targets(sizes, weights=(3, 1, 2)):
    """source -> target, by sharing the excess again until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, done, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        share = (total - sum(done.values())) / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > 2 * sizes[s]]
        if not over:
            done |= {s: share * weight[s] for s in free}
            break
        for s in over:
            done[s] = 2 * sizes[s]
            free.discard(s)
    return done
