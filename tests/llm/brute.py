"""Plain versions of what the operators compute, from the contracts' wording."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

SPACE = "[\x20\x09-\x0d]+"


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return [w for w in re.split(SPACE, text or "") if w]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text: str | None, n: int) -> frozenset:
    w = words(lower(text or ""))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(sets: dict[int, frozenset], numerator: int, denominator: int) -> dict[int, int]:
    parent = {i: i for i in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sorted(sets) if sets[i]]
    for k, a in enumerate(ids):
        for b in ids[:k]:
            shared = len(sets[a] & sets[b])
            if denominator * shared >= numerator * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in sets}


def removed(texts: list[str | None], window: int = 20) -> list[tuple[int, int, str]]:
    seen, out = set(), []
    for text in texts:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def line_dedup(docs: dict[int, str | None], least: int = 20, enough: int = 3) -> dict[int, tuple[int, int, str]]:
    key = lambda line: lower(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    holders: dict[str, set[int]] = {}
    for i, text in docs.items():
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, text in docs.items():
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < enough or max(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def quality(text: str | None) -> tuple[int, int, int, int, int]:
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    counts = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if counts[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def places(text: str | None, phrases: list[str]) -> tuple[int, list[int]]:
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))
    return len(w), sorted(k for p in phrases for k in range(len(w)) if w[k : k + len(p.split())] == p.split())


def split_url(url: str | None) -> tuple[str, str]:
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    host, path = re.match("([^/?#]*)([^?#]*)", url[at + 3 :], re.DOTALL).groups()
    return lower(host), path


def grams(text: str | None) -> list[str]:
    """All runs of one to three of a text's letters; what lies between words is one separator, also at the ends."""
    parts = "".join(c if c.isalpha() else "\x01" for c in (text or "").lower())
    words = [w for w in parts.split("\x01") if w]
    if not words:
        return []
    joined = "\x01" + "\x01".join(words) + "\x01"
    return [c for c in joined if c != "\x01"] + [joined[k : k + n] for n in (2, 3) for k in range(len(joined) - n + 1)]


def top_grams(texts: list[str | None], limit: int) -> list[str]:
    """The most frequent first; of equals the smaller code, so shorter ones and those with smaller characters."""
    counts = Counter(g for t in texts for g in grams(t))
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))[:limit]


def language(text: str | None, profiles: dict[str, list[str]], limit: int) -> tuple[str, float]:
    mine = top_grams([text], limit)
    if not mine:
        return "und", 0.0
    best = []
    for lang, profile in profiles.items():
        place = {g: k for k, g in enumerate(profile)}
        apart = sum(min(limit, abs(k - place[g])) if g in place else limit for k, g in enumerate(mine))
        best.append((apart, lang))
    apart, lang = min(best)
    return lang, 1 - apart / (limit * len(mine))


def features(text: str | None) -> list[tuple]:
    """Tokens, runs of letters and digits or of other signs, and pairs of neighbours."""
    tokens = re.findall("[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0d]+", text or "")
    return [(t,) for t in tokens] + list(zip(tokens, tokens[1:], strict=False))


def item_shingles(text: str | None) -> frozenset:
    """Five-word shingles of letters and digits in lower case; a shorter text's whole sequence."""
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", lower(text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
