"""Brute-force models of the operators, and rows to hold them against."""

import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Null, empty, white space, one word, copies, near copies, a long one, odd characters.
TEXTS = [
    None, "", " \t\n", "word", "Word", "two words", "a b c d e f g h i j", "A b c D e f g h i j", "a b c d e f g h i k",
    "the same text here", "the same text here", "the same text here", "é ß 日本 text with odd\x1fspace", "line one\nline one\n\nline two", "x" * 5000,
    "lorem ipsum dolor " * 900, "The quick brown fox jumps over the lazy dog. " * 12, "#$% &&& *** |||", "it's  two   spaces\r\nand\ttabs ", "<|endoftext|> is text",
]
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string, row int, score int, id string"


def table(spark, texts=TEXTS, start=0, ids=None, lang=lambda i: "en", source=lambda i: f"s{i % 3}"):
    """Documents with more columns than needed, whose names operators use themselves."""
    ids = ids or range(start, start + len(texts))
    rows = [(i, t, lang(k), source(k), len(t or ""), "f", 1, 2, "x") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, COLUMNS)


def fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_groups(ids, prints):
    """id to the least id that links of at most two bits reach."""
    by = defaultdict(list)
    for i, p in zip(ids, prints, strict=True):
        by[p].append(i)
    least = {p: min(v) for p, v in by.items()}
    fps = sorted(by)
    pairs = [(least[a], least[b]) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 2]
    comp = components(pairs, list(least.values()))
    return {i: comp[least[p]] for p, v in by.items() for i in v}


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    inside = {k for i, w in enumerate(windows) if count[w] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)
