"""Brute-force versions that the operators' tests compare with."""

import hashlib
import re
from collections import Counter

SF = "/root/testdata/sf0.001"


def odd_documents(spark, texts=(), extra="length"):
    """Documents with null ids and texts, empty and long texts, repeated rows and a clashing column."""
    rows = [(i, t, "en", 0) for i, t in enumerate(texts)]
    rows += [(None, "a text without an id, told in a few words", "de", 1), (900, None, None, 2), (901, "", "en", 3), (902, "x" * 30_000, None, 4)]
    rows += [(903, "said twice, said twice, this row is", "en", 5)] * 2
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, `{extra}` int")


def words(text):
    return re.findall(r"[a-z0-9_\x80-\U0010ffff]+", (text or "").lower())


def shingles(text, n=5):
    w = words(text)
    n = min(n, len(w))
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if n else []


def jaccard(a, b):
    return len(a & b) / len(a | b)


def weighted(a, b):
    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / sum((a | b).values())


def near_classes(docs, threshold=0.8):
    """{row: (class, copy_of, n_copies, n_links)} of (id, text) rows without null ids."""
    sets = [frozenset(shingles(t)) or ("text", t or "") for _, t in docs]
    first, copies = {}, Counter(sets)
    for (i, _), s in zip(docs, sets):
        first[s] = min(i, first.get(s, i))
    distinct = [s for s in first if isinstance(s, frozenset)]
    root = {s: s for s in first}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    links = Counter()
    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if jaccard(a, b) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)), key=lambda s: first[s])
                root[y] = x
    return [(i, first[find(s)], first[s], copies[s], links[s]) for (i, _), s in zip(docs, sets)]


def cut_passages(docs, length=100):
    """(id, bytes, kept bytes, spans) of (id, text) rows in order of place."""
    seen, out = set(), []
    for i, t in docs:
        raw = (t or "").encode()
        hit = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            part = raw[k : k + length]
            if part in seen:
                hit[k : k + length] = b"\1" * length
            else:
                seen.add(part)
        spans = sum(1 for k in range(len(raw)) if hit[k] and (not k or not hit[k - 1]))
        out.append((i, len(raw), bytes(x for x, h in zip(raw, hit) if not h), spans))
    return out


def leaked(text, items, threshold=0.8):
    """{item: (start, words, similarity)}: the first most similar window for each item that the text leaks."""
    w, out = words(text), {}
    for i, item in items:
        own = words(item)
        if not own or not w:
            continue
        size, width, best = min(5, len(own)), min(len(own), len(w)), None
        want = [tuple(own[k : k + size]) for k in range(len(own) - size + 1)]
        grams = [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
        known = set(want)
        for start in range(len(w) - width + 1):
            part = grams[start : start + width - size + 1]
            if part and any(g in known for g in part):
                x = weighted(part, want)
                if x >= threshold and (best is None or x > best[2]):
                    best = (start, width, x)
        if best:
            out[i] = best
    return out


def sha(raw):
    return hashlib.sha256(raw).hexdigest()
