"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash


def fingerprint(text, shingle=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def component_ids(prints, radius=3):
    """Least id of each row's component; prints: [(id, fingerprint)]."""
    distinct = sorted({p for _, p in prints})
    parent = {p: p for p in distinct}

    def find(p):
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[find(b)] = find(a)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return [least.get(find(p)) for _, p in prints]


def without_repeats(texts, least=200, keep_first=False):
    """(bytes, removed, spans, digest) of each text."""
    places = defaultdict(list)
    raws = [(t or "").encode() for t in texts]
    for d, raw in enumerate(raws):
        for i in range(len(raw) - least + 1):
            places[raw[i : i + least]].append((d, i))
    gone = [bytearray(len(raw)) for raw in raws]
    for found in places.values():
        if len(found) > 1:
            for d, i in found[1 if keep_first else 0 :]:
                gone[d][i : i + least] = b"\x01" * least
    out = []
    for raw, mask in zip(raws, gone):
        kept = bytes(b for b, g in zip(raw, mask) if not g)
        out.append((len(raw), sum(mask), len(re.findall(b"\x01+", bytes(mask))), hashlib.sha256(kept).hexdigest()))
    return out


def weighted_similarity(a, b):
    keys = a.keys() | b.keys()
    top = sum(max(a[k], b[k]) for k in keys)
    return sum(min(a[k], b[k]) for k in keys) / top if top else 0.0


def contaminations(docs, items, least=0.8):
    """{(document, item): similarity of the best window}."""
    out = {}
    for doc_id, text in docs:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        for item_id, item in items:
            wanted = re.findall(r"[^\W_]+", (item or "").lower())
            if not wanted or not words:
                continue
            if len(wanted) < 5:  # only a document that is the item
                if words == wanted:
                    out[doc_id, item_id] = 1.0
                continue
            size = 5

            def grams(w):
                return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))

            own = grams(wanted)
            if own.keys().isdisjoint(grams(words)):
                continue  # no window can be like it
            best = max(
                weighted_similarity(grams(words[s : s + len(wanted)]), own)
                for s in range(max(1, len(words) - len(wanted) + 1)))
            if best >= least:
                out[doc_id, item_id] = best
    return out


def repeated_words(words):
    counts = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if counts[tuple(words[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    return len(covered)


def similar(a, b, shingle=5):
    """Weighted similarity of two texts' shingles, A-Z lower-cased; equal word lists are 1."""
    def grams(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return Counter(tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1)))

    x, y = grams(a), grams(b)
    return sum((x & y).values()) / sum((x | y).values())


def kept_of_similar(docs, least):
    """Least id of each group of documents that are so similar."""
    docs = [(i, t or "") for i, t in docs]
    bags = [frozenset(t.lower().split()) for _, t in docs]
    parent = list(range(len(docs)))

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i in range(len(docs)):
        for j in range(i):
            if len(bags[i] & bags[j]) * 2 >= len(bags[i]) and similar(docs[i][1], docs[j][1]) >= least:
                a, b = sorted((find(i), find(j)), key=lambda n: docs[n][0])
                parent[b] = a
    return {docs[find(n)][0] for n in range(len(docs))}
