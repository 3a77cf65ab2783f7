"""Plain Python versions of the corpus operators, for small tables."""

import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def near_duplicates(rows, percent=75):
    """{doc_id: (n_shingles, component_id)} for (doc_id, text) rows, comparing all texts that share a shingle."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    at = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in at[x]:
                shared[j] += 1
            at[x].append(k)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((root(i), root(sets[j][0])))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets}


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def bm25(docs, queries, k, k1=1.2, b=0.75):
    """[(query_id, rank, doc_id, score)] by scoring every document."""
    from collections import Counter
    from math import log

    bags = [(i, Counter(words(t))) for i, t in docs]
    df = Counter(w for _, c in bags for w in c)
    mean = max(1.0, sum(sum(c.values()) for _, c in bags) / max(1, len(bags)))
    postings = defaultdict(list)
    for j, (_, c) in enumerate(bags):
        size = sum(c.values())
        for w, tf in c.items():
            postings[w].append((j, tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))))
    out = []
    for q, text in queries:
        scores = defaultdict(float)
        for w, n in Counter(words(text)).items():
            idf = log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5))
            for j, x in postings[w]:
                scores[j] += n * idf * x
        best = sorted((-round(s, 9), bags[j][0]) for j, s in scores.items() if s > 0)[:k]
        out += [(q, r + 1, d, -s) for r, (s, d) in enumerate(best)]
    return out
