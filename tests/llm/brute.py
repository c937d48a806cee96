"""Plain-Python statements of the contracts, for small tables."""

import collections
import math
import re

A_Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall((text or "").translate(A_Z))


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def components(docs, percent=75):
    """``doc_id -> (set size, smallest reachable id)`` by all pairs that share a shingle."""
    sets, by = {}, collections.defaultdict(list)
    for i, t in docs:
        sets[i] = shingles(t)
        for s in sets[i]:
            by[s].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, own in sets.items():
        shared = collections.Counter(j for s in own for j in by[s] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def rule_counts(text):
    w = WORD.findall(text or "")
    at = collections.defaultdict(list)
    for k in range(len(w) - 4):
        at[tuple(w[k : k + 5])].append(k)
    covered = {j for p in at.values() if len(p) > 1 for k in p for j in range(k, k + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def leaks(docs, items, percent=75):
    """``(doc_id, item_id) -> (similarity, start)`` of the best window at the item's size."""
    def tokens(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    def grams(t):
        w = tokens(t)
        return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]

    counts = {i: collections.Counter(grams(t)) for i, t in items}
    by = collections.defaultdict(set)
    for i, c in counts.items():
        for g in c:
            by[g].add(i)
    out = {}
    for d, t in docs:
        g = grams(t)
        starts = {(i, k) for k, x in enumerate(g) for i in by.get(x, ())}
        for i, k in sorted(starts):
            n = sum(counts[i].values())
            window = collections.Counter(g[k : k + n])
            same = sum((window & counts[i]).values())
            whole = sum(window.values()) + n - same
            if 100 * same >= percent * whole and same / whole > out.get((d, i), (0, 0))[0]:
                out[d, i] = (same / whole, k)
    return out


def licenses(docs, path, templates, threshold=0.7, share=0.5):
    """``doc_id -> (own license, source directory, effective license)``; templates are (license, words, is a title)."""
    token = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
    white = " \t\n\x0b\x0c\r"

    def terms(s):
        return token.findall(s.lower())

    n = len(templates)
    df = collections.Counter(w for _, t, _ in templates for w in set(terms(t)))

    def vector(s):
        v = {w: k * (math.log((1 + n) / (1 + df[w])) + 1) for w, k in collections.Counter(terms(s)).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else {}

    known = [(k, vector(t), title) for k, t, title in templates]

    def best(unit):
        v = vector(unit)
        cosine, at = min((-round(sum(x * t.get(w, 0) for w, x in v.items()), 6), i) for i, (_, t, _) in enumerate(known))
        return -cosine, known[at][0], known[at][2]

    own, files = {}, {}
    for i, t in docs:
        t = t or ""
        found = [(best(x), x, False) for x in t.split("\n")]
        found += [(best(x), x, True) for x in re.split(r"\n[\x20\x09-\x0d]*\n", t) if "\n" in x]
        found = [x for x in found if x[0][0] >= threshold]
        if found:
            own[i] = min((-b[0], b[1]) for b, _, _ in found)
            held = [sum(len(words(x)) for _, x, block in found if block == kind) for kind in (False, True)]
            if any(b[2] and t.lstrip(white).startswith(x.lstrip(white)) for b, x, _ in found) or max(held) >= share * len(words(t)):
                d = path(i).rpartition("/")[0]
                files[d] = min(files.get(d, (9, "")), own[i])
    out = {}
    for i, _ in docs:
        if i in own:
            out[i] = (own[i][1], None, own[i][1])
            continue
        steps = path(i).split("/")[:-1]
        near = next((d for k in range(len(steps), 0, -1) if (d := "/".join(steps[:k])) in files), None)
        out[i] = (None, near, files[near][1] if near else None)
    return out


def lm(docs, held_out, head, size, least=2, discount=0.75, steps=10, order=2):
    """``doc_id -> (n_tokens, n_known, N, base, score)``."""
    def tokens(t):
        return [w.encode() for w in words(t)] + [b" "]

    count = collections.Counter(w for i, t in docs if not held_out(i) for w in tokens(t))
    total, distinct = sum(count.values()), len(count)
    bins = collections.Counter(math.floor(math.log2(n) * 16) for n in count.values())
    used, cut = 0, math.inf
    for b in sorted(bins, reverse=True):
        if used + bins[b] > head:
            break
        used, cut = used + bins[b], b
    ranked = sorted((-n, w) for w, n in count.items() if math.floor(math.log2(n) * 16) >= cut)
    vocabulary = {w for _, w in ranked[:size]}
    pair, context, start = collections.Counter(), collections.Counter(), object()
    for i, t in docs:
        before = start
        for w in tokens(t) if not held_out(i) else ():
            context[before] += 1
            if (before is start or before in vocabulary) and w in vocabulary:
                pair[before, w] += 1
            before = w
    level = {k: math.ceil(-math.log2((n - discount) / context[k[0]]) * steps) for k, n in pair.items() if n >= least}
    rest = collections.defaultdict(lambda: 1.0)
    for (v, _), x in level.items():
        rest[v] -= 2 ** (-x / steps)
    triple, context2 = collections.Counter(), collections.Counter()
    inside = lambda w: w is start or w in vocabulary
    for i, t in docs if order == 3 else ():
        ws = [start, *tokens(t)]
        for u, v, w in zip(ws, ws[1:], ws[2:]) if not held_out(i) else ():
            if inside(u) and inside(v):
                context2[u, v] += 1
                triple[u, v, w] += w in vocabulary
    level3 = {k: math.ceil(-math.log2((n - discount) / context2[k[:2]]) * steps) for k, n in triple.items() if n >= least}
    rest3 = collections.defaultdict(lambda: 1.0)
    for (u, v, _), x in level3.items():
        rest3[u, v] -= 2 ** (-x / steps)
    out = {}
    for i, t in docs:
        older, before, base, score = None, start, 0.0, 0.0
        for w in tokens(t):
            p = (count[w] + 1) / (total + distinct + 1)
            base += math.log10(p)
            q = 2 ** (-level[before, w] / steps) if (before, w) in level else 0.0
            p = q + rest[before] * p if before is start or before in vocabulary else p
            if (older, before) in rest3:
                p = (2 ** (-level3[older, before, w] / steps) if (older, before, w) in level3 else 0.0) + rest3[older, before] * p
            score += math.log10(p)
            older, before = before, w
        out[i] = (len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), total, base, score)
    return out
