"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict


def near_classes(texts, frequent, threshold=0.8):
    """For each text the number of its class: weighted Jaccard of 5-word shingles over all pairs, then components."""
    words = [(t or "").split() for t in texts]
    bags = [Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter() for w in words]
    different = {}
    for i, t in enumerate(texts):
        different.setdefault(t or "", i)
    own = sorted(different.values())
    df = Counter(s for i in own for s in bags[i])
    least = sum(len(bags[i]) for i in own) / frequent
    weigh = [{s: n * math.log1p(len(own) / max(df[s], least)) for s, n in b.items()} for b in bags]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = set()
    at = defaultdict(list)
    for i in own:
        for s in weigh[i]:
            at[s].append(i)
    shared = Counter((i, j) for members in at.values() for a, i in enumerate(members) for j in members[a + 1 :])
    total = [sum(w.values()) for w in weigh]
    for i, j in shared:
        both = sum(min(x, weigh[j][s]) for s, x in weigh[i].items() if s in weigh[j])
        if both / (total[i] + total[j] - both) >= threshold:
            pairs.add((i, j))
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(different[t or ""]) for t in texts], pairs


def without_repeats(texts, length=100):
    """(kept bytes, removed bytes, runs) of texts in order."""
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        out.append((bytes(b for b, g in zip(raw, gone, strict=True) if not g), sum(gone), len(re.findall(b"\1+", gone))))
    return out


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def contamination(texts, items, window=10):
    """(n_words, n_hit, items found, sha256) of each text."""
    lists = [(name, bench_words(t)) for name, t in items if name is not None]
    out = []
    for t in texts:
        w, hit, found = bench_words(t), set(), set()
        for name, x in lists:
            for s in range(max(len(x) - window + 1, 1) if x else 0):
                part = x[s : s + window]
                for at in range(len(w) - len(part) + 1):
                    if w[at : at + len(part)] == part:
                        hit |= set(range(at, at + len(part)))
                        found.add(str(name))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


def proximity(text, phrase, span):
    """Whether ``span`` words in a row hold all words of the phrase, each as often."""
    w, need = bench_words(text), Counter(phrase)
    return any(not need - Counter(w[i : i + span]) for i in range(len(w)))


def quality_kept(texts, trusted, smoothing, threshold, cell=lambda g: g):
    """Verdicts of the rules; ``trusted``: for each text whether it is one of the target."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    grams = [Counter(map(cell, [*((w,) for w in ws), *zip(ws, ws[1:], strict=False)])) for ws in words]
    raw, target = sum(grams, Counter()), sum((g for g, k in zip(grams, trusted, strict=True) if k), Counter())
    out = []
    for ws, own, k in zip(words, grams, trusted, strict=True):
        windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        n = Counter(windows)
        inside = {i + j for i, x in enumerate(windows) if n[x] > 1 for j in range(3)}
        failed = len(ws) < 50 or 100 * len(inside) > 50 * len(ws)
        size = own.total()
        m, rest = target.total() - size * k, max(raw.total() - size, 1)
        s = sum(c * math.log((target[g] - c * k + smoothing) / ((raw[g] - c) * m / rest + smoothing)) for g, c in own.items())
        out.append(not failed and (s / size if size else 0.0) >= threshold)
    return out
