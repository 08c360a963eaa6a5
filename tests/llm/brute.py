"""The contracts by plain loops, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def letters(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(UP))


def sha(b):
    return hashlib.sha256(b).hexdigest()


def decontaminate(docs, items, length=13):
    windows = {}
    for i, t in items:
        w = letters(t)
        for k in range(max(1, len(w) - length + 1)) if w else []:
            windows.setdefault(tuple(w[k : k + length]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = letters(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        names = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(names), sha(",".join(names).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def base_scores(docs):
    toks = [(d, [*spaced((t or "").translate(UP)), None]) for d, t in docs]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in toks]
    c = Counter(w for h, (_, x) in zip(held, toks, strict=True) if not h for w in x)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)) for h, (d, x) in zip(held, toks, strict=True)]


def quality(docs):
    out = []
    for d, t in docs:
        w = spaced(t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if spaced(x)]
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)))
    return out


def licenses(docs, phrases):
    out = []
    for d, t in docs:
        w = letters(t)
        hits = [(k, x) for p, x in phrases for q in [p.split()] for k in range(len(w) - len(q) + 1) if w[k : k + len(q)] == q]
        out.append((d, len(w), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))))
    return out


def first_repeats(docs, window=100):
    """docs in order of doc_id."""
    seen, out = set(), []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if b[k : k + window] in seen:
                gone[k : k + window] = b"\1" * window
            seen.add(b[k : k + window])
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def all_repeats(docs, window=35):
    words = [(d, spaced(t)) for d, t in docs]
    n = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for d, w in words:
        gone = {j for k in range(len(w) - window + 1) if n[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        out.append((d, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone).encode())))
    return out


def fingerprint(t):
    w = spaced((t or "").translate(UP))
    shingles = [" ".join(w[j : j + 4]) for j in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps):
    """fps: (doc_id, fingerprint); the smallest doc_id that links of four bits or fewer reach."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(fps):
        r = find(i)
        ids = [x for x in (least.get(r), d) if x is not None]
        least[r] = min(ids) if ids else None
    return [(d, f, least[find(i)]) for i, (d, f) in enumerate(fps)]


def quality_measures(docs):
    """doc_id -> the five measures to three significant digits, for documents that pass the base rule."""
    out = {}
    for (d, t), (_, n, chars, symbols, dup, repeat, failed) in zip(docs, quality(docs), strict=True):
        if not failed:
            lines = max(1, len([x for x in (t or "").split("\n") if spaced(x)]))
            exact = {"symbols_per_word": symbols / n, "dup_line_share": dup / lines, "repeat_share": repeat / n, "word_length": chars / n, "word_shortness": -chars / n}
            unit = {r: 10.0 ** (math.floor(math.log10(abs(x))) - 2) if x else 1.0 for r, x in exact.items()}
            out[d] = {r: math.floor(x / unit[r]) * unit[r] for r, x in exact.items()}
    return out


def kept(docs, strata, labels, shares, risk, level):
    """doc_ids that pass the base rule and the certified cutoffs. strata: doc_id -> stratum; labels: (doc_id, quality, toxic)."""
    scores = quality_measures(docs)
    label = {d: (q, t) for d, q, t in labels}
    limits = {}
    names = sorted({strata[d] for d in scores})
    for s in names:
        own = [d for d in scores if strata[d] == s]
        plain = [d for d in own if d not in label]
        cands = set()
        for r in next(iter(scores.values())):
            xs = [scores[d][r] for d in plain]
            for q in shares:
                fits = [x for x in set(xs) if sum(y > x for y in xs) <= q * len(xs)]
                cands |= {(r, min(fits))} if fits else set()
        half = lambda d: zlib.crc32(str(d).encode()) % 3 == 0
        good = [d for d in own if label.get(d) == (1, 0)]
        bad = [d for d in own if d in label and label[d][0] == 0]
        lost = lambda r, c: sum(half(d) and scores[d][r] > c for d in good)
        found = lambda r, c: sum(half(d) and scores[d][r] > c for d in bad)
        test = [d for d in good if not half(d)]
        chosen = []
        for r, c in sorted(cands, key=lambda x: (lost(*x), -found(*x), x[0], -x[1])):
            k = sum(any(scores[d][r2] > c2 for r2, c2 in [*chosen, (r, c)]) for d in test)
            n = len(test)
            p = sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1)) if n and k < n * risk else 1.0
            if p > level / len(names):
                break
            chosen.append((r, c))
        limits[s] = chosen
    return {d for d, x in scores.items() if not any(x[r] > c for r, c in limits[strata[d]])}


def tree_scores(docs, depth, context, symbol, transition, prior):
    """log10 probabilities of all texts by a suffix tree that is held in dictionaries."""
    toks = [(d, [*spaced((t or "").translate(UP)), None]) for d, t in docs]
    train = [x for d, x in toks if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1]
    c = Counter(w for x in train for w in x)
    n, floor = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    symbols = {w for w in c if c[w] >= symbol * n}
    state, edge, beta = {(): ()}, {}, {}  # state: context -> the retained context that stands for it

    def root(w):
        return (c[w] + 0.5) / floor

    def longest(s):
        while s and s not in beta:
            s = s[1:]
        return s

    def prob(s, w):
        s = longest(s)
        if not s:
            return root(w)
        return edge[s, w] if (s, w) in edge else beta[s] * prob(s[1:], w)

    count = {(w,): c[w] for w in symbols if w is not None and c[w] >= context * n}
    known = {()}
    known_all = set()
    for level in range(1, depth + 1):
        count = {s: k for s, k in count.items() if s[1:] in known}
        known = set(count)
        known_all |= known
        after = Counter((tuple(x[i - level : i]), x[i]) for x in train for i in range(level, len(x)) if tuple(x[i - level : i]) in known and x[i] in symbols)
        after = {k: v for k, v in after.items() if v >= transition * n}
        by = {s: [] for s in known}
        for (s, w), k in after.items():
            by[s].append((w, k))
        new = {}
        for s, ws in by.items():
            p = {w: prob(s[1:], w) for w, _ in ws}
            rest, rest_p = count[s] - sum(k for _, k in ws), max(1 - sum(p.values()), 1e-12)
            gain = sum(k * math.log(k / (count[s] * p[w])) for w, k in ws) + (rest * math.log(max(rest, 1) / (count[s] * rest_p)) if rest > 0 else 0)
            if gain > len(ws) * math.log(len(symbols) + 1) + 0.5 * math.log(max(count[s], 1)):
                smooth = {w: (k + prior * p[w]) / (count[s] + prior) for w, k in ws}
                new[s] = smooth, max(1 - sum(smooth.values()), 1e-12) / max(1 - sum(p.values()), 1e-12)
        for s, (smooth, b) in new.items():
            beta[s] = b
            edge.update({(s, w): v for w, v in smooth.items()})
        count = {(*s, w): k for (s, w), k in after.items() if k >= context * n and w is not None}
    out = []
    for d, x in toks:
        total = 0.0
        for i, w in enumerate(x):
            s = ()
            for k in range(1, depth + 1):
                if k <= i and tuple(x[i - k : i]) in known_all:
                    s = tuple(x[i - k : i])
                else:
                    break
            total += math.log10(prob(s, w))
        out.append((d, total))
    return out, len(beta)
