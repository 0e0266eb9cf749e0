"""Plain versions of the text operators, on lists of (doc_id, text)."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from hashlib import sha256

sha = lambda b: sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def decontaminate(docs, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").translate(LOWER))
    index = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            index[tuple(w[j : j + n])].add(i)
    sizes = {len(x) for x in index}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (g := tuple(w[j : j + n])) in index:
                    hit |= set(range(j, j + n))
                    found |= index[g]
        found -= {None}
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def substrings(docs, window=35):
    all_ = [SPACED.findall(t or "") for _, t in docs]
    n = Counter(tuple(w[j : j + window]) for w in all_ for j in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(docs, all_, strict=True):
        gone = {p for j in range(len(w) - window + 1) if n[tuple(w[j : j + window])] > 1 for p in range(j, j + window)}
        out.append((d, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def suffixes(docs, window=100):
    first = {}
    for d, t in sorted(((d, (t or "").encode()) for d, t in docs), key=lambda x: x[0]):
        for j in range(len(t) - window + 1):
            first.setdefault(t[j : j + window], (d, j))
    out = []
    for d, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for j in range(len(raw) - window + 1):
            if first[raw[j : j + window]] != (d, j):
                gone[j : j + window] = b"\1" * window
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(raw), sum(gone), spans, sha(kept)))
    return out


def shingles(t, size=5):
    w = SPACED.findall((t or "").translate(LOWER))
    return {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()


def jaccard(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, u in sets[:i]:
            if s and u and 100 * len(s & u) >= 80 * len(s | u):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(d, len(s), find(d)) for d, s in sets]


def quality(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w = SPACED.findall(t)
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        n = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        rep = len({p for j in range(len(w) - 7) if n[tuple(w[j : j + 8])] > 1 for p in range(j, j + 8)})
        base = len(w) < 20 or 100 * rep > 30 * len(w)
        chars, symbols, dup = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
        upper, letters = sum(c.isupper() for c in t), sum(c.isalpha() for c in t)
        bad = 10 * symbols > len(w) or 100 * dup > 40 * len(lines) or not 2 * len(w) <= chars <= 14 * len(w) or 2 * upper > letters or 2 * t.count("!") > len(w) or 4 * sum(a == b for a, b in zip(w, w[1:])) > len(w)
        out.append((d, len(w), chars, symbols, dup, rep, base, not (base or bad)))
    return out


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


def language(model, text, rounds=12, penalty=4.0, least=0.05):
    """Proportions and score by plain loops over the text's trigrams one by one."""
    import math

    from sparkloom.llm.language import trigrams

    seen = [int(b) for b in trigrams(text)]
    like = [[float(model.likelihood[b][i]) for i in range(len(model.languages))] for b in seen]

    def mix(who):
        share = dict.fromkeys(who, 1 / len(who))
        for _ in range(rounds):
            got = dict.fromkeys(who, 0.0)
            for row in like:
                total = sum(share[i] * row[i] for i in who)
                for i in who:
                    got[i] += share[i] * row[i] / total
            share = {i: got[i] / len(seen) for i in who}
        return share, sum(math.log(sum(share[i] * row[i] for i in who)) for row in like)

    everyone = range(len(model.languages))
    alone = [sum(math.log(row[i]) for row in like) for i in everyone]
    cost = penalty * math.log(len(seen) + 1)
    share, _ = mix(list(everyone))
    chosen = [max(everyone, key=lambda i: (alone[i], -i))]
    value, best = {chosen[0]: 1.0}, alone[chosen[0]]
    for i in sorted(everyone, key=lambda i: (-share[i], i)):
        if i in chosen:
            continue
        if share[i] < least:
            break
        more, score = mix([*chosen, i])
        if score - best <= cost:
            break
        chosen, value, best = [*chosen, i], more, score
    order = sorted(chosen, key=lambda i: (-value[i], model.languages[i]))
    against = [alone[i] for i in everyone if i != order[0]]
    if order[1:]:
        against.append(mix(order[1:])[1] - cost * (len(order) - 2))
    margin = best - cost * (len(order) - 1) - max(against)
    return [(model.languages[i], value[i]) for i in order], value[order[0]] / (1 + math.exp(-max(-700, min(700, margin))))
