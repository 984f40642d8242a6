"""Plain versions of the operators' contracts, one text or table at a time."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log10

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ("email", "ip", "card", "phone")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def exact(rows):
    """[(doc_id, text)] with unique ids -> {doc_id: (keep_id, group_size, kept, sha)}."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), min(g)[1] == i, sha(n)) for n, g in groups.items() for _, i in g}


def shingles(text):
    w = WORD.findall(low(text))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near(rows):
    sets = {i: shingles(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def private(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text or ""):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text or ""):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text or ""):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text or ""):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


def language(rows):
    """[(doc_id, text)] -> {doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}."""
    tokens = {i: [*WORD.findall(low(t)), "\n"] for i, t in rows}
    c = Counter(w for i, t in tokens.items() if crc(i) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    return {i: (crc(i) % 7 == 2, len(t), sum(c[w] > 0 for w in t), n, sum(log10((c[w] + 1) / (n + v + 1)) for w in t)) for i, t in tokens.items()}


def conversations(rows):
    """[(conv_id, turn, role, text)] -> {conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)}."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(said), sha(said))
    return out


def water(sizes, share=1.5, cap=2.0, weights=(3, 1, 2)):
    """{source: size} -> {source: target}; None is the last source."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > cap * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out
