"""Plain Python versions of the operators, for small inputs."""

import bisect
import collections
import hashlib
import math
import re
import zlib

import regex
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def remainder(doc_id, divisor):
    return zlib.crc32(str(doc_id).encode()) % divisor


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


class Sets:
    """Union-find that names each set by its smallest member."""

    def __init__(self, members):
        self.up = {m: m for m in members}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


# Rules.


def rule_measures(text):
    ws = words(text)
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if words(line)]
    return {
        "n_words": len(ws),
        "word_chars": sum(map(len, ws)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_letters": sum((c.isascii() and c.isalpha()) or not c.isascii() for c in text or ""),
    }


# The quality classifier, text by text.


def quality_statistics(text):
    m, ws, data = rule_measures(text), words(lower(text)), (text or "").encode()
    n, chars, lines = max(m["n_words"], 1), max(m["word_chars"], 1), max(m["n_lines"], 1)
    share = lambda letters, of: math.sqrt(sum(b in letters for b in data) / of)
    return [
        math.log1p(m["n_words"]), math.log1p(m["word_chars"] / n), math.sqrt(m["n_symbols"] / n), math.sqrt(m["n_dup_lines"] / lines),
        math.sqrt(m["n_repeat_words"] / n), min(m["n_letters"] / chars, 1), math.log1p(m["n_lines"]), share(b"0123456789", chars),
        share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", chars), share(b".,;:!?", n), len(set(ws)) / n, sum(len(w.encode()) <= 3 for w in ws) / n,
        math.log1p(m["word_chars"] / lines),
    ]


def quality_scores(statistics, labels):
    """{id: statistics}, [(id, class)] of the rows to learn from -> {id: share of class 1}, by inverses and determinants."""
    import numpy as np

    of = [np.array([statistics[i] for i, y in labels if y == c]) for c in (0, 1)]
    spread = [np.cov(x.T, bias=True) for x in of]
    together = (len(of[0]) * spread[0] + len(of[1]) * spread[1]) / len(labels)
    shapes = []
    for x, own in zip(of, spread):
        mixed = 0.9 * own + 0.1 * together
        mixed = 0.9 * mixed + 0.1 * np.diag(np.diag(mixed)) + np.diag(1e-6 + 1e-3 * np.diag(together))
        shapes.append((x.mean(0), np.linalg.inv(mixed), math.log(len(x) / len(labels)) - 0.5 * np.linalg.slogdet(mixed)[1]))
    scores = {}
    for i, x in statistics.items():
        density = [c - 0.5 * (x - mean) @ inverse @ (x - mean) for mean, inverse, c in shapes]
        scores[i] = 1 / (1 + math.exp(min(700, max(-700, density[0] - density[1]))))
    return scores


# Personal data and secrets, as plain patterns.


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def plain_pii(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def strong_secrets(text):
    text = text or ""
    name = r"((?ai:password|passwd|secret|token|api_?key))"
    out = [
        ("assign", *m.span())
        for m in re.finditer(name + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6
    ]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    rank = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda s: (s[1], rank[s[0]]))


# Near duplicates.


def shingles(text, width):
    ws = words(lower(text))
    if len(ws) < width:
        return frozenset([tuple(ws)]) if ws else frozenset()
    return frozenset(tuple(ws[i : i + width]) for i in range(len(ws) - width + 1))


def near_components(texts, width, percent):
    """{id: text} -> {id: component}, from all pairs."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    out = Sets(sets)
    ids = [i for i in sorted(sets) if sets[i]]
    holders = collections.defaultdict(list)
    for i in ids:
        # A pair that reaches half or more shares a shingle; those that share none need no look.
        for j in {j for s in sets[i] for j in holders[s]}:
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                out.join(i, j)
        for s in sets[i]:
            holders[s].append(i)
    return {i: out.find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


# Lines.


def normal_line(line):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip(" ")


def simhash(line):
    ws = line.split(" ")
    ws = [w for i, w in enumerate(ws) if i < 5 or len(w) >= 4]
    hashes = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in ws]
    return sum(1 << b for b in range(60) if 2 * sum(h >> b & 1 for h in hashes) > len(ws))


def levenshtein(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        before = row
    return before[-1]


def removed_lines(texts, min_words=5, percent=80, distance=3):
    """{id: text} -> {id: set of line numbers}, and {id: numbers of lines that count}."""
    places, counted = collections.defaultdict(list), collections.defaultdict(set)
    for i in sorted(texts):
        for pos, line in enumerate((texts[i] or "").split("\n")):
            norm = normal_line(line)
            if len(norm.split(" ")) >= min_words:
                places[norm].append((i, pos))
                counted[i].add(pos)
    names = sorted(places)
    marks = {n: simhash(n) for n in names}
    sets = Sets(names)
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            longest = max(len(a), len(b))
            if (marks[a] ^ marks[b]).bit_count() <= distance and 100 * levenshtein(a, b) <= (100 - percent) * longest:
                sets.join(a, b)
    groups = collections.defaultdict(list)
    for n in names:
        groups[sets.find(n)] += places[n]
    gone = collections.defaultdict(set)
    for found in groups.values():
        for i, pos in sorted(found)[1:]:
            gone[i].add(pos)
    return gone, counted


def without_lines(text, gone):
    return "\n".join(line for pos, line in enumerate(text.split("\n")) if pos not in gone)


# Word counts of the language model's base.


def base_scores(texts, held_out):
    tokens = {i: words(lower(t)) + [None] for i, t in texts.items()}
    counts = collections.Counter(w for i, ws in tokens.items() if not held_out(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {
        i: (len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        for i, ws in tokens.items()
    }


# Mixing.


def share(budget, children):
    """Water-filling in whole tokens: children is {name: (capacity, weight)}."""
    out = {c: 0 for c in children}
    open_ = {c: cw for c, cw in children.items() if cw[1] > 0}
    left = min(budget, sum(c for c, _ in open_.values()))
    while open_:
        total = sum(w for _, w in open_.values())
        full = [c for c, (cap, w) in open_.items() if cap * total <= left * w]
        if not full:
            return out | {c: left * w // total for c, (_, w) in open_.items()}
        for c in full:
            out[c] = open_.pop(c)[0]
            left -= out[c]
    return out


def tree_budgets(leaves, budget, weights):
    """{path: capacity} -> {path: budget}, level by level."""
    depth = len(next(iter(leaves)))
    budgets = {(): min(budget, sum(leaves.values()))}
    for d in range(1, depth + 1):
        families = collections.defaultdict(dict)
        for path, capacity in leaves.items():
            had = families[path[: d - 1]].get(path[:d], (0, 0))[0]
            families[path[: d - 1]][path[:d]] = (had + capacity, weights.get(path[:d], 1))
        budgets = {c: b for parent, family in families.items() for c, b in share(budgets.get(parent, 0), family).items()}
    return budgets


def mixed(rows, budget, weights, epochs, seed):
    """[(doc_id, path, text)] -> [(doc_id, path, tokens, leaf budget, epochs, last tokens)]."""
    totals = collections.Counter()
    for _, path, text in rows:
        totals[path] += len(words(text))
    whole = int(budget * sum(totals.values())) if isinstance(budget, float) else budget
    budgets = tree_budgets({p: n * epochs for p, n in totals.items()}, whole, weights)
    order = collections.defaultdict(list)
    for doc_id, path, text in rows:
        full, rest = divmod(budgets[path], totals[path]) if totals[path] else (0, 0)
        md5 = hashlib.md5((text or "").encode()).hexdigest()
        place = hashlib.md5(f"{seed}|{full + 1}|{'' if doc_id is None else doc_id}|{md5}".encode()).hexdigest()
        order[path].append((place, doc_id, len(words(text)), full, rest))
    out = []
    for path, found in order.items():
        done = 0
        for _, doc_id, n, full, rest in sorted(found, key=lambda r: r[0]):
            out.append((doc_id, path, n, budgets[path], full, max(0, min(n, rest - done))))
            done += n
    return out


def best_fit(lengths, capacity):
    """Sequences that best fit by decreasing length needs."""
    room, n = [], 0
    for length in sorted(lengths, reverse=True):
        k = bisect.bisect_left(room, length)
        if k == len(room):
            n += 1
            left = capacity - length
        else:
            left = room.pop(k) - length
        bisect.insort(room, left)
    return n
