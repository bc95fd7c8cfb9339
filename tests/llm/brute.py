"""Plain versions of the operators, straight from what they promise."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

LOWER = {c: c + 32 for c in range(65, 91)}
SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact(docs):
    """docs: (id, text) with distinct ids."""
    groups = defaultdict(list)
    for i, t in docs:
        groups[(t or "").translate(LOWER)].append(i)
    return {i: (max(ids), len(ids), i == max(ids), sha(t)) for t, ids in groups.items() for i in ids}


def contamination(docs, items):
    windows = defaultdict(set)
    for item, t in items:
        w = tuple(ALNUM.findall((t or "").translate(LOWER)))
        for s in range(max(1, len(w) - 12) if w else 0):
            windows[w[s : s + 13]].add(str(item))
    out = {}
    for i, t in docs:
        w = tuple(ALNUM.findall((t or "").translate(LOWER)))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if w[s : s + n] in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[w[s : s + n]]
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def substring(docs):
    first = {}
    words = {i: SPACED.findall(t or "") for i, t in docs}
    for i, w in words.items():
        for s in range(len(w) - 12):
            key = tuple(w[s : s + 13])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = {p for s in range(len(w) - 12) if first[tuple(w[s : s + 13])] < i for p in range(s, s + 13)}
        out[i] = (len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def shingles(text):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[s : s + 5]) for s in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


VERDICTS = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def url_rule(url):
    """Host, path and the longest rule that fits."""
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = host.translate(LOWER)
    rules = {"net/": "net", "example.net/en/": "example.net", "example.com/de/": "example.com", "org/fr/": "org"}
    fits = [r for r, h in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    return host, path, max(fits, key=len, default=None)


_KINDS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    ("access", "(AKIA[A-Z0-9]+)()", 18),
    ("hex", "([0-9a-f]+)()", 16),
)


def secrets(text):
    """Base matches: (start, rank of the kind, end, kind), in order."""
    return sorted(
        (m.start(), k, m.end(), kind)
        for k, (kind, p, least) in enumerate(_KINDS)
        for m in re.finditer(p, text)
        if len(m[2] if kind == "assign" else m[0]) >= least
    )


def base_scores(docs):
    import math

    words = {i: [*SPACED.findall((t or "").translate(LOWER)), None] for i, t in docs}
    held_out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    count = Counter(w for i, ws in words.items() if not held_out[i] for w in ws)
    n, v = sum(count.values()), len(count)
    return {
        i: (held_out[i], len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws))
        for i, ws in words.items()
    }


class Ppm:
    """Prediction by partial matching with escapes of method C and exclusion, over symbol lists."""

    def __init__(self, sequences, order, symbols):
        self.order, self.symbols, self.tree = order, symbols, defaultdict(Counter)
        for s in sequences:
            z = [0] * order + s + [0]
            for i in range(order, len(z)):
                for k in range(order + 1):
                    self.tree[tuple(z[i - k : i])][z[i]] += 1

    def log10(self, sequence):
        import math

        z, total = [0] * self.order + sequence + [0], 0.0
        for i in range(self.order, len(z)):
            left, ruled_out = 1.0, set()
            for k in range(self.order, -1, -1):
                seen = self.tree.get(tuple(z[i - k : i]), {})
                open_ = {s: n for s, n in seen.items() if s not in ruled_out}
                size = sum(open_.values()) + len(open_)
                if z[i] in open_:
                    total += math.log10(left * open_[z[i]] / size)
                    break
                if open_:
                    left *= len(open_) / size
                ruled_out |= set(seen)
            else:
                total += math.log10(left / (self.symbols - len(ruled_out)))
        return total
