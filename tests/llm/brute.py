"""Plain versions of the operators' results, for comparison."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log10

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return [w for w in SPACES.split(low(text)) if w]


def shingles(text, width=5):
    w = words(text)
    if len(w) >= width:
        return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1))
    return frozenset([tuple(w)] if w else [])


def components(docs, similar=80):
    """id -> (shingles, smallest id reachable), comparing every two distinct sets."""
    sets = {i: shingles(t) for i, t in docs}
    groups = defaultdict(list)
    for i, s in sets.items():
        if s:
            groups[s].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def tie(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    for g in groups.values():
        for i in g:
            tie(g[0], i)
    distinct = [(min(g), s) for s, g in groups.items()]
    for n, (a, s) in enumerate(distinct):
        for b, t in distinct[:n]:
            if 100 * min(len(s), len(t)) >= similar * max(len(s), len(t)):
                same = len(s & t)
                if 100 * same >= similar * (len(s) + len(t) - same):
                    tie(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def unigram_scores(docs):
    tokens = {i: [*words(t), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(ws), sum(counts[w] > 0 for w in ws), n,
                sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in tokens.items()}


def dice_matches(text, template, threshold):
    """Whether any stretch of words of the text reaches the threshold, comparing all of them."""
    def bag(ws):
        return Counter(zip(ws, ws[1:]))

    norm = [w.lower() for w in re.findall(r"[^\W_]+(?:[.'’-][^\W_]+)*", text)]
    want = bag([w.lower() for w in re.findall(r"[^\W_]+(?:[.'’-][^\W_]+)*", template)])
    n, best = sum(want.values()), 0.0
    for a in range(len(norm)):
        for b in range(a + 2, min(len(norm), a + 2 * n + 4) + 1):
            have = bag(norm[a:b])
            best = max(best, 2 * sum((have & want).values()) / (n + b - a - 1))
    return best >= threshold


def trie(turns, group=20, openings=4):
    """Rows of the prefix trie of (conv_id, turn, role, text), node by node."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    members, ended = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % openings
        path = tuple(own.get(int(c / group) * group, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ended[path].append(c)
    out = set()
    for node, m in members.items():
        below = [x for x in members if x[:len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[:len(x)] == x and len(y) == len(x) + 1 for y in below)]
        saved = sum((len(members[x]) - 1) * len([w for w in SPACES.split(x[-1][1]) if w]) for x in below if x)
        ids = ",".join(map(str, sorted(ended.get(node, []))))
        out.add((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children), len(leaves),
                 saved, hashlib.sha256(ids.encode()).hexdigest()))
    return out


def secrets(text):
    """Base spans (kind, start, end) by start, then kind."""
    found = []
    assign = r"(password|passwd|secret|token|api_?key)"
    assign = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in assign)
    patterns = [(assign + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
                (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16)]
    for k, (pattern, group, least) in enumerate(patterns):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def spelling(docs, every=31):
    """word -> (form, root, n, n_near, form_n), every word against all others by their deletions."""
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text):
            run = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % every == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    by_gap = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            by_gap[i, w[:i] + w[i + 1:]].add(w)
    near = {w: set() for w in counts}
    for (i, rest), group in by_gap.items():
        for w in group:
            near[w] |= group - {w}
            if rest in counts:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w, ts in near.items():
        best = min(ts, key=lambda t: (-counts[t], t), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}
