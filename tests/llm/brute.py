"""Plain one-machine versions of the operators, for comparison on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, deque

LOWER = {i: i + 32 for i in range(65, 91)}


def lower(text):
    return (text or "").translate(LOWER)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def pii(text):
    """(kind, start, end) of the base kinds."""
    t = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def contamination(texts, items, window=10):
    """texts, items: {id: text}; -> {id: (n_words, n_hit, item ids)}."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for i, t in items.items():
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(i)
    sizes = sorted({len(k) for k in windows})
    out = {}
    for i, t in texts.items():
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                got = windows.get(tuple(w[k:k + n]))
                if got:
                    hit.update(range(k, k + n))
                    found |= got
        out[i] = (len(w), len(hit), sorted(found))
    return out


def shingles(text, width=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(text)) if x]
    if not w:
        return set()
    return {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))}


def jaccard_components(texts, theta=90, width=3):
    """{id: text} -> {id: (set size, smallest reachable id)}; all pairs."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_size = sorted((i for i in ids if sets[i]), key=lambda i: len(sets[i]))
    for x, a in enumerate(by_size):
        for b in by_size[x + 1:]:
            if 100 * len(sets[a]) < theta * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if 100 * both >= theta * (len(sets[a]) + len(sets[b]) - both):
                r = sorted((root(a), root(b)))
                parent[r[1]] = r[0]
    return {i: (len(sets[i]), root(i)) for i in ids}


def base_scores(texts):
    """{id: text} -> {id: (tokens, known, N, base score)}, learning from class != 1."""
    end = object()
    docs = {i: [x for x in re.split(r"[\x20\x09-\x0D]+", lower(t)) if x] + [end] for i, t in texts.items()}
    counts = Counter()
    for i, w in docs.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    return {i: (len(w), sum(1 for x in w if counts[x]), n,
                sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for i, w in docs.items()}


def bigram_counts(texts):
    """Training counts of (previous, current) with None before the first and at the end."""
    pairs, words, starts = Counter(), Counter(), 0
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 == 1:
            continue
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(t)) if x] + ["\0end"]
        starts += 1
        words.update(w)
        pairs.update(zip(["\0start", *w], w))
    words["\0start"] = starts
    return pairs, words


def ring_shards(rows, n_shards, owners, grid_bits, quota):
    """rows: (id, text); residents first in ring order, then the overflow clockwise."""
    points = sorted(owners)

    def home(i):
        cell = int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:13], 16) >> (52 - grid_bits)
        return next((p for p in points if p >= cell), points[0])

    order = sorted(rows, key=lambda r: (int(hashlib.md5(str(r[0]).encode()).hexdigest()[:13], 16)))
    # an arc that wraps round the origin begins with the highest positions
    arcs = {p: [] for p in points}
    wrapped = {p: [] for p in points}
    for r in order:
        pos = int(hashlib.md5(str(r[0]).encode()).hexdigest()[:13], 16)
        p = home(r[0])
        (wrapped if (pos >> (52 - grid_bits)) > p else arcs)[p].append(r[0])
    used, where, queue, left = [0] * n_shards, {}, deque(), {}
    for p in points:
        for i in wrapped[p] + arcs[p]:
            if used[owners[p]] < quota[owners[p]]:
                where[i] = owners[p]
                used[owners[p]] += 1
            else:
                left.setdefault(p, []).append(i)
    for lap in range(2):
        for p in points:
            while queue and used[owners[p]] < quota[owners[p]]:
                where[queue.popleft()] = owners[p]
                used[owners[p]] += 1
            if lap == 0:
                queue.extend(left.get(p, []))
    return where


def resampled(texts, target, buckets=10_000, percent=25, least=20, seed=7):
    """[(id, text)], [text] -> [(id, n_features, weight, score, rank)], in any order."""
    def runs(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        return len(w), [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    docs = [(i, *runs(t)) for i, t in texts]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in target for b in runs(x)[1])
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in s}
    out = []
    for i, n, f in docs:
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def merkle(rows, changed):
    """rows: (doc_id, source, lang, n_chars, text) -> [(id, leaf, subroot, root, proof, folded, verified)];
    ``changed(row)`` is the row as found later."""
    def leaf(row):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def tree(digests):
        """(root, [siblings of each digest: (left, right) a level])."""
        paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
        while len(level) > 1:
            for p, i in zip(paths, at):
                p.append((level[i - 1], "") if i % 2 else ("", level[i + 1] if i + 1 < len(level) else ""))
            at = [i // 2 for i in at]
            level = [sha(*level[i:i + 2]) for i in range(0, len(level), 2)]
        return (level or [None])[0], paths

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is None, r[0] or 0, leaf(r)))
        trees[k] = tree([leaf(r) for r in groups[k]])
    root, tops = tree([trees[k][0] for k in keys])
    out = []
    for k, top in zip(keys, tops):
        for row, path in zip(groups[k], trees[k][1]):
            node = leaf(changed(row))
            for left, right in path + top:
                node = sha(left, node, right)
            out.append((row[0], leaf(row), trees[k][0], root, sha(*(x + y for x, y in path + top)), node, node == root))
    return out


def simhash(texts, width=3, distance=2):
    """{id: text} -> {id: (fingerprint, smallest reachable id)}; all pairs, bit by bit."""
    import xxhash

    prints = {}
    for i, t in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(t)) if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[k:k + width]).encode(), 42) for k in range(max(1, len(w) - width + 1))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids, parent = sorted(prints), {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                r = sorted((root(a), root(b)))
                parent[r[1]] = r[0]
    return {i: (f"{prints[i]:016x}", root(i)) for i in ids}
