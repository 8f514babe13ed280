"""Plain single-machine versions of the operators, for comparison."""

import hashlib
import math
import re
import zlib

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {65 + i: 97 + i for i in range(26)}


def fold(text):
    return text.translate(FOLD)


def shingle_set(text):
    words = SPACE.findall(fold(text or ""))
    if not words:
        return frozenset()
    width = min(5, len(words))
    return frozenset(tuple(words[i: i + width]) for i in range(len(words) - width + 1))


def jaccard(rows):
    """{doc_id: (n_shingles, component_id, n_links)} of (doc_id, text) rows with ids of their own."""
    sets = {i: shingle_set(t) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    part = {i: i for i in sets}

    def root(i):
        while part[i] != i:
            part[i] = part[part[i]]
            i = part[i]
        return i

    links = dict.fromkeys(sets, 0)
    for i, s in sets.items():
        both = {}
        for x in s:
            for j in holders[x]:
                both[j] = both.get(j, 0) + 1
        for j, n in both.items():
            if j != i and 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                a, b = root(i), root(j)
                part[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), links[i]) for i in sets}


def contamination(docs, items):
    """{doc_id: (n_words, n_hit, n_items, sha256 of the items, contaminated)}."""
    windows = {}
    for item, text in items:
        words = ALNUM.findall(fold(text or ""))
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            windows.setdefault(tuple(words[i: i + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        words = ALNUM.findall(fold(text or ""))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                key = tuple(words[i: i + n])
                if key in windows:
                    hit.update(range(i, i + n))
                    found |= windows[key]
        listed = ",".join(sorted(str(x) for x in found if x is not None))
        n_items = len({x for x in found if x is not None})
        out[doc] = (len(words), len(hit), n_items, hashlib.sha256(listed.encode()).hexdigest(), bool(hit))
    return out


def edits(rows):
    """{doc_id: (n_chars, sha256 of the edited text)} of (doc_id, text) rows in order."""
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest())
    return out


def surface(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) by plain loops."""
    words = SPACE.findall(text or "")
    windows = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if SPACE.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dups, len(repeated)


def ngrams(text, orders):
    words = ALNUM.findall(fold(text or ""))
    return [" ".join(words[i: i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1)]


def resampled(rows, target, orders=1, buckets=10_000, min_words=20, percent=10, seed="2024"):
    """[(doc_id, n_features, weight, score, rank)] in order of (doc_id, weight)."""
    def places(text):
        return [zlib.crc32(g.encode()) % buckets for g in ngrams(text, orders)]

    s, t = [0] * buckets, [0] * buckets
    for _, text in rows:
        for b in places(text):
            s[b] += 1
    for text in target:
        for b in places(text):
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        found = places(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None, len(ALNUM.findall(fold(text or "")))])
    drawable = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(drawable[: percent * len(drawable) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def one_edit(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def spellings(rows, min_length=7, min_count=2, ratio=10, slip=31):
    """{word: (n, n_near, form, form_n, root)} by comparing all pairs."""
    counts = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = fold(run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % slip == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1:]
            counts[word] = counts.get(word, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    out = {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        out[w] = (n, len(near), form, words.get(form))

    def root(w):
        return w if out[w][2] is None else root(out[w][2])

    return {w: (*r, root(w)) for w, r in out.items()}


def toxic_evidence(rows, prefixes=(3, 5, 7, 9, 12), discount=0.75, prior=5.0, threshold=12.0):
    """{prefix: log ratio of its chances in toxic and ordinary texts} of (text, label or None), by dictionaries."""
    parent, held = {}, ({}, {})
    for text, label in rows:
        mine = set()
        for word in ALNUM.findall(fold(text or "")):
            body, up = word.encode(), b""
            for size in (*prefixes, len(body)):
                node = body[:size]
                if node != up:
                    parent[node] = up
                    mine.add(node)
                up = node
        if label is not None:
            for node in mine:
                held[label][node] = held[label].get(node, 0) + 1
    children = {}
    for node, up in parent.items():
        children.setdefault(up, []).append(node)

    def width(node):
        return 1 + len(children.get(node, []))

    def count(c, node):
        return held[c].get(node, 0) if node else sum(held[c].get(x, 0) for x in children[b""])

    out = {}
    for node, up in parent.items():
        if not count(0, node) + count(1, node):
            continue
        share = width(node) / sum(map(width, children[up]))
        mine, of = [count(c, node) for c in (0, 1)], [count(c, up) for c in (0, 1)]
        types = [sum(x in held[c] for x in children[up]) for c in (0, 1)]
        chance = [
            (max(mine[c] - discount, 0) + (discount * types[c] + prior) * share) / (of[c] + prior) for c in (0, 1)
        ]
        toxic = (of[1] + 0.5) / (of[0] + of[1] + 1)
        g = 2 * sum(n * math.log(n / (sum(mine) * e)) for n, e in zip(mine, (1 - toxic, toxic)) if n)
        if g >= threshold:
            out[node] = math.log(chance[1] / chance[0])
    return out
