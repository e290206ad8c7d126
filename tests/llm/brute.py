"""Plain restatements of the text operators for small inputs."""

import hashlib
import re
import zlib


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())


def shingles(text, n=2):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(docs, n=2):
    """doc_id -> (n_shingles, component_id) from (doc_id, text), all pairs."""
    sets = [(i, shingles(t, n)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * min(len(s), len(t)) >= 80 * max(len(s), len(t)) and 100 * len(s & t) >= 80 * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def secret_spans(text):
    found = []
    keyword = "|".join("".join(f"[{c.lower()}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token"))
    keyword += "|[aA][pP][iI]_?[kK][eE][yY]"
    for m in re.finditer(rf"""({keyword})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, "assign", m.end()))
    for no, kind, pattern, least in ((1, "access", "AKIA[A-Z0-9]+", 16), (2, "hex", "[0-9a-f]+", 32)):
        found += [(m.start(), no, kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def leaks(docs, items, n=5, least=0.8):
    """(doc_id, item_id) -> best weighted similarity of item-sized windows laid where a shared shingle puts the item."""

    def normal(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    def grams(w):
        return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]

    def weight(gs):
        return sum(min(255, sum(map(len, g))) for g in gs)

    best = {}
    for i, t in docs:
        w = normal(t)
        for k, item in items:
            v = normal(item)
            places = {g: p for p, g in reversed(list(enumerate(grams(v))))}
            a = set(places)
            for start in {max(0, p - places[g]) for p, g in enumerate(grams(w)) if g in places}:
                b = set(grams(w[start : start + len(v)]))
                if (s := weight(a & b) / weight(a | b)) >= least:
                    best[i, k] = max(best.get((i, k), 0.0), s)
    return best


def token_ids(text, end=None):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return tokenizer.encode(text or "", add_special_tokens=False).ids + ([] if end is None else [end])


def ids_crc32(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def merkle_levels(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        level = levels[-1]
        levels.append([sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)])
    return levels


def merkle(rows):
    """rows: (doc_id, source, leaf) -> [(doc_id, source, leaf, subroot, root, siblings of the whole way)]."""
    by_source = {}
    for doc_id, source, leaf in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        by_source.setdefault(source, []).append((doc_id, leaf))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: merkle_levels([leaf for _, leaf in by_source[s]]) for s in order}
    top = merkle_levels([trees[s][-1][0] for s in order])

    def way(levels, place):
        siblings = []
        for level in levels[:-1]:
            first = place - place % 3
            siblings += level[first:place] + level[place + 1 : first + 3]
            place //= 3
        return siblings

    out = []
    for k, s in enumerate(order):
        for place, (doc_id, leaf) in enumerate(by_source[s]):
            out.append((doc_id, s, leaf, trees[s][-1][0], top[-1][0], "".join(way(trees[s], place) + way(top, k))))
    return out


def codes(rows, parts, entries, rounds):
    """rows: (vec_id, [int]) in order of vec_id -> ([code], [error], books) by plain integers."""
    width = len(rows[0][1]) // parts
    cut = [[v[p * width : p * width + width] for p in range(parts)] for _, v in rows]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def best(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, entry, strict=True)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = [best(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                own = [c[p] for c, m in zip(cut, mine, strict=True) if m == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [[best(c[p], books[p]) for p in range(parts)] for c in cut]
    return ["".join(f"{e:02x}" for _, e in f) for f in found], [sum(d for d, _ in f) for f in found], books
