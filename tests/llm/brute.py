"""Plain versions of the operators, for small tables."""

import math
import re
import zlib
from collections import Counter

import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def stats(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w, t = words(text), text or ""
    counts = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if counts[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def licenses(text):
    """n_words, n_base, first_word, last_word, base_labels."""
    w = LICENSE_WORD.findall((text or "").translate(UPPER))
    found = []
    for label, phrase in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")):
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    places = [i for i, _ in found]
    return len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def license_matches(texts, templates, percent):
    """(labels, largest share) per text, from all alignments of all templates;
    words weigh by their document frequency in the texts."""
    split = [LICENSE_WORD.findall((t or "").translate(UPPER)) for t in texts]
    df = Counter(w for words in split for w in set(words))
    out = []
    for words in split:
        labels, best = set(), 0.0
        for t in templates:
            weight = {
                w: max(1, round(1e6 * math.log((len(texts) + 1) / (df[w] + 1)))) for w in t.words if w
            }
            total = sum(weight[w] for w in t.words if w)
            for at in range(-len(t.words), len(words)):
                same = {
                    p for p, w in enumerate(t.words) if w and 0 <= at + p < len(words) and words[at + p] == w
                }
                agreed = sum(weight[t.words[p]] for p in same)
                if 100 * agreed >= percent * total and same >= set(t.key_places):
                    labels.add(t.label)
                    best = max(best, agreed / total)
        out.append((labels, best))
    return out


def url(address, rules):
    """host, path, rule."""
    host = path = ""
    if address and "://" in address:
        rest = address.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group(0)
        path = re.match(r"[^?#]*", rest[len(host) :]).group(0)
        host = host.translate(UPPER)
    best = None
    for rule in rules:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            best = rule if best is None or len(rule) > len(best) else best
    return host, path, best


def simhash(text, k=3):
    w = words((text or "").translate(UPPER))
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    """Smallest member of the group of every node."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near(fingerprints, bits=3):
    fps = sorted(set(fingerprints))
    return [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= bits]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(old + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def kept_lines(docs):
    """docs: [(id, text)] with ids of their own; {id: numbers of lines that stay}."""
    lines = [((i, n), tuple(words(x))) for i, t in sorted(docs) for n, x in enumerate((t or "").split("\n")) if words(x)]
    first, stay = {}, {i: [] for i, _ in docs}
    for place, w in lines:
        if w not in first:
            first[w] = place
    for place, w in lines:
        gone = first[w] != place or len(w) >= 5 and any(
            p < place and len(v) >= 5 and abs(len(v) - len(w)) <= 1 and edits(v, w) <= 1 for v, p in first.items()
        )
        if not gone:
            stay[place[0]].append(place[1])
    return stay


def leaks(text, items, word, allowed):
    """[(item, start, words, distance)], the closest window of every item."""
    w, out = word(text), []
    for item, body in items:
        b = word(body)
        found = [(edits(w[s : s + len(b)], b), s) for s in range(len(w) - len(b) + 1)] if b else []
        if found and min(found)[0] <= allowed(len(b)):
            out.append((item, min(found)[1], len(b), min(found)[0]))
    return sorted(out)


def leaks_of_any_length(text, items, word, allowed):
    """As leaks, over windows of every length within the allowed edits."""
    w, out = word(text), []
    for item, body in items:
        b = word(body)
        most = allowed(len(b))
        found = [
            (edits(w[s : s + n], b), s, n)
            for n in range(len(b) - most, len(b) + most + 1) if b for s in range(len(w) - n + 1)
        ]
        if found and min(found)[0] <= most:
            out.append((item, min(found)[1], min(found)[2], min(found)[0]))
    return sorted(out)


def repeats(docs, size):
    """docs: [(id, bytes)]; [(id, bytes, removed, runs, rest)]."""
    least = {}
    for i, t in docs:
        for p in range(len(t) - size + 1):
            g = t[p : p + size]
            least[g] = min(i, least.get(g, i))
    out = []
    for i, t in docs:
        cut = [False] * len(t)
        for p in range(len(t) - size + 1):
            if least[t[p : p + size]] < i:
                cut[p : p + size] = [True] * size
        runs = sum(c and not (p and cut[p - 1]) for p, c in enumerate(cut))
        out.append((i, len(t), sum(cut), runs, bytes(b for b, c in zip(t, cut) if not c)))
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
