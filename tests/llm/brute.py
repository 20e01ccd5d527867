"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def decontaminate(docs, items, span=10):
    """docs: (doc_id, text); items: (item_id, text). -> (doc_id, n_words, n_hit, sorted item ids)."""
    windows = defaultdict(set)
    for item, text in items:
        words = WORD.findall(lower(text))
        n = min(span, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words = WORD.findall(lower(text))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w]
        out.append((doc, len(words), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def revisits(pages):
    """(page_id, html) -> (page_id, bytes, digest, type, refers_to)."""
    least = {}
    for page, html in pages:
        if page is not None:
            least[html or ""] = min(page, least.get(html or "", page))
    out = []
    for page, html in pages:
        body = (html or "").encode()
        refers = least.get(html or "") if page is not None and page > least[html or ""] else None
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if refers is None else "revisit", refers))
    return out


def strip_repeats(docs, window=35):
    """(doc_id, text) -> (doc_id, n_words, n_removed, kept text)."""
    words = [PLAIN.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def simhash(text):
    words = PLAIN.findall(lower(text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=2):
    """(doc_id, fingerprint) -> component id by row."""
    n = len(prints)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(n)]


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """{source: size} -> {source: target}."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, open_, fixed = share * sum(sizes.values()), set(order), {}
    while open_:
        left = total - sum(fixed.values())
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > cap * sizes[s]}
        if not over:
            fixed |= {s: weight[s] * level for s in open_}
            break
        fixed |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return fixed


def draw(doc, text, seed="mix-1"):
    own = f"{'null' if doc is None else doc}:{hashlib.md5((text or '').encode()).hexdigest()}"
    return int(hashlib.md5(f"{seed}:{own}".encode()).hexdigest()[:8], 16) / 2**32


def hilbert(axes, bits=8):
    """Skilling's transposition, step by step."""
    x, n = list(axes), len(axes)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return sum((x[i] >> b & 1) << (b * n + n - 1 - i) for b in range(bits) for i in range(n))


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 3 == 1


def language(model, text):
    """Language and its probability of a text under a trained model, n-gram by n-gram."""
    if not any(map(str.isalpha, text or "")):
        return "und", 0.0
    body = b" " + re.sub(rb"[\x09-\x0d]", b" ", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())) + b" "
    sums, n = [0.0] * len(model.languages), 0
    for order in (3, 4):
        for i in range(len(body) - order + 1):
            gram = body[i : i + order]
            if 32 in gram[1:-1]:
                continue
            code = 0
            for byte in gram:
                code = (code * 0x01000193 & 0xFFFFFFFF) ^ byte
            bucket = (code * 0x9E3779B1 + order & 0xFFFFFFFF) >> 18
            sums = [a + float(b) for a, b in zip(sums, model.table[bucket], strict=True)]
            n += 1
    logits = [(a / max(1, n) + float(b)) / model.temperature for a, b in zip(sums, model.bias, strict=True)]
    powers = [math.exp(x - max(logits)) for x in logits]
    best = max(range(len(powers)), key=powers.__getitem__)
    return model.languages[best], powers[best] / sum(powers)


def quality(model, text):
    """Tail probabilities of a text under a trained model, feature by feature."""
    text = text or ""
    share = lambda x, n=10: min(n, int(x * n + 0.5))
    words, marks = text.split(), ".,;:!?\"'()[]{}<>#*%$&|=-_~`^+/\\"
    names = {w.strip(marks) for w in text.lower().split()}
    letters = sum(c.isascii() and c.isalpha() or "À" <= c <= "ɏ" for c in text)
    upper = sum("A" <= c <= "Z" or "À" <= c <= "Þ" for c in text)
    bins = {
        "n": len(words).bit_length(),
        "r": share(sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / max(1, len(words) - 1)),
        "u": share(upper / max(1, letters)),
        "s": share(sum(c in "#*%$&|=~^<>{}[]\\!" for c in text) / max(1, len(text)), 50),
        "d": share(len(set(words)) / max(1, len(words))),
        "l": share(len(set(text.split("\n"))) / len(text.split("\n"))),
        "b": share(words.count("|") / max(1, len(words)), 20),
        "t": share(sum(len(w) for w in names) / max(1, len(names)) / 40),
    }
    names |= {f"\x00{k}{v}" for k, v in bins.items()}
    names.discard("")
    codes = {zlib.crc32(w.encode()) % 2**18 for w in names} | {zlib.crc32(w[:k].encode(), 1) % 2**18 for w in names for k in (4, 5, 6, 7) if len(w) > k}
    total = sum(float(model.weights[c]) for c in codes)
    return [1 / (1 + math.exp(float(t) - total)) for t in model.thresholds]


def near_copies(texts, size=5, part=4, whole=5):
    """For each text the number of its component: texts of Jaccard similarity part / whole or more over word shingles are linked."""
    sets, by = [], defaultdict(list)
    for i, text in enumerate(texts):
        words = PLAIN.findall(lower(text))
        sets.append({tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))})
        for gram in sets[-1]:
            by[gram].append(i)
    shared = Counter((i, j) for group in by.values() for a, i in enumerate(group) for j in group[a + 1 :])
    label = list(range(len(texts)))
    for (i, j), n in shared.items():
        if whole * n >= part * (len(sets[i]) + len(sets[j]) - n) and label[i] != label[j]:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if k == old else k for k in label]
    return label


def one_of_each(rows):
    """Of (doc_id, text, ...) rows the one that stays of each component: least id (null last); the text decides among equals."""
    out = {}
    for row, k in zip(rows, near_copies([r[1] for r in rows]), strict=True):
        if k not in out or (row[0] is None, row[0] or 0) < (out[k][0] is None, out[k][0] or 0):
            out[k] = row
    return list(out.values())


def mix(rows, weights=(5, 2, 1)):
    """(doc_id, text, lang, source, ...) rows as often as the mix takes them."""
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(PLAIN.findall(r[1] or ""))
    goal, out = targets(sizes, weights), []
    for r in rows:
        rate = goal[r[3]] / sizes[r[3]] if sizes[r[3]] else 0.0
        out += [r] * (math.floor(rate) + (draw(r[0], r[1]) < rate - math.floor(rate)))
    return out
