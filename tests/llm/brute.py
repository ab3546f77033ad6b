"""Plain versions of the corpus operators, for small tables."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

import public_tokenizers as P


def token_counts(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    counts = [len(e.ids) for e in t.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]
    return [(r[0], len((r[1] or "").encode()), n, n > 512) for r, n in zip(rows, counts)]


def bpe(rows):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, text in rows:
        ids = enc.encode_ordinary(text or "")
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        out.append((i, len(ids), sha, hashlib.sha256((text or "").encode()).hexdigest()))
    return out


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def decontaminate(rows, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    patterns = defaultdict(set)
    for item, text in items:
        words = word.findall(fold(text))
        if item is None or not words:
            continue
        n = min(window, len(words))
        for k in range(len(words) - n + 1):
            patterns[tuple(words[k : k + n])].add(str(item))
    lengths = {len(p) for p in patterns}
    out = []
    for i, text in rows:
        words = word.findall(fold(text))
        hit, found = [False] * len(words), set()
        for n in lengths:
            for k in range(len(words) - n + 1):
                if (p := tuple(words[k : k + n])) in patterns:
                    hit[k : k + n] = [True] * n
                    found |= patterns[p]
        names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(words), sum(hit), len(found), names, any(hit)))
    return out


def repeated_bytes(rows, size=200):
    texts = [(r[1] or "").encode() for r in rows]
    counts = Counter(t[k : k + size] for t in texts for k in range(len(t) - size + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - size + 1):
            if counts[t[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def line_dedup(rows):
    def candidates(text):
        lines = (text or "").split("\n")
        start, before, cuts = 0, 0, []
        for i, line in enumerate(lines):
            value = int(hashlib.md5(line.encode()).hexdigest()[:7], 16)
            if (value + 31 * before) % 4 == 0 or i == len(lines) - 1:
                cuts.append((start, i + 1))
                start = i + 1
            before = value
        return lines, [(a, b, "\n".join(lines[a:b])) for a, b in cuts if b - a >= 2 and len("\n".join(lines[a:b])) >= 50]

    counts, keeper = Counter(), {}
    for i, text in rows:
        for _, _, chunk in candidates(text)[1]:
            counts[chunk] += 1
            if i is not None:
                keeper[chunk] = min(keeper.get(chunk, i), i)
    out = []
    for i, text in rows:
        lines, found = candidates(text)
        gone, removed, seen = set(), 0, set()
        for a, b, chunk in found:
            if counts[chunk] > 1 and chunk in keeper and (keeper[chunk] != i or chunk in seen):
                gone |= set(range(a, b))
                removed += 1
            seen.add(chunk)
        kept = "\n".join(line for k, line in enumerate(lines) if k not in gone)
        out.append((i, len(lines), len(gone), removed, hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    if not words:
        return set()
    if len(words) < k:
        return {tuple(words)}
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def joined(size, links):
    group = {k: {k} for k in range(size)}
    for a, b in links:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for k in group[b]:
                group[k] = group[a]
    return list({id(g): g for g in group.values()}.values())


def components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    smallest = {}
    for k, (i, _) in enumerate(sets):
        root = find(k)
        smallest[root] = min((v for v in (smallest.get(root), i) if v is not None), default=None)
    return [(i, len(s), smallest[find(k)]) for k, (i, s) in enumerate(sets)]


def quality(rows):
    out = []
    for i, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        counts, covered = Counter(windows), set()
        for k, w in enumerate(windows):
            if counts[w] > 1:
                covered |= {k, k + 1, k + 2}
        measures = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        out.append((i, *measures, len(words) < 50 or 100 * len(covered) > 50 * len(words)))
    return out


def archive(rows):
    payloads = [(i, (h or "").encode()) for i, h in rows]
    largest = {}
    for i, p in payloads:
        if i is not None:
            largest[p] = max(largest.get(p, i), i)
    out = []
    for i, p in payloads:
        revisit = len(p) >= 1000 and i is not None and largest[p] > i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", largest[p] if revisit else None))
    return out


# ---- language ID --------------------------------------------------------------------


def _softmax(scores):
    top = max(scores)
    weights = [math.exp(s - top) for s in scores]
    return [w / sum(weights) for w in weights]


def identify(rows, model):
    """(id, text, declared, suffix, host, domain) rows to (id, text_lang, lang, posterior), one loop per step."""
    from tablestakes.llm.language_id import BUCKETS, DOMAIN_WEIGHT, EVIDENCE, HOST_WEIGHT, LANGUAGES

    every = range(len(LANGUAGES))

    def code(value):
        found = re.match(r"\s*([A-Za-z]{2})(?:[^A-Za-z]|$)", value or "")
        return None if not found else found[1].lower() if found[1].lower() in LANGUAGES else "other"

    def likelihoods(text):
        letters = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode())
        padded = b" " + b" ".join(letters.split()) + b" "
        grams = [(padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2]) * 2654435761 % 2**32 >> 17 for i in range(len(padded) - 2)] if len(padded) >= 4 else []
        assert all(g < BUCKETS for g in grams)
        if not grams:
            return [0.0] * len(LANGUAGES)
        scores = [sum(float(model[x][g]) for g in grams) / len(grams) * min(len(grams), EVIDENCE) for x in every]
        return [s - max(scores) for s in scores]

    scores = [likelihoods(text) for _, text, *_ in rows]
    shares = [_softmax(s) if any(s) else [0.0] * len(LANGUAGES) for s in scores]

    def sums(keys):
        found = defaultdict(lambda: [0.0] * len(LANGUAGES))
        for key, share in zip(keys, shares):
            if key is not None:
                found[key] = [a + b for a, b in zip(found[key], share)]
        return found

    declared, suffix = [code(r[2]) for r in rows], [code(r[3]) for r in rows]
    tables = []
    for keys in (declared, suffix):
        found = sums(keys)
        totals = [sum(s[x] for s in found.values()) for x in every]
        tables.append({k: [math.log((s[x] + 1) / (totals[x] + len(LANGUAGES) + 1)) for x in every] for k, s in found.items()})
    hosts, domains = sums([r[4] for r in rows]), sums([r[5] if r[4] is not None else None for r in rows])
    total = [sum(s[x] for s in shares) for x in every]
    out = []
    for k, (row_id, _, _, _, host, domain) in enumerate(rows):
        prior = [(total[x] + 1) / (sum(total) + len(LANGUAGES)) for x in every]
        if host is not None:
            for found, weight in ((domains[domain], DOMAIN_WEIGHT), (hosts[host], HOST_WEIGHT)):
                others = [max(found[x] - shares[k][x], 0.0) for x in every]
                prior = [(others[x] + weight * prior[x]) / (sum(others) + weight) for x in every]
        fused = [scores[k][x] + math.log(prior[x]) for x in every]
        for key, table in zip((declared[k], suffix[k]), tables):
            fused = [fused[x] + (table[key][x] if key is not None else 0.0) for x in every]
        final = _softmax(fused)
        first = lambda values: LANGUAGES[max(every, key=lambda x: (values[x], -x))]
        out.append((row_id, first(scores[k]), first(final), max(final)))
    return out


def page_facts(page_id, url, html):
    """Visible text, declared language, suffix, host and domain of a page."""
    host = re.match(r".*?://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    host = (host[1].lower() if host else "") or None
    if url is None:
        host = None
    label, domain = re.search(r"\.([a-z]{2})\Z", host or ""), re.search(r"([^.]+\.[^.]+)\Z", host or "")
    segment = re.match(r".*?://[^/?#]*/([A-Za-z]{2})(?:[/?#]|\Z)", url or "")
    lang = re.search(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", html or "", re.ASCII)
    bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", html or "", flags=re.ASCII)
    bare = re.sub(r"&#?\w{1,10};", " ", bare, flags=re.ASCII)
    return page_id, bare, lang and lang[1], label[1] if label else segment and segment[1], host, None if host is None else domain[1] if domain else ""
