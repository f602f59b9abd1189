"""Plain restatements of the operators' contracts, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op3(rows):
    sets = {}
    for i, text in rows:
        w = WS.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def op4(rows, least=10):
    def key(x):
        return x.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    seen = Counter()
    for _, text in rows:
        seen.update({key(x) for x in (text or "").split("\n")})
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if not key(x) or seen[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(left), sha("\n".join(left))))
    return sorted(out, key=str)


def op6(rows, n=400):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + n] for _, b in data for k in range(len(b) - n + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def op10(rows):
    out = []
    for i, text in rows:
        text = text or ""
        w = WS.findall(text)
        lines = [x for x in text.split("\n") if WS.search(x)]
        windows = defaultdict(list)
        for k in range(len(w) - 7):
            windows[tuple(w[k : k + 8])].append(k)
        covered = {k + j for ks in windows.values() if len(ks) > 1 for k in ks for j in range(8)}
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed))
    return sorted(out, key=str)


def op1(rows, tokenizer):
    out = []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        out.append((i, len(ids), hashlib.sha256(raw).hexdigest(), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=str)


def op2(rows, tokenizer):
    out, start = [], 0
    for i, text in sorted(rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out


def op7(rows, n=25):
    """Places of words, by document, in ``n`` words that stand earlier and don't overlap their first place."""
    first, out = {}, defaultdict(set)
    for i, text in sorted(rows):
        w = (text or "").lower().split()
        for k in range(len(w) - n + 1):
            d, p = first.setdefault(tuple(w[k : k + n]), (i, k))
            if d != i or k >= p + n:
                out[i] |= set(range(k, k + n))
    return dict(out)


def op8(rows, items, run=13, percent=75, span=7):
    """Pairs of document and item of which ``run`` aligned words (or the whole item) agree, over all alignments."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for d, text in rows:
        a = words(text)
        for i, item in items:
            b = words(item)
            n = min(run, len(b))
            if not n:
                continue
            need = 100 if n < span else percent
            for x in range(len(a) - n + 1):
                if any(100 * sum(p == q for p, q in zip(a[x : x + n], b[y : y + n], strict=True)) >= need * n for y in range(len(b) - n + 1)):
                    out.add((d, i))
                    break
    return out
