"""Plain-Python versions of the text operators, for small inputs."""

import collections
import hashlib
import re
import zlib

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def shingles(text, n):
    w = SPACE_WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(docs, n, percent):
    """docs: list of (id, text) -> {position: (shingles, component id)}"""
    sets = [shingles(t, n) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return [(len(sets[i]), least.get(root(i)) if sets[i] else docs[i][0]) for i in range(len(docs))]


def repeats(texts, length):
    """Per text: (bytes, removed, spans, kept bytes)."""
    raw = [(t or "").encode() for t in texts]
    first, again = {}, [bytearray(len(x)) for x in raw]
    for i, x in enumerate(raw):
        for k in range(len(x) - length + 1):
            w = x[k:k + length]
            if w in first:
                j, m = first[w]
                again[i][k] = again[j][m] = 1
            else:
                first[w] = (i, k)
    out = []
    for x, r in zip(raw, again, strict=True):
        kept, removed, spans, until, before = bytearray(), 0, 0, 0, False
        for k, c in enumerate(x):
            if r[k]:
                until = k + length
            gone = k < until
            if not gone:
                kept.append(c)
            spans += gone and not before
            removed += gone
            before = gone
        out.append((len(x), removed, spans, bytes(kept)))
    return out


def contamination(docs, items, n=10):
    windows = collections.defaultdict(set)
    for k, t in items:
        w = BENCH_WORD.findall((t or "").translate(LOWER))
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[i:i + m])].add(str(k))
    lengths = sorted({len(w) for w in windows})
    out = []
    for k, t in docs:
        w = BENCH_WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                got = windows.get(tuple(w[i:i + m]))
                if got:
                    hit |= set(range(i, i + m))
                    found |= got
        out.append((k, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def statistics(text):
    text = text or ""
    w = SPACE_WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE_WORD.search(line):
            dup += line in seen
            seen.add(line)
    tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    marked = set()
    for i in range(len(w) - 2):
        if tri[w[i], w[i + 1], w[i + 2]] >= 2:
            marked |= {i, i + 1, i + 2}
    failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), failed


def lm_tokens(text):
    return [*SPACE_WORD.findall((text or "").translate(LOWER)), "\n"]


def held_out(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 10 == 0
