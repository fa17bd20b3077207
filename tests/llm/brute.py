"""Plain Python versions of the contracts, one text at a time."""

import hashlib
import re

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def simhash(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    """fps: {doc_id: fingerprint}; {doc_id: smallest doc_id reachable by 3 or fewer differing bits}."""
    root = {d: d for d in fps}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def quality(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = {}
    for x in windows:
        count[x] = count.get(x, 0) + 1
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n_rep = len(covered)
    return (
        len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), n_rep,
        len(w) < 50 or 100 * n_rep > 50 * len(w),
    )


def chat(turns):
    """turns: (turn, role, text) of one conversation."""
    told = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in sorted(turns, key=lambda x: (x[0], x[1] or "", x[2] or "")))
    loss = "".join(t or "" for _, r, t in sorted(turns, key=lambda x: (x[0], x[1] or "", x[2] or "")) if r == "assistant")
    return len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def substrings(docs, width=50):
    """docs: {doc_id: text}; {doc_id: (n_words, n_removed, kept_sha256)}."""
    w = {d: words(t) for d, t in docs.items()}
    first = {}
    for d in sorted(w):
        for i in range(len(w[d]) - width + 1):
            first.setdefault(tuple(w[d][i : i + width]), d)
    out = {}
    for d, x in w.items():
        gone = set()
        for i in range(len(x) - width + 1):
            if first[tuple(x[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = " ".join(y for i, y in enumerate(x) if i not in gone)
        out[d] = (len(x), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out
