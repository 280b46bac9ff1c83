"""Plain forms of the deduplication contracts, for small inputs."""

import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def cover(docs, tokens_of, window):
    """[(doc_id, tokens, removed mask)] by direct definition."""
    first = {}
    toks = [(i, tokens_of(t)) for i, t in docs]
    big = 1 << 63
    for i, ts in toks:
        for j in range(len(ts) - window + 1):
            k = tuple(ts[j : j + window]) if not isinstance(ts, bytes) else ts[j : j + window]
            first[k] = min(first.get(k, big), big if i is None else i)
    out = []
    for i, ts in toks:
        m = [False] * len(ts)
        for j in range(len(ts) - window + 1):
            k = tuple(ts[j : j + window]) if not isinstance(ts, bytes) else ts[j : j + window]
            if first[k] < (big if i is None else i):
                m[j : j + window] = [True] * window
        out.append((i, ts, m))
    return out


def words_removed(docs, window=50):
    rows = []
    for i, ts, m in cover(docs, lambda t: WORD.findall(t or ""), window):
        kept = " ".join(w for w, x in zip(ts, m) if not x)
        rows.append((i, len(ts), sum(m), hashlib.sha256(kept.encode()).hexdigest()))
    return rows


def bytes_removed(docs, window=50):
    rows = []
    for i, ts, m in cover(docs, lambda t: (t or "").encode(), window):
        kept = bytes(b for b, x in zip(ts, m) if not x)
        spans = sum(x and not (j and m[j - 1]) for j, x in enumerate(m))
        rows.append((i, len(ts), sum(m), spans, hashlib.sha256(kept).hexdigest()))
    return rows
