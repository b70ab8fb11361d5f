"""Plain versions of the operators, for comparison."""

import hashlib


def remove_repeats(docs, length):
    """docs: (id, text); returns id -> (bytes, removed, spans, sha256 of the rest)."""
    first = {}
    data = [(i, (t or "").encode()) for i, t in docs]
    for i, b in data:
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\x01" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out
