"""Brute-force versions that several tests share."""

from collections import Counter


def tokens(text):
    return [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ") if x]


def leaks_of(docs, items, threshold=0.8):
    """Best similarity of every window of an item's size, for each document and item."""
    out = {}
    for i, text in items:
        w = tokens(text)
        if len(w) < 5:
            continue
        theirs = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        for d, t in docs:
            own = tokens(t)
            grams = [tuple(own[k : k + 5]) for k in range(len(own) - 4)]
            if not theirs.keys() & set(grams):
                continue
            for s in range(max(1, len(own) - len(w) + 1)):
                window = Counter(grams[s : s + len(w) - 4])
                same = sum((window & theirs).values())
                score = same / (window.total() + theirs.total() - same)
                if score >= threshold and score > out.get((d, i), (0,))[0]:
                    out[d, i] = (score, s)
    return out
