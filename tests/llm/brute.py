"""Plain reference versions of the corpus operators' rules."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def removed_words(docs, window=50):
    """doc_id -> (n_words, n_removed, sha of what is kept), for unique ids."""
    first = {}
    cut = {i: words(t) for i, t in docs}
    for i in sorted(cut):
        w = cut[i]
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    out = {}
    for i, w in cut.items():
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def least_reachable(nodes, close):
    """node -> least node of its component, links given by close(a, b)."""
    nodes, root = sorted(nodes), {}
    for x in nodes:
        if x not in root:
            todo = [x]
            root[x] = x
            while todo:
                a = todo.pop()
                for b in nodes:
                    if b not in root and close(a, b):
                        root[b] = x
                        todo.append(b)
    return root


def simhash(text, shingle=3):
    import xxhash

    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    parts = [" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def line_chunks_removed(docs, chunks):
    """doc_id -> text without chunks of lines met before, for unique ids; chunks(lines) gives the cuts."""
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        if t is None:
            out[i] = None
            continue
        lines, left = t.split("\n"), []
        for a, b in chunks([x.encode() for x in lines]):
            body = tuple(lines[a:b])
            if sum(1 for x in body if words(x)) > 1:
                if body in seen:
                    continue
                seen.add(body)
            left += body
        out[i] = "\n".join(left)
    return out


def one_permutation(hashes, bins=256, bits=4, probes=12, pair_hash=None):
    """The value of each bin of a set of signed 64-bit hashes: least of the bin, else of the bin it borrows from, low bits."""
    import xxhash

    least = {}
    for h in hashes:
        b = (h >> 56) + 128  # bins in the order of the signed hash
        least[b] = min(least.get(b, h), h)
    out = []
    for b in range(bins):
        at = b
        if b not in least:
            drawn = [xxhash.xxh32_intdigest(f"{b} {t}") % bins for t in range(probes)]
            at = next((q for q in drawn if q in least), None)
            if at is None:
                at = min(least, key=lambda q: (pair_hash(b, q), q))
        out.append(least[at] & ((1 << bits) - 1))
    return out
