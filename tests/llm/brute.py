"""Plain Python versions of the queries, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


def sha(t):
    return hashlib.sha256(t if isinstance(t, bytes) else t.encode()).hexdigest()


def components(docs, size=2, percent=80):
    """op1: {doc_id: (n_shingles, component_id)}"""
    sets = {}
    for i, t in docs:
        w = WORD.findall(low(t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    at = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            at[x].add(i)
    for i, s in sets.items():
        common = Counter(j for x in s for j in at[x] if j > i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeats(docs, length=100):
    """op3: {doc_id: (n_bytes, n_removed, n_spans, sha256 of what is left)}"""
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, sha(left))
    return out


def quality(t):
    """op4: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    t = t or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    mark = [0] * len(w)
    for k in range(len(w) - 7):
        if seen[tuple(w[k : k + 8])] > 1:
            mark[k : k + 8] = [1] * 8
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = sum(mark)
    symbols = sum(t.count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), n, len(w) < 20 or 100 * n > 30 * len(w)


def secrets(t):
    """op6: spans (start, rank, end) of the three patterns"""
    t, out = t or "", []
    kinds = [
        (r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
         r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
        (r"AKIA[A-Z0-9]+", 0, 20),
        (r"[0-9a-f]+", 0, 24),
    ]
    for rank, (p, g, least) in enumerate(kinds):
        out += [(m.start(), rank, m.end()) for m in re.finditer(p, t) if len(m[g]) >= least]
    return sorted(out)


def leaks(docs, items, window=10):
    """op7: {doc_id: (n_words, n_hit, item ids)}"""
    at = defaultdict(set)
    for i, t in items:
        w = tuple(PLAIN.findall(low(t or "")))
        for k in range(max(1, len(w) - window + 1)) if w else ():
            at[w[k : k + window]].add(str(i))
    sizes, out = sorted({len(x) for x in at}), {}
    for i, t in docs:
        w = tuple(PLAIN.findall(low(t or "")))
        hit, found = [0] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if w[k : k + n] in at:
                    hit[k : k + n] = [1] * n
                    found |= at[w[k : k + n]]
        out[i] = (len(w), sum(hit), sorted(found))
    return out


def lines(docs, least=20, shared=3):
    """op8: {doc_id: (n_lines, n_dropped, text left)}"""
    key = lambda x: low(x.strip(" \t\n\x0b\f\r"))
    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    out = {}
    for i, t in docs:
        all_lines = (t or "").split("\n")
        keep = [x for x in all_lines if not (len(key(x)) >= least and len(held[key(x)]) >= shared and max(held[key(x)]) != i)]
        out[i] = (len(all_lines), len(all_lines) - len(keep), "\n".join(keep))
    return out


def url(u, rules):
    """op5: host, path, rule"""
    if not u or "://" not in u:
        return "", "", None
    rest = u.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = low(host)
    fit = [h + p for _, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit, key=len) if fit else None


def base_scores(docs):
    """op9: {doc_id: (held_out, n_tokens, n_known, base_score)} and the number of training tokens"""
    from math import log10

    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    toks = {i: [*WORD.findall(low(t or "")), None] for i, t in docs}
    c = Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    out = {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), sum(log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in toks.items()}
    return out, n


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def fill_in_middle(i, t):
    """op11: n, form, prefix_chars, middle_chars, output"""
    t = t or ""
    units = UNIT.findall(t)
    h = [int(sha(f"42:{'' if i is None else i}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, t
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def clusters(vectors, dims=64, k=16, rounds=3):
    """op13: {vec_id: (cluster, distance, cluster_inertia, inertia, centroid_sha256)}"""
    from math import floor, isfinite

    xs = {i: [floor(64 * float(c)) for c in v] for i, v in vectors if v is not None and len(v) == dims and all(c is not None and isfinite(c) for c in v)}
    at = [xs[i] for i in sorted(xs, key=lambda i: sha(f"1:{i}"))[:k]]
    for r in range(rounds + 1):
        near = {i: min((sum((p - q) ** 2 for p, q in zip(x, c)), n) for n, c in enumerate(at)) for i, x in xs.items()}
        for n in range(len(at)) if r < rounds else ():
            own = [xs[i] for i in xs if near[i][1] == n]
            at[n] = [sum(c) // len(own) for c in zip(*own)] if own else at[n]
    inertia = Counter()
    for d, n in near.values():
        inertia[n] += d
    return {i: (n, d, inertia[n], sum(inertia.values()), sha(",".join(map(str, at[n])))) for i, (d, n) in near.items()}
