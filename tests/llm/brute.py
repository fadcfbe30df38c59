"""Plain versions of the operators, one document at a time."""

import hashlib
import re

import xxhash

UPPER = {i: i + 32 for i in range(65, 91)}


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash(text):
    w = (text or "").translate(UPPER).encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    counts = [0] * 64
    for s in shingles:
        v = xxhash.xxh64_intdigest(s, seed=42)
        for b in range(64):
            counts[b] += v >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text):
    out = {}
    for kind, pattern in KINDS.items():
        out[kind] = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out[kind].append((m.start(), m.end()))
    return out


def pii_digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k]).encode()).hexdigest()


def pii_instances(text):
    """(start, end, value, left, right, kind or None) of the base spans widened to words, and of the free words with a digit or @ and their runs."""
    text = text or ""
    every = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    spans = [(a, b, k) for k, found in pii(text).items() for a, b in found]
    hot = [i for i, w in enumerate(every) if re.search("[0-9@]", w[2])]
    free = [i for i in hot if not any(a < every[i][1] and b > every[i][0] for a, b, _ in spans)]
    pairs = [(next(i for i in hot if every[i][0] <= a < every[i][1]), next(i for i in hot if every[i][0] < b <= every[i][1]), k) for a, b, k in spans]
    pairs += [(i, i, None) for i in free]
    run = []
    for i in [*free, None]:
        if run and i != run[-1] + 1:
            pairs += [(run[0], run[-1], None)] if len(run) > 1 else []
            run = []
        run.append(i)
    out = []
    for i, j, k in pairs:
        value = text[every[i][0] : every[j][1]] if k else " ".join(w[2] for w in every[i : j + 1])
        out.append((every[i][0], every[j][1], value, every[i - 1][2].lower() if i else "^", every[j + 1][2].lower() if j + 1 < len(every) else "$", k))
    return out


def pii_patterns(value, left, right):
    shape = re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]+", "9", value))
    n = len(re.findall("[0-9]", value))
    rough = ("a" if re.search(r"[^\W\d_]", value) else "") + ("" if n == 0 else "9" if n < 5 else "99" if n < 9 else "999")
    return [f"L {left} {rough}", f"B {left} {rough} {right}", f"S {left} {shape}", f"R {shape} {right}"]


def pii_accepted(texts, rounds=3):
    """pattern -> (kind, score)."""
    seeds, values = {}, {}
    for t in set(texts):
        for _, _, v, left, right, k in pii_instances(t):
            for p in pii_patterns(v, left, right):
                values.setdefault(p, set()).add(v)
                if k:
                    seeds.setdefault((p, k), set()).add(v)
    own = {}
    for (_, k), vs in seeds.items():
        for v in vs:
            own.setdefault(v, {})[k] = 1.0
    labels = own
    for _ in range(rounds):
        accepted = {}
        for (p, k), vs in seeds.items():
            score = round(sum(labels.get(v, {}).get(k, 0.0) for v in values[p]) / len(values[p]), 9)
            if len(vs) >= 5 and score >= 0.9:
                accepted[p, k] = score
        labels = {v: dict(x) for v, x in own.items()}
        for (p, k), score in accepted.items():
            for v in values[p] - set(own):
                of = labels.setdefault(v, {})
                of[k] = max(of.get(k, 0.0), score)
    out = {}
    for (p, k), score in accepted.items():
        out[p] = max(out.get(p, (0, -9, "")), (score, -list(KINDS).index(k), k))
    return out


def pii_added(texts):
    """For each text the spans (kind, start, end) found by accepted patterns only."""
    accepted = pii_accepted(texts)
    out = []
    for t in texts:
        best = {}
        for a, b, v, left, right, k in pii_instances(t):
            hits = [accepted[p] for p in pii_patterns(v, left, right) if p in accepted]
            if k is None and hits:
                best[a, b] = max(hits)[2]
        out.append({(k, a, b) for (a, b), k in best.items() if not any((x, y) != (a, b) and x <= a and b <= y for x, y in best)})
    return out


def redacted(text, spans):
    """The text with its spans (kind, start, end) replaced, those that overlap as one."""
    if text is None:
        return None
    out, at, merged = [], 0, []
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[at:a], f"[{k}]"]
        at = b
    return "".join([*out, text[at:]])


def dedup(docs, window=20):
    """docs: (id, text) in the order of id; per document (n_words, n_removed, digest)."""
    seen, out = {}, []
    parsed = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in parsed:
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            seen[g] = min(seen.get(g, (i, s)), (i, s))
    for i, w in parsed:
        gone = set()
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] < (i, s):
                gone.update(range(s, s + window))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
