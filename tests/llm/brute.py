"""Plain Python versions of the text operators, slow and without Spark."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

# -- language ---------------------------------------------------------------------------------


def pieces_of(text, training, alphabet, block):
    """Greedy longest-match pieces of a folded text, cut at multiples of ``block``."""
    source = "".join(c for c in training if c in alphabet)
    n = 0
    for at in range(0, len(text), block):
        part, i = text[at : at + block], 0
        while i < len(part):
            j = i + 1
            if part[i] in alphabet:
                while j < len(part) and part[j] in alphabet and part[i : j + 1] in source:
                    j += 1
            n += 1
            i = j
    return n


def folded(text):
    """Lower case with every run of non-letters as one blank, none at the start."""
    out = []
    for c in text.lower():
        if c.isalpha():
            out.append(c)
        elif out and out[-1] != " ":
            out.append(" ")
    return "".join(out)


def language(text, training, alphabet, block):
    if not text or not any(map(str.isalpha, text)) or not training:
        return "und", 0.0
    names = sorted(training)
    cost = [pieces_of(folded(text), training[k], alphabet, block) * math.log2(max(2, len(training[k]))) for k in names]
    best = min(range(len(names)), key=lambda i: (cost[i], i))
    rest = [c for i, c in enumerate(cost) if i != best]
    return names[best], min(rest) / (cost[best] + min(rest)) if rest else 1.0


def alphabet_of(training, size):
    seen = Counter(c for t in training.values() for c in t)
    del seen[" "]
    return set(sorted(seen, key=lambda c: (-seen[c], c))[: size - 2]) | {" "}


# -- near-duplicates --------------------------------------------------------------------------


def fingerprint(text, words=3, seed=42):
    table = {i: i + 32 for i in range(65, 91)}
    parts = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
    if not parts:
        return 0
    runs = [" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or [" ".join(parts)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, far):
    """Number of the component of every value; values that differ in at most ``far`` bits are linked."""
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    arr = np.array(values, dtype=np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= far).tolist():
            parent[root(i + 1 + j)] = root(i)
    return [root(i) for i in range(len(values))]


def near_copies(texts, size=5, similarity=0.8):
    """Number of the group of every text: texts are linked when they share enough of their runs of words."""
    sets = []
    for t in texts:
        parts = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append(frozenset(tuple(parts[i : i + size]) for i in range(len(parts) - size + 1)) or frozenset([tuple(parts)]))
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if group[i] != group[j] and min(len(a), len(b)) >= similarity * max(len(a), len(b)):
                both = len(a & b)
                if both >= similarity * (len(a) + len(b) - both):
                    old, new = group[i], group[j]
                    group = [new if g == old else g for g in group]
    return group


# -- decontamination --------------------------------------------------------------------------


def words(text):
    raw = (text or "").lower().encode("utf-8", "surrogatepass")
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)


def leaks(text, items, masks, window, similarity):
    """[(item, start, end, equal)]: windows with enough words equal, on a diagonal that holds a seed;
    for an item shorter than a window on any diagonal. Items that repeat give repeated rows."""
    own, every = words(text), []
    for key, item in items:
        it, out = words(item), set()
        if not it:
            continue
        size = min(window, len(it))
        diagonals = set(range(-len(it), len(own) + 1)) if len(it) < window else set()
        for m in masks if len(it) >= window else ():
            ones = [p for p in range(len(m)) if m[p] == "1"]
            seeds = {}
            for q in range(len(it) - len(m) + 1):
                seeds.setdefault(tuple(it[q + p] for p in ones), []).append(q)
            for i in range(len(own) - len(m) + 1):
                diagonals |= {i - q for q in seeds.get(tuple(own[i + p] for p in ones), ())}
        for d in diagonals:
            same = {q for q in range(len(it)) if 0 <= d + q < len(own) and own[d + q] == it[q]}
            good = [
                q for q in range(len(it) - size + 1)
                if 0 <= d + q and d + q + size <= len(own) and len(same & set(range(q, q + size))) >= math.ceil(similarity * size - 1e-9)
            ]
            spans = []
            for q in good:
                if spans and q <= spans[-1][1]:
                    spans[-1][1] = q + size
                else:
                    spans.append([q, q + size])
            out |= {(key, d + a, d + b, len(same & set(range(a, b)))) for a, b in spans}
        every += out
    return every


# -- repeated bytes ---------------------------------------------------------------------------


def repeated(texts, length):
    """(bytes, removed, spans, hash of the rest) of every text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(r, dtype=np.uint8)[~gone].tobytes()
        starts = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(r), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return out


# -- personal data ----------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def term_spans(texts, reach, alpha, support):
    """Spans (start, end, kind) of disclosing terms for every text. Counts are of distinct texts; an
    entity or pair is judged when it is seen in ``support`` distinct surroundings."""
    term = re.compile(r"[^\W\d_]{3,}")
    seen, places, holders, pairs = [], defaultdict(dict), defaultdict(set), defaultdict(set)
    for k, text in enumerate(texts):
        for start, _, kind, end in base_spans(text):
            low, high = max(0, start - reach), min(len(text), end + reach)
            around = text[low:start] + " " * (end - start) + text[end:high]
            found = []
            for m in term.finditer(around):
                if (m.start() > 0 or low == 0) and (m.end() < len(around) or high == len(text)):
                    found.append((m.group().lower(), low + m.start(), low + m.end()))
            entity = (kind, text[start:end].lower())
            places[entity][around] = {t for t, _, _ in found}
            holders[entity].add(text)
            for t, _, _ in found:
                pairs[entity, t].add(text)
            seen.append((k, entity, found))
    distinct = set(texts)
    frequency = Counter(t for text in distinct for t in set(term.findall((text or "").lower())))
    n, guilty = len(distinct), {}
    for entity, around in places.items():
        if len(around) < support:
            continue
        for t, often in Counter(t for ts in around.values() for t in ts).items():
            if often < support:
                continue
            told = math.log2(len(pairs[entity, t]) * n / (len(holders[entity]) * frequency[t]))
            content = math.log2(n / len(holders[entity]))
            if told >= alpha * content:
                guilty[entity, t] = told >= content
    out = [{} for _ in texts]
    for k, entity, found in seen:
        for t, s, e in found:
            if (entity, t) in guilty:
                out[k][s, e] = out[k].get((s, e), False) or guilty[entity, t]
    return [sorted((s, e, "removed" if whole else "term") for (s, e), whole in spans.items()) for spans in out]


def sanitise(text, base, added):
    spans = sorted([(s, r, e, k) for s, r, k, e in base] + [(s, 4, e, k) for s, e, k in added])
    out, at = [], 0
    for s, _, e, kind in spans:
        if s >= at:
            out += [text[at:s], "" if kind == "removed" else f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:] if spans else text


# -- quality rules ----------------------------------------------------------------------------


def rule_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def trusted(votes, start_good, start_right, pseudo, rounds):
    """(share of good rows, right on good, right on bad, posterior of every row) of vote lists."""
    good, right = start_good, [start_right] * len(votes[0])
    for _ in range(rounds + 1):
        q = []
        for row in votes:
            yes, no = good, 1 - good
            for v, (a, b) in zip(row, right):
                yes *= {1: a, -1: 1 - a, 0: 1}[v]
                no *= {1: 1 - b, -1: b, 0: 1}[v]
            q.append(yes / (yes + no))
        last = good, right, q
        good = (sum(q) + pseudo * start_good) / (len(q) + pseudo)
        right = []
        for j in range(len(votes[0])):
            a = (sum(p for p, r in zip(q, votes) if r[j] == 1) + pseudo * start_right[0]) / (sum(p for p, r in zip(q, votes) if r[j]) + pseudo)
            b = (sum(1 - p for p, r in zip(q, votes) if r[j] == -1) + pseudo * start_right[1]) / (sum(1 - p for p, r in zip(q, votes) if r[j]) + pseudo)
            lift = max(0, 1 - a - b) / 2
            right.append((a + lift, b + lift))
    return last


# -- conversations ----------------------------------------------------------------------------


def rebuilt(rows):
    """conv_id -> list of (role, text); rows are (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[c].append((turn is not None, turn or 0, role, name, text))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def trie(rows):
    """Sorted (conv_id, depth, parent, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    members = defaultdict(list)
    for c, turns in rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, len(turns)))
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, ms in members.items():
        ends = ",".join(map(str, sorted(c for c, n in ms if n == len(p))))
        parent = min(c for c, _ in members[p[:-1]]) if p else None
        out.append((min(c for c, _ in ms), len(p), parent, len(ms), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


# -- fill in the middle -----------------------------------------------------------------------


def fill_middle(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) with the given marks and shares."""
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    if h4 % 100 < 20:
        return n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}"
