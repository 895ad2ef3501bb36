"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter
from itertools import combinations

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text):
    words = space_words(text)
    lines = [x for x in (text or "").split("\n") if space_words(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    failed = n < 50 or 100 * len(repeated) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), failed


def shingles(text, size):
    words = space_words((text or "").translate(LOW))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def components(rows, size, percent):
    """doc_id -> (n_shingles, component, kept); ids are unique here."""
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def leaks(text, items):
    """(n_words, n_hit, n_items, sha, contaminated) against items: [(id, text)]."""
    words, hit, names = alnum_words(text), set(), set()
    for name, t in items:
        w = alnum_words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            window = w[i : i + 10]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    names.add(str(name))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def repeats(rows, length):
    """For each text in order (n_bytes, n_removed, n_spans, sha)."""
    raws = [(t or "").encode() for t in rows]
    seen = Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for b in raws:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def personal(text):
    """(kind, start, end) of the base rules, by plain regular expressions."""
    text = text or ""
    order = ["email", "ip", "card", "phone"]
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda f: (f[1], order.index(f[0])))


def licence(text, phrases):
    """(n_words, n_base, first, last, labels)."""
    words, at, labels = alnum_words(text), [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def boilerplate(rows, share=0.05, least=20):
    """doc_id -> (n_words_removed, clean_text, kept) by the frequency of lines; rows of (doc_id, text, host)."""
    norm = lambda line: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", line.strip(" ").lower()))
    lines = lambda text: [x for x in (text or "").split("\n") if space_words(x)]
    texts, often = {}, {}
    for _, text, host in rows:
        if lines(text):
            texts.setdefault(host, set()).add(text)
    for host, some in texts.items():
        count = Counter(x for t in some for x in {norm(x) for x in lines(t)})
        often[host] = {x for x, n in count.items() if n > least and n > share * len(some)}
    out = {}
    for i, text, host in rows:
        gone = often.get(host, set())
        clean = None if text is None else "\n".join(x for x in text.split("\n") if not space_words(x) or norm(x) not in gone)
        n, left = len(space_words(text)), len(space_words(clean))
        out[i] = n - left, clean, not quality(text)[5] and left >= 0.5 * n
    return out


def permissive(expression, known):
    """Permissiveness of a well-formed licence expression, by recursive descent; known: identifier -> degree."""
    tokens = re.findall(r"[()]|[^\s()]+", expression) + [""]

    def term():
        if tokens[0] == "(":
            tokens.pop(0)
            value = either()
            tokens.pop(0)
        else:
            value = known.get(tokens.pop(0).lower())
        if tokens[0].lower() == "with":
            del tokens[:2]
            value = value and min(1.0, value + 0.2)
        return value or 0.0

    def both():
        value = term()
        while tokens[0].lower() == "and":
            tokens.pop(0)
            value = min(value, term())
        return value

    def either():
        value = both()
        while tokens[0].lower() == "or":
            tokens.pop(0)
            value = max(value, both())
        return value

    return either()


def packed(lengths, full, weights, rule):
    """Number of the bin of each piece: all open bins compared, one by one."""
    bins, out = [], []
    for n in lengths:
        need, best = (n, 1, n * n), None
        for i, left in enumerate(bins):
            if all(x >= y for x, y in zip(left, need)):
                if rule == "norm":
                    score = -sum(w * ((x - y) / f) ** 2 for w, x, y, f in zip(weights, left, need, full))
                else:
                    score = sum(w * x * y / f / f for w, x, y, f in zip(weights, left, need, full))
                if best is None or score > best[0] + 1e-12:
                    best = score, i
        if best is None:
            bins.append(list(full))
            best = 0, len(bins) - 1
        bins[best[1]] = [x - y for x, y in zip(bins[best[1]], need)]
        out.append(best[1])
    return out


def bootstrapped(found, rounds=3, bound=0.5, support=5):
    """Trusted patterns of (pattern, instance, seed) triples."""
    seed, edges = {}, {(p, i) for p, i, _ in found}
    for p, i, s in found:
        seed[p, i] = max(seed.get((p, i), 0.0), float(s))
    own = {i: max(seed[q, j] for q, j in edges if j == i) for _, i in edges} if len(edges) < 2000 else {}
    if not own:
        for (_, i), s in seed.items():
            own[i] = max(own.get(i, 0.0), s)
    score, worth, n = dict(own), {}, Counter(p for p, _ in edges)
    for turn in range(rounds):
        total = Counter()
        for p, i in edges:
            total[p] += score[i]
        worth = {p: total[p] / (n[p] + 2.0) for p in n}
        if turn < rounds - 1:
            score = dict(own)
            for p, i in edges:
                if n[p] >= support:
                    score[i] = max(score[i], worth[p])
    return {p for p in n if worth[p] >= bound and n[p] >= support}
