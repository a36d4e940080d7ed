"""Plain versions of the contracts, one document at a time."""

from __future__ import annotations

import hashlib
import re

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SECRET = {"assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def kept(kind: str, m: re.Match) -> bool:
    digits = re.sub("[^0-9]", "", m[0])
    return {
        "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
        "assign": lambda: len(m[2]) >= 12, "access": lambda: len(m[0]) >= 18, "hex": lambda: len(m[0]) >= 16,
    }[kind]()


def spans(patterns: dict[str, str], text: str) -> tuple[list[int], str]:
    """Counts by kind, and the digest of the joined spans."""
    found = [(m.start(), i, m.end()) for i, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, text) if kept(k, m)]
    names = list(patterns)
    return [sum(k == i for _, k, _ in found) for i in range(len(names))], hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(found)).encode()).hexdigest()


def places(patterns: dict[str, str], text: str | None) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text or "") if kept(k, m)]


def disclosing(texts: list[str], share: float, support: int) -> set[str]:
    """Words that give that share of the information of some matched value. Documents with values that are alike
    (five-word shingles, 0.8) count as one."""
    import math
    from collections import defaultdict

    said = [re.findall(r"[^\W_]{2,}", t.lower()) for t in texts]
    values = [{(k, m[0]) for k, p in PII.items() for m in re.finditer(p, t) if kept(k, m)} for t in texts]
    runs = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in said]
    label = list(range(len(texts)))
    with_values = [i for i, v in enumerate(values) if v]
    for n, i in enumerate(with_values):
        for j in with_values[:n]:
            if len(runs[i] & runs[j]) >= 0.8 * len(runs[i] | runs[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    of_word, of_value = defaultdict(set), defaultdict(set)
    for i, c in enumerate(label):
        for w in said[i]:
            of_word[w].add(c)
        for v in values[i]:
            of_value[v].add(c)
    out = set()
    for e in of_value.values():
        own = math.log2(len(texts) / len(e))
        for w, d in of_word.items():
            both = len(e & d)
            if len(e) >= support and own > 0 and both >= max(2, support) and own + math.log2((both - 1) / (len(d) - 1)) >= share * own - 1e-9:
                out.add(w)
    return out


def words(text: str) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text: str, width: int) -> set[tuple]:
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def linked(texts: dict[int, str], percent: int = 90, width: int = 3) -> dict[int, tuple[int, int, int]]:
    """id: set size, component, number of links, from all pairs."""
    sets = {d: shingles(t, width) for d, t in texts.items()}
    root, links = {d: d for d in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if sets[a] and sets[b] and 100 * small >= percent * large and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), links[d]) for d in ids}


def base_scores(rows: list[tuple[int, str]], held_out) -> dict[int, tuple[int, int, int, float]]:
    """id: tokens, known tokens, training tokens, base score."""
    import math
    from collections import Counter

    tokens = {d: [*words(t), None] for d, t in rows}
    count = Counter(w for d, t in tokens.items() if not held_out(d) for w in t)
    n, v = sum(count.values()), len(count)
    return {d: (len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for d, t in tokens.items()}


def bigram_score(rows: list[tuple[int, str]], held_out, discount: float = 0.75) -> dict[int, float]:
    """The unquantised model's log10 probability of each text."""
    import math
    from collections import Counter, defaultdict

    tokens = {d: [*words(t), None] for d, t in rows}
    one, two, follow = Counter(), Counter(), defaultdict(set)
    for d, t in tokens.items():
        if not held_out(d):
            one.update(t)
            for a, b in zip(["<begin>", *t], t):
                two[a, b] += 1
                follow[a].add(b)
    total = Counter()
    for (a, _), c in two.items():
        total[a] += c
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    q = lambda a, b: p(b) if not total[a] else max(two[a, b] - discount, 0) / total[a] + discount * len(follow[a]) / total[a] * p(b)
    return {d: sum(math.log10(q(a, b)) for a, b in zip(["<begin>", *t], t)) for d, t in tokens.items()}


def edit_distance_inside(item: str, text: str) -> int:
    """Least edits that turn item into some part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


def edit_distance_anywhere(item: str, text: str) -> int:
    """The same for long texts: one column a code point of the text, kept as bits of two numbers."""
    n = len(item)
    full, last, place = (1 << n) - 1, 1 << (n - 1), {}
    for i, c in enumerate(item):
        place[c] = place.get(c, 0) | 1 << i
    up, down, cost, best = full, 0, n, n
    for c in text:
        eq = place.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(x | up) & full, up & x
        cost += bool(plus & last) - bool(minus & last)
        plus, minus = plus << 1, minus << 1
        eq |= down
        up, down = (minus | ~(eq | plus)) & full, plus & eq
        best = min(best, cost)
    return best


def logistic(x, y, weight, penalty: float = 1.0):
    """Ridge-penalised logistic regression by damped Newton steps to a vanishing gradient; the intercept comes last."""
    import numpy as np

    x, y, weight = np.asarray(x, float), np.asarray(y, float), np.asarray(weight, float)
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.append(np.full(x.shape[1] - 1, penalty), 1e-6)
    loss = lambda w: (weight * (np.logaddexp(0, x @ w) - y * (x @ w))).sum() + 0.5 * (ridge * w * w).sum()
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        if np.abs(gradient).max() < 1e-9:
            break
        step, size = np.linalg.inv(x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag(ridge)) @ gradient, 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return w
