"""Plain Python versions of what the operators compute, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def secrets(text: str | None) -> tuple[int, int, int, str]:
    text = text or ""
    assign = [(m.start(), "assign", m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    access = [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    hexes = [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ["assign", "access", "hex"]
    spans = sorted(assign + access + hexes, key=lambda x: (x[0], order.index(x[1])))
    told = ",".join(f"{k}:{s}:{e}" for s, k, e in spans)
    return len(assign), len(access), len(hexes), hashlib.sha256(told.encode()).hexdigest()


def peak(v: str, window: int = 20) -> float:
    """The highest entropy of any window, each counted anew."""
    from math import log2

    return max((-sum((c := w.count(x)) / window * log2(c / window) for x in set(w)) for k in range(len(v) - window + 1) for w in [v[k : k + window]]), default=0.0)


ENTROPY = [("0-9a-f", "[0-9]", "[a-f]", 3.0), ("0-9A-F", "[0-9]", "[A-F]", 3.0), ("a-z0-9", "[0-9]", "[a-z]", 3.5), ("A-Z0-9", "[0-9]", "[A-Z]", 3.5), ("A-Za-z", "[a-z]", "[A-Z]", 3.9), ("A-Za-z0-9+/_=-", "[0-9]", "[A-Z]", 3.7)]


def all_spans(text: str, search: bool = True, entropy: list[tuple[int, int]] = ()) -> list[tuple[int, str, int]]:
    """Spans of the fixed forms and of entropy (searched, or as given), in order."""
    fixed = [(m.start(), "assign", m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    fixed += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    fixed += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    found = list(entropy)
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text) if search else ():
        if re.fullmatch("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[a-z]+([-_/=][a-z]+)*", m[0]):
            continue
        pieces = re.sub(r"(?i)[A-Za-z0-9+/_=-]?(?:example|placeholder|changeme|dummy|0123456789|abcdefghij|(.)\1{7,})[A-Za-z0-9+/_=-]?", " ", m[0]).split(" ")
        if any(re.search(one, run) and re.search(two, run) and peak(run) >= least for p in pieces for letters, one, two, least in ENTROPY for run in re.findall(f"[{letters}]{{20,}}", p)):
            found.append(m.span())
    order = ["assign", "access", "hex", "entropy"]
    return sorted(fixed + [(s, "entropy", e) for s, e in found], key=lambda x: (x[0], order.index(x[1])))


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] >= 2 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def p_good(texts: list[str | None], rules, share: float, belief: dict, weight: float, rounds: int, settled: float) -> list[float]:
    """Posterior of being good by expectation-maximisation, document by document."""
    from math import exp, log

    seen, counted = [], []
    for text in texts:
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed = quality(text)
        text = text or ""
        f = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}
        f |= {"n_lines": sum(bool(WORD.search(x)) for x in text.split("\n")), "n_upper": sum(c.isupper() for c in text), "n_letters": sum(c.isalpha() for c in text)}
        f |= {"n_stops": len(re.findall("[.!?]", text)), "n_distinct": len(set(WORD.findall(text)))}
        holds = lambda x: eval(re.sub(r"(\w+) between (.*) and (.*)", r"\2 <= \1 <= \3", x.lower()), {}, f)  # noqa: B023, E731
        seen.append([-1 if holds(bad) else 1 if holds(good) else 0 for bad, good in rules])
        counted.append(not failed)
    k = range(len(rules))
    rates = {c: [dict(belief[c]) for _ in k] for c in belief}
    start, n = share, sum(counted)

    def posterior(v):
        return 1 / (1 + exp(log(1 - share) - log(share) + sum(log(rates["bad"][j][v[j]]) - log(rates["good"][j][v[j]]) for j in k)))

    for _ in range(rounds):
        p = [posterior(v) for v in seen]
        size = {"good": sum(x for x, c in zip(p, counted, strict=True) if c)}
        size["bad"] = n - size["good"]
        of = lambda c, x: x if c == "good" else 1 - x
        rates = {c: [{v: (sum(of(c, x) for x, s, on in zip(p, seen, counted, strict=True) if on and s[j] == v) + weight * n * belief[c][v]) / (size[c] + weight * n) for v in (-1, 0, 1)} for j in k] for c in belief}
        before, share = share, (size["good"] + weight * n * start) / (n + weight * n)
        if abs(share - before) < settled:
            break
    return [posterior(v) for v in seen]


def shingles(text: str | None, width: int) -> frozenset:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def reachable(nodes, edges) -> dict:
    """The smallest node that each can reach."""
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def near(rows: list[tuple[int, str | None]], width: int, percent: int = 80) -> dict[int, int]:
    sets = [(i, shingles(t, width)) for i, t in rows]
    holds = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            holds[x].append(k)
    common = Counter((a, b) for ks in holds.values() for i, a in enumerate(ks) for b in ks[:i])
    edges = [(sets[a][0], sets[b][0]) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n)]
    return reachable([i for i, _ in rows], edges)


def tokens(text: str | None) -> list[str]:
    return [t for t in re.split(r"[^\w]+|_", (text or "").lower()) if t]


def contained(doc: list[str], item: list[str], window: int = 13, off: int = 2, shortest: int = 8) -> bool:
    w = min(window, len(item))
    off = off if w == window else 1 if w >= shortest else 0
    if not w:
        return False
    return any(sum(a != b for a, b in zip(doc[i : i + w], item[j : j + w], strict=True)) <= off for j in range(len(item) - w + 1) for i in range(len(doc) - w + 1))
