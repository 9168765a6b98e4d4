"""Plain versions of what the operators do, for small tables."""

import re

PII_RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, d[::-1]))) % 10 == 0


def pii_base(t):
    def fine(k, m):
        d = re.sub("[^0-9]", "", m)
        return k == "email" or k == "ip" and all(int(x) <= 255 for x in m.split(".")) or k == "card" and 12 <= len(d) <= 19 and luhn(d) or k == "phone" and 9 <= len(d) <= 15

    out = [(m.start(), i, m.end(), k) for i, k in enumerate(PII_RULES) for m in re.finditer(PII_RULES[k], t) if fine(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


SECRET_RULES = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6), ("access", re.compile("AKIA[A-Z0-9]+"), 20), ("hex", re.compile("[0-9a-f]+"), 24)]


def secret_base(t):
    out = []
    for i, (k, p, least) in enumerate(SECRET_RULES):
        for m in p.finditer(t):
            if len(m[2] if k == "assign" else m[0]) >= least:
                out.append((m.start(), i, m.end(), k))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def brute_links(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n, root = [0] * len(sets), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 9 * k >= 4 * (len(sets[i]) + len(sets[j])):
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(find(i), n[i]) for i in range(len(sets))]
