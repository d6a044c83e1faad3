"""Plain versions of the operators, written from their contracts alone."""

import hashlib
import re
import zlib

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def luhn(value):
    total = 0
    for i, d in enumerate(reversed([int(c) for c in value if c.isdigit()])):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def personal(text):
    """Counts, digest and base spans of personal data."""
    text = text or ""
    digits = lambda v: sum(c.isdigit() and c.isascii() for c in v)
    found = [
        ("email", [m.span() for m in EMAIL.finditer(text)]),
        ("ip", [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]),
        ("card", [m.span() for m in CARD.finditer(text) if 13 <= digits(m[0]) <= 19 and luhn(m[0])]),
        ("phone", [m.span() for m in PHONE.finditer(text) if 9 <= digits(m[0]) <= 15]),
    ]
    spans = ",".join(f"{k}:{a}:{b}" for k, all_ in found for a, b in all_)
    return [len(x) for _, x in found], hashlib.sha256(spans.encode()).hexdigest(), spans


def secret(text):
    """Counts, digest and base spans of secrets."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    spans = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
    return [sum(k == j for _, k, _ in found) for j in range(3)], hashlib.sha256(spans.encode()).hexdigest(), spans


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0


def shingles(text, n):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(texts, n, num, den):
    """{id: (set size, least id reachable by links)} of {id: text}."""
    s = {i: shingles(t, n) for i, t in texts.items()}
    label = {i: i for i in s}
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            least = min(label[a], label[b])
            moved |= label[a] != least or label[b] != least
            label[a] = label[b] = least
    return {i: (len(s[i]), label[i]) for i in s}


def words(text):
    """Words of the decontamination: runs of ASCII letters and digits and of other characters beyond ASCII, lower case."""
    return re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def overlap(doc, item, least=12):
    """Whether some alignment of the item over the document has a stretch of four equal words in five with enough of them."""
    d, w = words(doc), words(item)
    if not w:
        return False
    need = min(least, -(-4 * len(w) // 5))
    for shift in range(-len(w) + 1, len(d)):
        equal = [0 <= shift + k < len(d) and d[shift + k] == w[k] for k in range(len(w))]
        if sum(equal) < need:
            continue
        lo, hi = max(0, -shift), min(len(w), len(d) - shift)
        for a in range(lo, hi):
            for b in range(a + need, hi + 1):
                hit = sum(equal[a:b])
                if hit >= need and 5 * hit >= 4 * (b - a):
                    return True
    return False
