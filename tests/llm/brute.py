"""Plain-Python versions of the training-data operators, for small tables."""

import hashlib
import re
from collections import defaultdict

ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
SECRET_KINDS = ["assign", "access", "hex", "bare"]
PII_KINDS = ["email", "ip", "card", "phone"]


def secrets(text):
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return found + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))
    return total % 10 == 0


def personal(text):
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    return found + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def listed(found, kinds):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda s: (s[1], kinds.index(s[0]))))


def digest(found, kinds):
    return hashlib.sha256(listed(found, kinds).encode()).hexdigest()


def word_set(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def components(rows, words, share=80):
    """(set size, smallest id reachable) of every (id, text), by holding all pairs of sets against each other."""
    sets = [word_set(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= share * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= share * (len(a) + len(b) - common):
                    parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        ids[find(i)].append(key)
    return [(len(sets[i]), min((k for k in ids[find(i)] if k is not None), default=None)) for i in range(len(rows))]


def line_chunks(rows, least=2):
    """Text of every (id, text) without the lines of chunks that came before, ids ascending."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    seen, out = set(), {}
    for key, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0], md5(f"{'-' if r[0] is None else r[0]}\0{r[1] or ''}"))):
        if text is None:
            out[key, text] = None
            continue
        lines = text.split("\n")
        begins = [i for i in range(len(lines)) if md5(md5(lines[i]) + (md5(lines[i + 1]) if i + 1 < len(lines) else "")) < "f"]
        gone = set()
        for b in begins:
            stop = next((e for e in begins if e >= b + least), len(lines))
            if stop - b >= least:
                body = "\n".join(lines[b:stop])
                if body in seen:
                    gone.update(range(b, stop))
                seen.add(body)
        out[key, text] = "\n".join(line for i, line in enumerate(lines) if i not in gone)
    return out


def lines_in_repeated_runs(texts):
    """Lines that lie in two lines in a row found before, in order of the texts."""
    seen, found = set(), 0
    for text in texts:
        lines = (text or "").split("\n")
        pairs = list(zip(lines, lines[1:]))
        marked = {j for i, p in enumerate(pairs) if p in seen for j in (i, i + 1)}
        seen.update(pairs)
        found += len(marked)
    return found
