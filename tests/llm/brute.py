"""Plain Python versions of the operators."""

import hashlib
import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def base_secrets(text):
    text = text or ""
    name = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    assign = [m.span() for m in re.finditer(name + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 12]
    access = [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    hexa = [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    spans = sorted((a, k, b) for k, found in enumerate((assign, access, hexa)) for a, b in found)
    digest = hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
    return len(assign), len(access), len(hexa), digest


def quality(text):
    text = text or ""
    words = SPACE_WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if SPACE_WORD.search(line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), failed


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))


def contamination(text, items):
    words, hit, found = bench_words(text), set(), set()
    for key, item in items:
        w = bench_words(item)
        for win in {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1))} if w else ():
            for i in range(len(words) - len(win) + 1):
                if tuple(words[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found.add(str(key))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def shingles(text, k=4):
    w = SPACE_WORD.findall(low(text or ""))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def components(texts, k=4, percent=85):
    """doc_id -> (set size, smallest linked doc_id)."""
    sets = {i: shingles(t, k) for i, t in texts}
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= percent * len(sets[x] | sets[y]):
                a, b = sorted((top(x), top(y)))
                label[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}
