"""Plain Python versions of the operators, for small inputs."""

import collections
import hashlib
import html
import re
import zlib

import numpy as np

from panelmark.llm import markup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def near(rows, k, percent):
    """{id: (set size, smallest id reachable)}"""
    low = {c: c + 32 for c in range(65, 91)}
    sets, parent, holders = {}, {}, collections.defaultdict(list)
    for i, text in rows:
        w = words((text or "").translate(low))
        sets[i] = set() if not w else {tuple(w)} if len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        shared = collections.Counter(j for g in s for j in holders[g])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def personal(text):
    """[(start, kind number, end)] of the fixed rules."""
    out = []
    for number, (kind, pattern) in enumerate(PERSONAL.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and max(map(int, m[0].split("."))) <= 255, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), number, m.end()))
    return sorted(out)


def quality(text):
    """(words, code points in words, symbols, repeated lines, words in repeated windows)"""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for k in range(len(w) - 2):
        if windows[tuple(w[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(data):
    return hashlib.sha256(data).hexdigest()


def article(page):
    """Main text of the test tables' pages, which all have an article element."""
    found = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    if not found:
        return ""
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", found[1])]
    return "\n".join(b for b in blocks if b)


def repeated(pages):
    """{page: texts of its article that its host's template has}, from whole occurrence vectors over different articles.

    ``pages`` are (page, host, html)."""
    hosts = collections.defaultdict(dict)
    for _page, host, text in pages:
        found = markup.scan(text)
        within = [b for b in found.blocks if b[2] >= 0]
        counts = collections.Counter((found.paths[b[0]], b[3]) for b in within)
        counts.update({(found.paths[p], None): found.uses[p] for b in within for p in b[5]})
        hosts[host][tuple(b[3] for b in within)] = counts
    texts = {}
    for host, articles in hosts.items():
        tokens = set().union(*articles.values())
        vectors = collections.defaultdict(list)
        for token in tokens:
            vectors[tuple(counts[token] for counts in articles.values())].append(token)
        valid = [v for v in vectors if sum(map(bool, v)) >= max(3, len(articles) / 2) and len(vectors[v]) > 1]
        texts[host] = {token[1] for v in valid for token in vectors[v] if token[1]}
    return {page: texts[host] & {b[3] for b in markup.scan(text).blocks if b[2] >= 0} for page, host, text in pages}
