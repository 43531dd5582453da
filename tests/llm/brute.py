"""Brute-force versions of operators on small tables."""

import re


def left_after_dedup(rows, min_run, min_words, least=8):
    """Texts without the runs of words that an earlier place has; rows in order of id, equal rows as one."""
    documents = sorted({(d, t) for d, t in rows if d is not None and t is not None}, key=lambda r: r[0])
    cut, seen = {}, []
    for d, t in documents:
        tokens = re.findall(r"[^ \n\r\t]*[ \n\r\t]|[^ \n\r\t]+$", t)
        words = [x.strip() for x in tokens]
        covered = [False] * len(words)
        for i in range(len(words)):
            longest = 0
            for other in [*seen, words[:i]]:
                for j in range(len(other)):
                    if other[j] == words[i] and longest < len(other) - j:
                        n = 0
                        while i + n < len(words) and j + n < len(other) and other[j + n] == words[i + n]:
                            n += 1
                        longest = max(longest, n)
            if longest >= least:
                covered[i : i + longest] = [True] * longest
        out, i = [], 0
        while i < len(words):
            n = i
            while n < len(words) and covered[n] == covered[i]:
                n += 1
            goes = covered[i] and (n - i >= min_words or len("".join(tokens[i:n])) >= min_run)
            out += [] if goes else tokens[i:n]
            i = n
        cut[d, t] = "".join(out)
        seen.append(words)
    return [(d, cut.get((d, t), t)) for d, t in rows if (d, t) not in cut or cut[d, t] == t or cut[d, t].strip()]


def spans_hit(text, items, window):
    """Words of a text and the spans in any occurrence of a window of an item."""
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for item in items:
        w = words_of(item)
        n = min(window, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    words = words_of(text)
    hit = [False] * len(words)
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit[i : i + n] = [True] * n
    spans = []
    for i, h in enumerate(hit):
        if h and spans and spans[-1][1] == i:
            spans[-1] = (spans[-1][0], i + 1)
        elif h:
            spans.append((i, i + 1))
    return words, spans
