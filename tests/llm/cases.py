"""Small tables with every odd case, and plain versions of what the operators compute."""

from __future__ import annotations

import re
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def ascii_lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return WORD.findall(ascii_lower(text or ""))


def sentence(start: int, n: int) -> str:
    return " ".join(f"w{(start * 7 + i * i) % 1009}x{i}" for i in range(n))


def rows() -> list[tuple]:
    """Equal and similar texts, nulls, empty and very long texts, repeated rows."""
    texts: list[str | None] = [None, "", "  \n\t", "one", "Four words are here", "... !!! 123"]
    texts += [sentence(k, 12 + 9 * k) for k in range(12)]
    texts += [texts[10], texts[10], texts[12] + " tail", "Extra " + texts[12], texts[15].upper()]
    texts += [sentence(99, 30_000), "Ünïcödé naïve façade " * 6, "a <|endoftext|> b", "x  y \n z "]
    out = [(i, text, ("en", "de", None)[i % 3], ("s1", None, "s0")[i % 3], 0) for i, text in enumerate(texts)]
    return [*out, out[7], out[7], (None, "text without an id", "en", "s0", None)]


def jaccard_links(texts: dict[int, str | None]) -> list[tuple[int, int]]:
    sets = {
        i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set()
        for i, t in texts.items()
    }
    both: Counter = Counter()
    holders: dict = {}
    for i, own in sets.items():
        for one in own:
            for j in holders.setdefault(one, []):
                both[j, i] += 1
            holders[one].append(i)
    return [
        (a, b) for (a, b), n in both.items()
        if a != b and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)
    ]


def smallest_reachable(nodes, links) -> dict[int, int]:
    label = {i: i for i in nodes}

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    return {i: root(i) for i in nodes}
