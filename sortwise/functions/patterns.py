"""Regex builders for literal sets.

A lexicon test such as "does the text contain any of these 238 words" is one
``rlike`` over a prefix-trie alternation: the JVM regex engine then compares
about one character per branch level instead of trying every literal at every
position, and the whole test is a single small expression in the generated
code (hundreds of ``contains`` calls would blow the codegen method limit).
"""

from __future__ import annotations

# Characters Python's str.split()/str.strip() treat as whitespace.
WS_CLASS = ("\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029"
            "\\u202f\\u205f\\u3000")
WORD_CLASS = "\\p{L}\\p{N}_"


def _esc(ch: str) -> str:
    return ch if ch.isalnum() else "\\" + ch if ch != " " else " "


def trie_regex(words) -> str:
    """Alternation of literal ``words`` arranged as a prefix trie."""
    words = sorted(set(w for w in words))
    if not words:
        return "(?!)"

    def build(ws: list[str]) -> str:
        ends = "" in ws
        rest = [w for w in ws if w]
        groups: dict[str, list[str]] = {}
        for w in rest:
            groups.setdefault(w[0], []).append(w[1:])
        alts = [_esc(c) + build(sub) for c, sub in groups.items()]
        if not alts:
            return ""
        body = alts[0] if len(alts) == 1 else "(?:" + "|".join(alts) + ")"
        if ends:
            return "(?:" + body + ")?"
        return body

    return build(words)


def word_regex(words, case_insensitive: bool = True) -> str:
    """Java regex equal to Python's ``re.search(r'\\b(w1|w2)\\b', s, re.I)``:
    \\b is Unicode-aware in Python, so it is spelled out with look-arounds."""
    flags = "(?iu)" if case_insensitive else ""
    return (f"{flags}(?<![{WORD_CLASS}])(?:{trie_regex(words)})(?![{WORD_CLASS}])")
