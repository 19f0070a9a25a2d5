"""Column expressions for text features.

All functions take and return ``Column`` objects built from
``pyspark.sql.functions``; nothing here leaves the JVM.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .patterns import WS_CLASS, trie_regex, word_regex

# ---------------------------------------------------------------------------
# Normalisation (lower case, then transliterate to ASCII)
# ---------------------------------------------------------------------------
# FIXED VALUES: transliterations that no decomposition gives.
SPECIAL_TRANSLIT = [
    ("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ŋ", "ng"),
    ("ø", "o"), ("ð", "d"), ("đ", "d"), ("ħ", "h"), ("ı", "i"), ("ł", "l"),
    ("‘", "'"), ("’", "'"), ("‚", ","), ("“", '"'), ("”", '"'), ("„", ",,"), ("′", "'"), ("″", '"'),
    ("‐", "-"), ("‑", "-"), ("‒", "-"), ("–", "-"), ("—", "--"), ("―", "--"), ("…", "..."),
    ("«", "<<"), ("»", ">>"), ("‹", "<"), ("›", ">"), ("¿", "?"), ("¡", "!"), ("•", "*"), ("·", "*"),
    ("×", "x"), ("÷", "/"), ("−", "-"), ("©", "(c)"), ("®", "(r)"), ("€", "EUR"), ("£", "PS"),
    ("°", "deg"), ("§", "SS"), ("½", "1/2"), ("¼", "1/4"), ("¾", "3/4"),
    ("\u2028", "\n"), ("\u2029", "\n\n"),
    # Greek and Cyrillic letters
    ("α", "a"), ("β", "b"), ("γ", "g"), ("δ", "d"), ("ε", "e"), ("ζ", "z"), ("η", "e"), ("θ", "th"),
    ("ι", "i"), ("κ", "k"), ("λ", "l"), ("μ", "m"), ("ν", "n"), ("ξ", "x"), ("ο", "o"), ("π", "p"),
    ("ρ", "r"), ("σ", "s"), ("ς", "s"), ("τ", "t"), ("υ", "u"), ("φ", "ph"), ("χ", "kh"), ("ψ", "ps"), ("ω", "o"),
    ("а", "a"), ("б", "b"), ("в", "v"), ("г", "g"), ("д", "d"), ("е", "e"), ("ж", "zh"), ("з", "z"), ("и", "i"),
    ("й", "i"), ("к", "k"), ("л", "l"), ("м", "m"), ("н", "n"), ("о", "o"), ("п", "p"), ("р", "r"), ("с", "s"),
    ("т", "t"), ("у", "u"), ("ф", "f"), ("х", "kh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "shch"),
    ("ъ", '"'), ("ы", "y"), ("ь", "'"), ("э", "e"), ("ю", "iu"), ("я", "ia"),
]
#: Blocks whose letters, signs and spaces are transliterated by their decomposition.
DECOMPOSED = [(0xA0, 0x250), (0x370, 0x400), (0x1E00, 0x2000), (0x2000, 0x2150), (0x3000, 0x3001), (0xFB00, 0xFB07),
              (0xFF01, 0xFF5F)]


def _translit_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters with a one-letter transliteration, those letters, and (character,
    text) for all others.  What is in neither is dropped."""
    table = dict(SPECIAL_TRANSLIT)
    for lo, hi in DECOMPOSED:
        for ch in map(chr, range(lo, hi)):
            parts = unicodedata.normalize("NFKD", ch)
            base = "".join(table.get(c, c) for c in parts if unicodedata.category(c) != "Mn").lower()
            if ch.lower() == ch and ch not in table and base and base.isascii():
                table[ch] = base
    one = {c: r for c, r in table.items() if len(r) == 1}
    return "".join(one), "".join(one.values()), [(c, r.lower()) for c, r in table.items() if len(r) > 1]


_SRC, _DST, _MULTI = _translit_tables()


#: Distinct characters outside ASCII up to which a text is transliterated by character.
FEW_LETTERS = 40


def normalize(c: Column) -> Column:
    """lower + transliteration to ASCII; ASCII white space is kept as it is.

    Accents go with their letters whether composed or not; emoji, joiners, variation
    selectors and characters without a transliteration are dropped.  Texts in plain
    ASCII, told by comparing their sizes in bytes and characters, skip all this.  In most
    others a few letters outside ASCII come again and again: each is transliterated once
    and replaced by a search of bytes, where ``translate`` looks up every character of the
    text.  Both give the same, as what replaces a character is always ASCII."""
    low = F.lower(c)
    found = F.array_distinct(F.regexp_extract_all(low, F.lit("[^\\x00-\\x7F]"), F.lit(0)))
    # an array of one, so that the characters are found once a text
    by_letter = F.transform(F.array(found), lambda letters: F.when(F.size(letters) <= FEW_LETTERS, F.aggregate(
        letters, low, lambda text, x: F.replace(text, x, _transliterate(x)))))[0]
    return F.when(_is_ascii(low), low).otherwise(
        F.transform(F.array(by_letter), lambda t: F.when(_is_ascii(t), t).otherwise(_transliterate(low)))[0])


def _is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def _transliterate(low: Column) -> Column:
    out = F.translate(low, _SRC, _DST)
    rare = F.translate(out, "".join(s for s, _ in _MULTI), "")
    wide = out
    for s, r in _MULTI:
        wide = F.replace(wide, F.lit(s), F.lit(r))
    out = F.when(F.length(rare) == F.length(out), out).otherwise(wide)
    return F.regexp_replace(out, "[^\\x00-\\x7F]+", "")


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: removes Unicode whitespace at both ends
    (Spark's ``trim`` removes only spaces)."""
    return F.regexp_replace(c, f"^[{WS_CLASS}]+|[{WS_CLASS}]+$", "")


def tokens(c: Column) -> Column:
    """Python ``str.split()``: non-empty runs between whitespace."""
    return F.filter(F.split(c, f"[{WS_CLASS}]+"), lambda x: x != F.lit(""))


def n_words(c: Column) -> Column:
    return F.size(tokens(c))


# ---------------------------------------------------------------------------
# Lexicon flags
# ---------------------------------------------------------------------------
class LiteralIndex:
    """All literals that many tests look for in one text.  ``scan`` reads the text once: a
    look-ahead over the trie of all literals gives the longest one that starts at each
    place, and every literal that occurs is one of those or begins one.  Literals of less
    than ``LEAST`` characters stand almost everywhere and are searched for by themselves."""

    LEAST = 3

    def __init__(self, literals):
        self.literals = sorted({x for x in literals if len(x) >= self.LEAST})

    def scan(self, c: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?=({trie_regex(self.literals)}))"), F.lit(1)))

    def longer(self, literal: str) -> list[str]:
        """Literals of the index that begin with ``literal``, itself included."""
        at = bisect_left(self.literals, literal)
        out = []
        while at < len(self.literals) and self.literals[at].startswith(literal):
            out.append(self.literals[at])
            at += 1
        if not out or out[0] != literal:
            raise KeyError(literal)
        return out


class IndexedText:
    """A text column and the literals that ``index.scan`` found in it.  ``has``, ``has_any``,
    ``first_found`` and ``found_in_order`` take it like a column."""

    def __init__(self, text: Column, found: Column, index: LiteralIndex):
        self.text, self.found, self.index = text, found, index

    def has_any(self, literals) -> Column:
        long = sorted({y for x in literals if len(x) >= LiteralIndex.LEAST for y in self.index.longer(x)})
        out = F.arrays_overlap(self.found, literal_array(long)) if long else None
        for x in literals:
            if len(x) < LiteralIndex.LEAST:
                out = has(self.text, x) if out is None else out | has(self.text, x)
        return out

    def in_order(self, literals) -> Column:
        return F.filter(literal_array(literals), lambda k: F.exists(self.found, lambda x: F.startswith(x, k)))


class LiteralCollector(IndexedText):
    """Stands for a text while tests are built only to learn what they look for."""

    def __init__(self):
        super().__init__(F.lit(""), F.lit(None), LiteralIndex([]))
        self.literals: set[str] = set()

    def has_any(self, literals) -> Column:
        self.literals.update(literals)
        return F.lit(True)

    def in_order(self, literals) -> Column:
        self.literals.update(literals)
        return F.array(F.lit(""))


def raw(c: Column | IndexedText) -> Column:
    return c.text if isinstance(c, IndexedText) else c


def has(c: Column | IndexedText, literal: str) -> Column:
    if isinstance(c, IndexedText):
        return c.has_any([literal])
    return F.instr(c, literal) > 0


SHORT_LIST = 3


def has_any(c: Column, literals) -> Column:
    """Does ``c`` contain any literal as a substring (no word limits)."""
    literals = list(literals)
    if isinstance(c, IndexedText):
        return c.has_any(literals)
    if len(literals) <= SHORT_LIST:
        # a few byte-level searches beat one regex (no UTF-16 decode of the text)
        out = has(c, literals[0])
        for x in literals[1:]:
            out = out | has(c, x)
        return out
    return c.rlike(trie_regex(literals))


def equals_any(c: Column, literals) -> Column:
    return c.isin(list(literals))


def first_found(c: Column, pairs) -> Column:
    """Second item of the first (literal, value) pair whose literal occurs."""
    expr = None
    for lit_, val in pairs:
        expr = (F.when(has(c, lit_), F.lit(val)) if expr is None
                else expr.when(has(c, lit_), F.lit(val)))
    return expr


def sql_str(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_array(literals) -> Column:
    """array<string> literal built as one SQL expression (one JVM call)."""
    return F.expr("array(" + ", ".join(sql_str(x) for x in literals) + ")")


FEW = 32


def found_in_order(c: Column, literals) -> Column:
    """array of the literals contained in ``c``, in list order.

    A long list costs one scan of the text: a look-ahead over a prefix trie gives the
    longest literal that starts at each place, and every literal in the text lies
    in one of those, as it is itself the longest at its place or begins a longer one."""
    literals = list(literals)
    if isinstance(c, IndexedText):
        return c.in_order(literals)
    if len(literals) <= FEW:
        return F.filter(literal_array(literals), lambda k: F.instr(c, k) > 0)
    longest = F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?=({trie_regex(literals)}))"), F.lit(1)))
    return F.transform(F.array(longest), lambda found: F.filter(
        literal_array(literals), lambda k: F.exists(found, lambda x: F.startswith(x, k))))[0]


def explode_values(df, arr: Column, name: str):
    """Rows of the non-null elements of ``arr``.

    ``explode`` makes the optimiser infer ``size(arr) > 0`` and push that
    predicate down through every projection below it, substituting the whole
    chain of derived columns into it (the plan grows by orders of magnitude).
    ``explode_outer`` infers no filter; the null filter on the generated
    column cannot move below the generator."""
    return df.select(F.explode_outer(arr).alias(name)).where(F.col(name).isNotNull())


# ---------------------------------------------------------------------------
# Sizes and sentence marks
# ---------------------------------------------------------------------------
def count_chars(c: Column, chars: str) -> Column:
    cls = "".join("\\" + ch for ch in chars)
    return F.regexp_count(c, F.lit(f"[{cls}]"))


def nonblank_pieces(c: Column, sep: str) -> Column:
    """len([s for s in c.split(sep) if s.strip()])"""
    parts = F.split(c, "\\" + sep, -1)
    return F.size(F.filter(parts, lambda s: s.rlike(f"[^{WS_CLASS}]")))


def piece_sum(c: Column) -> Column:
    return nonblank_pieces(c, ".") + nonblank_pieces(c, "?") + nonblank_pieces(c, "!")


# ---------------------------------------------------------------------------
# Regex cues with Python \b semantics
# ---------------------------------------------------------------------------
def pt_cue(orig: Column) -> Column:
    return orig.rlike(f"(?iu)[{L.PT_ACCENT_CLASS}]") | orig.rlike(word_regex(L.PT_WORDS))


def en_cue(orig: Column) -> Column:
    return orig.rlike(word_regex(L.EN_WORDS))


def language(orig: Column) -> Column:
    """'en' only with an English cue and no Portuguese cue."""
    return F.when(en_cue(orig) & ~pt_cue(orig), F.lit("en")).otherwise(F.lit("pt"))


def factual_cue(norm: Column | IndexedText) -> Column:
    return raw(norm).rlike(word_regex(L.FACTUAL_TERMS))


def personal_cue(orig: Column) -> Column:
    return orig.rlike(word_regex(L.PERSONAL_REFERENCES))


def plan_cue(orig: Column) -> Column:
    return orig.rlike(word_regex(L.PLAN_TERMS))


def sentence_marks(orig: Column) -> Column:
    return count_chars(orig, L.SENTENCE_MARKS)


# ---------------------------------------------------------------------------
# Question detector (lower-cased original, accents kept)
# ---------------------------------------------------------------------------
def is_question(orig: Column) -> Column:
    low = F.lower(orig)
    # first whitespace-separated word (anchored: reads only the text's head)
    first = F.regexp_extract(low, f"^[{WS_CLASS}]*([^{WS_CLASS}]+)", 1)
    asks = (F.instr(orig, "?") > 0) | first.isin(L.QUESTION_FIRST_WORDS) \
        | has_any(low, L.QUESTION_PHRASES)
    return ~has_any(low, L.QUESTION_PERSONAL) & ~has_any(low, L.QUESTION_DETAILED) & asks


# ---------------------------------------------------------------------------
# Third-person past narrative (two list variants)
# ---------------------------------------------------------------------------
def narrative(norm: Column) -> Column:
    return has_any(norm, L.NARRATIVE_SUBJECTS) & has_any(norm, L.NARRATIVE_PAST)


def intent_narrative(norm: Column) -> Column:
    return has_any(norm, L.INTENT_NARRATIVE_SUBJECTS) & has_any(norm, L.INTENT_NARRATIVE_PAST)
