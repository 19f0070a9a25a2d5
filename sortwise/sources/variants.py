"""Messages that touch every literal of the rules.

One text per literal of every cascade, scope and cue list, once as it is and once
varied: upper case, an emoji behind it, accents (composed and not), typographic
quotes and dots, a question mark, words around it.  ``tables.msg_variants`` joins
``events`` to these texts, so all of them recur and the work grows with ``events``.
"""

from __future__ import annotations

import unicodedata

from ..functions import lexicon as L

#: Accented spellings whose normalised form the literal lists hold.
ACCENTED = [("reuniao", "reunião"), ("relatorio", "relatório"), ("curriculo", "currículo"), ("calendario", "calendário"),
            ("nao", "não"), ("voce", "você"), ("amanha", "amanhã"), ("ola", "olá"), ("estrategia", "estratégia"),
            ("sessao", "sessão"), ("necessario", "necessário"), ("tambem", "também"), ("e", "é"), ("a", "á")]

NOT_LITERALS = {"BUCKETS", "RULE_IDS"}


def literals() -> list[str]:
    """Every literal of the lexicon's lists, in order, without repeats."""
    out: dict[str, None] = {}
    for name, value in vars(L).items():
        if name.isupper() and isinstance(value, list) and name not in NOT_LITERALS:
            for item in value:
                out.setdefault((item if isinstance(item, str) else item[0]).strip())
    return [x for x in out if x]


def accented(text: str) -> str:
    for plain, mark in ACCENTED:
        if plain in text:
            return text.replace(plain, mark)
    return text + " já"


VARY = [
    str.upper,
    lambda s: s + " 👍",
    accented,
    lambda s: unicodedata.normalize("NFD", accented(s)),
    lambda s: f"“{s}”…",
    lambda s: s + "?",
    lambda s: f"por favor, {s} hoje",
    lambda s: f"  {s}‍!\n",
    lambda s: f"meu {s}; depois te conto. Preciso disso. Obrigado!",
]


def variants() -> list[str]:
    out = []
    for i, text in enumerate(literals()):
        out += [text, VARY[i % len(VARY)](text)]
    return out


def variants_df(spark):
    return spark.createDataFrame(list(enumerate(variants())), "idx int, message string")
