"""Token lemmatisation as a narrow column expression.

lemma(token) = static form map, else learned map, else the token itself.
Membership is tested with ``isin`` over the form list, which the optimiser
turns into a hash-set lookup (``InSet``); only tokens that are known forms pay
for the map lookup.  The expression runs inside ``transform`` on the token
array, so lemmatising a message needs no explode, join or shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import tokens


class Lexicon:
    """Static and learned form->lemma maps, as driver-side constants.

    The maps become literals of the plan.  A lexicon kept as a table, which may
    grow with the data, goes through ``operators.tokens.lemmatise_messages`` (joins).

    ``trees`` keeps the column trees built for this lexicon, by their input columns.
    """

    def __init__(self, static: dict[str, str] | None = None,
                 learned: dict[str, str] | None = None):
        self.static = dict(L.verb_map() if static is None else static)
        self.learned = dict(learned or {})
        self.infinitives = sorted(set(self.static.values()) | set(L.EXTRA_INFINITIVES))
        self._cache: dict = {}
        self.trees: dict = {}

    @staticmethod
    def _sql_str(x: str) -> str:
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def lemmas(self, norm: Column) -> Column:
        """array of lemmas, one per token of ``norm``."""
        return F.transform(tokens(norm), self.lemma)

    def lemma(self, x: Column) -> Column:
        """static map, else learned map, else the token (maps are built as one
        SQL literal each: a single call into the JVM)."""
        static = list(self.static)
        out = F.when(x.isin(static), F.try_element_at(self._static_map(), x))
        if self.learned:
            out = out.when(x.isin(list(self.learned)),
                           F.try_element_at(self._learned_map(), x))
        return out.otherwise(x)

    def _static_map(self) -> Column:
        if "smap" not in self._cache:
            q = self._sql_str
            self._cache["smap"] = "map(" + ", ".join(f"{q(k)}, {q(v)}" for k, v in self.static.items()) + ")"
        return F.expr(self._cache["smap"])

    def _learned_map(self) -> Column:
        if "lmap" not in self._cache:
            q = self._sql_str
            self._cache["lmap"] = "map(" + ", ".join(f"{q(k)}, {q(v)}" for k, v in self.learned.items()) + ")"
        return F.expr(self._cache["lmap"])

    def lemma_text(self, norm: Column) -> Column:
        return F.array_join(self.lemmas(norm), " ")

    def action_verbs(self, lemmas: Column) -> Column:
        """distinct lemmas that are action infinitives, sorted."""
        return F.array_sort(F.array_distinct(
            F.filter(lemmas, lambda m: m.isin(self.infinitives))))
