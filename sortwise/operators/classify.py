"""Rule cascade.

The 43 rules are an ordered list of ``(rule_id, condition)`` pairs over the
columns ``message`` (stripped original), ``norm`` (normalised) and
``lemmas`` (lemma per token).  ``classify`` folds them into one
``CASE WHEN`` so each row stops at its first matching rule; ``evidence``
evaluates every rule for the audit reports.  Both are narrow projections:
no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions.lemma import Lexicon


class Features:
    """Column expressions shared by the rules (built once per plan) over a frame that
    ``prepare`` and ``with_literals`` have gone over.  ``found`` names the column of literals
    that ``literal_index().scan`` found in ``norm``."""

    def __init__(self, lex: Lexicon, orig: str = "message", norm: str = "norm",
                 lemmas: str = "lemmas", found: str = "literals_found", text: T.IndexedText | None = None):
        self.lex = lex
        self.columns = (orig, norm, lemmas, found)
        self.o = F.col(orig)
        self.n = text or T.IndexedText(F.col(norm), F.col(found), literal_index())
        self.lemmas = F.col(lemmas)
        self.nw = F.size(self.lemmas)          # one lemma per token of norm
        self.len_o = F.length(self.o)
        self.ns = T.strip_ws(F.col(norm))
        self.lemma_text = F.col("lemma_text")
        self.has_verb = F.col("has_verb")
        self.long_conv = (self.len_o > 100) & (self.nw > 15) & T.has_any(self.n, L.LONG_CONV_TERMS)

    # P10 ------------------------------------------------------------------
    def integration_intent(self) -> Column:
        n, lt, hv = self.n, self.lemma_text, self.has_verb
        has, any_ = T.has, T.has_any
        excluded = any_(n, L.INTENT_CAPACITY) | T.intent_narrative(n) \
            | any_(n, L.INTEGRATION_EXCLUSIONS)
        email_ctx = (has(n, "email") | has(n, "e-mail")) & (hv | has(n, "para") | has(n, "@")) \
            & any_(n, L.EMAIL_CONTEXTS)
        doc = (has(n, "documento") | has(n, "doc ") | T.raw(n).endswith("doc")) & hv
        arquivo = has(n, "arquivo") & (hv | has(lt, "baixar") | has(n, "compartilhado"))
        calendar = (has(n, "agenda") | has(n, "calendar")) & hv & ~has(n, "tempo")
        share = has(lt, "compartilhar") & any_(n, L.SHARE_CONTEXTS)
        schedule = any_(lt, ["marcar", "agendar", "reservar"]) & any_(n, L.SCHEDULE_CONTEXTS)
        cancel = any_(lt, ["cancelar", "reagendar"]) & any_(n, L.CANCEL_CONTEXTS)
        verb_object = hv & any_(n, L.GENERIC_OBJECTS_WITH_VERB)
        found = any_(n, L.INTEGRATION_OBJECTS) | email_ctx | has(n, "@") | has(n, ".com") \
            | doc | arquivo | calendar | share | schedule | cancel | verb_object
        return ~excluded & found

    # R36 ------------------------------------------------------------------
    def complex_or_personal(self) -> Column:
        o, n = self.o, self.n
        simple_task = T.has_any(n, L.SIMPLE_TASKS) & (self.len_o < 80)
        improvement = T.has(n, L.IMPROVEMENT_PHRASE) | (
            T.has(n, "melhorar") & T.has_any(n, L.IMPROVEMENT_CONTEXT))
        return ~simple_task & (T.personal_cue(o) | T.plan_cue(o) | (T.sentence_marks(o) > 1)
                               | T.has_any(n, L.PERSONALISATION) | improvement)

    # R11 ------------------------------------------------------------------
    def _pronoun_parts(self):
        n = self.n
        a = ~T.has_any(n, L.CLEAR_NOUNS) & T.has_any(n, [s for s, _ in L.LOOSE_PRONOUNS])
        b = T.has(n, " e pra ela") | T.has(n, " e pra ele")
        c = (T.has(n, " pra ela") | T.has(n, " pra ele")) & ~T.has_any(n, L.PROPER_NAMES)
        return a, b, c

    def pronoun_name(self) -> Column:
        n = self.n
        a, b, c = self._pronoun_parts()
        return (F.when(c, F.when(T.has(n, " pra ela"), "ela").otherwise("ele"))
                .when(b, F.when(T.has(n, " e pra ela"), "ela/ele").otherwise("ele"))
                .when(a, T.first_found(n, L.LOOSE_PRONOUNS)))

    def double_intent_verbs(self) -> Column:
        return T.found_in_order(self.n, L.DOUBLE_INTENT_VERBS)


def rules(f: Features) -> list[tuple[str, Column]]:
    """The cascade, in evaluation order."""
    o, n, ns, nw, len_o = f.o, f.n, f.ns, f.nw, f.len_o
    has, any_ = T.has, T.has_any
    short = (len_o <= 15) & (nw <= 2)
    a, b, c = f._pronoun_parts()
    return [
        ("R01", short & any_(n, L.SHORT_GREETINGS)),
        ("R02", short & ns.isin(L.CONFIRMATIONS)),
        ("R03", short & any_(n, L.SHORT_UNCERTAINTY)),
        ("R04", short & ns.isin(L.LONE_WORDS)),
        ("R05", short & ns.isin(L.DEMONSTRATIVES)),
        ("R06", short & ns.isin(L.LONE_INTERROGATIVES)),
        ("R07", short & (nw == 1) & (F.length(ns) < 6)),
        ("R08", (nw <= 3) & (len_o < 20) & any_(n, L.TEST_WORDS)),
        ("R09", any_(n, L.CONVERSATIONAL)),
        ("R10", any_(n, L.REST_PHRASES)),
        ("R11", ~f.long_conv & (a | b | c)),
        ("R12", any_(n, L.VAGUE_REFERENCES)),
        ("R13", any_(n, L.VAGUE_TERMS)),
        ("R14", any_(n, L.OPEN_CONDITIONS)),
        ("R15", any_(n, [p for p, _ in L.GENERIC_OBJECT_ACTIONS])
         & any_(n, L.GENERIC_OBJECT_WORDS) & ~any_(n, L.OBJECT_SPECIFIERS)),
        ("R16", has(n, L.REDO_MARK) & any_(n, L.REDO_VERBS) & ~any_(n, L.REDO_SPECIFIERS)),
        ("R17", any_(n, [p for p, _ in L.GENERIC_DESTINATIONS])
         & ~any_(n, L.DESTINATION_NAMES) & ~any_(n, L.DESTINATION_SPECIFIERS)),
        ("R18", any_(n, [p for p, _ in L.OTHER_DESTINATIONS])
         & ~any_(n, L.OTHER_DESTINATION_SPECIFIERS)),
        ("R19", any_(n, L.DOUBLE_INTENT_CONNECTORS) & any_(n, L.DOUBLE_INTENT_VERBS)
         & (F.size(f.double_intent_verbs()) >= 2)
         & ~any_(n, L.DOUBLE_INTENT_CAPACITY)),
        ("R20", any_(n, [p for p, _ in L.POLYSEMOUS])),
        ("R21", f.long_conv),
        ("R22", any_(n, L.UNCERTAINTY) & any_(n, L.UNCERTAIN_ACTIONS)),
        ("R23", has(n, " ou ") & o.endswith("?") & any_(n, L.OPTION_WORDS)),
        ("R24", any_(n, L.CAPACITY_QUESTIONS)),
        ("R25", any_(n, L.INTERNAL_SYSTEM) & (any_(n, L.INTERNAL_VERBS) | has(n, L.INTERNAL_CHECK))),
        ("R26", any_(n, L.EXTERNAL_APIS)),
        ("R27", any_(n, L.SYSTEM_KEYWORDS) & f.integration_intent()),
        ("R28", T.narrative(n)),
        ("R29", any_(n, L.PERSONAL_TASKS)),
        ("R30", any_(n, L.GENERIC_HELP)),
        ("R31", any_(n, L.GREETING_QUESTIONS) & has(o, "?")),
        ("R32", any_(n, L.HYPOTHETICALS)),
        ("R33", any_(n, L.COMMAND_OBJECTS) & any_(f.lemma_text, f.lex.infinitives)
         & ~has(o, "?") & ~any_(n, L.ABSTRACT_WORDS)),
        ("R34", ((len_o <= 80) & o.endswith("?")) | T.factual_cue(n)),
        ("R35", T.is_question(o)),
        ("R36", f.complex_or_personal()),
        ("R37", (T.piece_sum(o) > 2) | (len_o > 150)),
        ("R38", any_(F.concat(F.lit(" "), T.raw(n), F.lit(" ")), L.PERSONAL_PRONOUNS)),
        ("R39", (len_o < 10) & any_(n, L.FALLBACK_GREETINGS)),
        ("R40", len_o < 10),
        ("R41", F.exists(F.col("tokens"), lambda t: t.isin(L.FALLBACK_INTERROGATIVES))
         & ~has(o, "?") & ~any_(n, L.FALLBACK_TECHNICAL)),
        ("R42", len_o < 20),
        ("R43", F.lit(True)),
    ]


def reason(f: Features, rule_id: Column | None = None) -> Column:
    """Reason text of the winning rule (column ``rule_id`` unless given); templates are
    filled from the row."""
    return _tree(f.lex, ("reason", *f.columns), lambda: _reason(f, F.col("rule_id"))) if rule_id is None \
        else _reason(f, rule_id)


def _reason(f: Features, rule_id: Column) -> Column:
    n = f.n
    R = L.REASONS

    def fill(key: str, detail: Column) -> Column:
        pre, post = R[key].split("{}")
        return F.concat(F.lit(pre), detail, F.lit(post))

    templated = {
        "R11": fill("R11", f.pronoun_name()),
        "R15": fill("R15", T.first_found(n, L.GENERIC_OBJECT_ACTIONS)),
        "R17": fill("R17", T.first_found(n, L.GENERIC_DESTINATIONS)),
        "R18": fill("R18", T.first_found(n, L.OTHER_DESTINATIONS)),
        "R19": fill("R19", F.array_join(F.slice(f.double_intent_verbs(), 1, 2), ", ")),
        "R20": fill("R20", T.first_found(n, L.POLYSEMOUS)),
        "R27": fill("R27", F.array_join(F.slice(T.found_in_order(n, L.SYSTEM_KEYWORDS), 1, 6), ", ")),
        "R35": F.when(T.has_any(n, L.TECHNICAL_QUESTION_TERMS), F.lit(R["R35_TECH"]))
                .otherwise(F.lit(R["R35"])),
    }
    expr = None
    for rid in L.RULE_IDS:
        val = templated.get(rid, F.lit(R[rid]))
        expr = F.when(rule_id == rid, val) if expr is None else expr.when(rule_id == rid, val)
    return expr


def _tree(lex: Lexicon, key, build):
    """Column trees are independent of any DataFrame; building one costs thousands
    of JVM calls, so a lexicon keeps those built for it, by their input columns."""
    if key not in lex.trees:
        lex.trees[key] = build()
    return lex.trees[key]


def first_rule(f: Features) -> Column:
    return _tree(f.lex, ("first_rule", *f.columns), lambda: _first_rule(f))


def _first_rule(f: Features) -> Column:
    expr = None
    for rid, cond in rules(f):
        expr = F.when(cond, F.lit(rid)) if expr is None else expr.when(cond, F.lit(rid))
    return expr


def bucket_of(rule_id: Column) -> Column:
    kv = ", ".join(f"'{rid}', '{L.RULE_BUCKETS[rid]}'" for rid in L.RULE_IDS)
    return F.try_element_at(F.expr(f"map({kv})"), rule_id)


_INDEX: T.LiteralIndex | None = None


def literal_index() -> T.LiteralIndex:
    """Every literal that a rule or a reason looks for in ``norm``, learnt from the rules."""
    global _INDEX
    if _INDEX is None:
        seen = T.LiteralCollector()
        f = Features(Lexicon(), text=seen)
        rules(f)
        _reason(f, F.lit(""))
        _INDEX = T.LiteralIndex(seen.literals)
    return _INDEX


def with_literals(df: DataFrame, lex: Lexicon) -> DataFrame:
    """What many rules look at, once a row: ``literals_found`` (what one scan of ``norm``
    finds of all rules' literals), ``lemma_text`` and ``has_verb``."""
    return df.withColumns(_tree(lex, "literals_found", lambda: {
        "literals_found": literal_index().scan(F.col("norm")), "lemma_text": F.array_join("lemmas", " "),
        "has_verb": F.exists("lemmas", lambda m: m.isin(lex.infinitives))}))


SHARED = ("literals_found", "lemma_text", "has_verb")


def prepare(df: DataFrame, lex: Lexicon, text_col: str = "message") -> DataFrame:
    """message (stripped), norm and lemmas."""
    return (df.withColumn("message", T.strip_ws(F.coalesce(F.col(text_col).cast("string"),
                                                           F.lit(""))))
              .withColumns({"norm": _tree(lex, "norm", lambda: T.normalize(F.col("message")))})
              .withColumn("tokens", _tree(lex, "tokens", lambda: T.tokens(F.col("norm"))))
              .withColumn("lemmas", _tree(lex, "lemmas", lambda: F.transform(F.col("tokens"), lex.lemma))))


def classify(df: DataFrame, lex: Lexicon | None = None, text_col: str = "message",
             prepared: bool = False) -> DataFrame:
    """First matching rule -> rule_id, bucket, reason."""
    lex = lex or default_lexicon()
    if not prepared:
        df = prepare(df, lex, text_col)
    df = with_literals(df, lex)
    f = Features(lex)
    return (df.withColumn("rule_id", first_rule(f))
              .withColumn("bucket", bucket_of(F.col("rule_id")))
              .withColumn("reason", reason(f)).drop(*SHARED))


def evidence(df: DataFrame, lex: Lexicon | None = None, text_col: str = "message",
             prepared: bool = False) -> DataFrame:
    """Every rule each message satisfies -> array<string> matched_rules."""
    lex = lex or default_lexicon()
    if not prepared:
        df = prepare(df, lex, text_col)
    df = with_literals(df, lex)
    f = Features(lex)
    hits = _tree(lex, ("evidence", *f.columns),
                 lambda: F.array(*[F.when(cond, F.lit(rid)) for rid, cond in rules(f)]))
    return df.withColumn("matched_rules", F.filter(hits, lambda x: x.isNotNull())).drop(*SHARED)


def reclassify(df: DataFrame) -> DataFrame:
    """C4: a 'system' verdict without any scope becomes 'messages' (<=15 words
    in the original text) or 'user'; the reason is appended."""
    no_scope = (F.col("bucket") == "system") & (F.size(F.col("scope")) == 0)
    new_bucket = F.when(F.size(T.tokens(F.col("message"))) <= L.RECLASSIFY_MAX_WORDS,
                        F.lit("messages")).otherwise(F.lit("user"))
    pre, post = L.REASONS["RECLASSIFIED"].split("{}")
    return (df.withColumn("reclassified", no_scope)
              .withColumn("bucket", F.when(no_scope, new_bucket).otherwise(F.col("bucket")))
              .withColumn("reasons", F.when(F.col("reclassified"), F.array(
                  F.col("reason"), F.concat(F.lit(pre), F.col("bucket"), F.lit(post))))
                  .otherwise(F.array(F.col("reason")))))


_DEFAULT: Lexicon | None = None


def default_lexicon() -> Lexicon:
    """Static verb lexicon plus the shipped learned lexicon."""
    global _DEFAULT
    if _DEFAULT is None:
        from ..sources.lexicon_io import shipped_learned_map
        _DEFAULT = Lexicon(learned=shipped_learned_map())
    return _DEFAULT
