"""DuckDB SQL for the oracle side of the correctness check.

Written separately from the Spark expressions: normalisation uses
``strip_accents``, lemmatisation joins unnested tokens to VALUES tables,
lexicon tests are OR-chains of ``contains`` and \\b becomes consuming
boundary groups (RE2 has no look-arounds).  Only the literal data is shared.
"""

from __future__ import annotations

from ..functions import lexicon as L
from ..sources.lexicon_io import shipped_learned_map
from ..sources.phrases import PHRASES
from ..sources.variants import variants

WS = ("[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
      "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


# The oracle's own transliterations, beyond DuckDB's strip_accents.
ORACLE_TRANSLIT = {
    "ss": "ß", "ae": "æ", "oe": "œ", "th": "þ", "ng": "ŋ", "o": "øº", "d": "ðđ", "h": "ħ", "i": "ı", "l": "ł", "a": "ª",
    "'": "‘’′", '"': "“”″", ",": "‚", ",,": "„", "-": "‐‑‒–−", "--": "—―", "...": "…", "<<": "«", ">>": "»",
    "<": "‹", ">": "›", "?": "¿", "!": "¡", "*": "•·", "x": "×", "/": "÷", "(c)": "©", "(r)": "®", "eur": "€",
    "ps": "£", "deg": "°", "1/2": "½", "1/4": "¼", "3/4": "¾", "2": "²", "3": "³", "1": "¹", "tm": "™",
    " ": "\u00a0\u2002\u2003\u2009\u202f\u3000",
}


def norm(x: str) -> str:
    """lower, accents off, own table, and whatever is not ASCII then goes."""
    one = {ch: r for r, chars in ORACLE_TRANSLIT.items() for ch in chars if len(r) == 1}
    out = f"translate(strip_accents(lower({x})), {q(''.join(one))}, {q(''.join(one.values()))})"
    for r, chars in ORACLE_TRANSLIT.items():
        for ch in chars if len(r) > 1 else "":
            out = f"replace({out}, {q(ch)}, {q(r)})"
    return f"regexp_replace({out}, '[^\\x00-\\x7F]+', '', 'g')"


def toks(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda t: t <> '')"


def c(x: str, lit: str) -> str:
    return f"contains({x}, {q(lit)})"


def anyc(x: str, lits) -> str:
    return "(" + " OR ".join(c(x, s) for s in lits) + ")"


def eq_any(x: str, lits) -> str:
    return f"({x} IN (" + ", ".join(q(s) for s in lits) + "))"


def re_escape(s: str) -> str:
    return "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in s)


def word_re(x: str, words) -> str:
    alts = "|".join(re_escape(w) for w in words)
    return f"regexp_matches({x}, {q('(?i)(^|[^\\p{L}\\p{N}_])(' + alts + ')($|[^\\p{L}\\p{N}_])')})"


def list_lit(xs) -> str:
    return "[" + ", ".join(q(s) for s in xs) + "]::VARCHAR[]"


def first_of(x: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN {c(x, p)} THEN {q(v)}" for p, v in pairs) + " END"


def found(x: str, lits) -> str:
    return f"list_filter({list_lit(lits)}, lambda k: contains({x}, k))"


def nonblank(x: str, sep: str) -> str:
    return f"len(list_filter(string_split({x}, {q(sep)}), lambda s: regexp_matches(s, '[^' || {q(WS[1:-1])} || ']')))"


def phrases_values() -> str:
    rows = ", ".join(f"({i}, {q(r)}, {q(m)}, {q(b)}, {q(fb)})" for i, r, m, b, fb in PHRASES)
    return f"(VALUES {rows}) AS ph(idx, rule, message, bucket, final_bucket)"


def msg_stream_sql(blank_signups: bool = False) -> str:
    msg = "CASE WHEN e.event_type = 'signup' THEN '' ELSE ph.message END" if blank_signups \
        else "ph.message"
    return (f"SELECT e.event_id AS msg_id, e.user_id AS sender, e.ts, e.event_type, "
            f"e.value AS latency_ms, {msg} AS message, ph.final_bucket AS expected, ph.rule "
            f"FROM events e JOIN {phrases_values()} "
            f"ON ((e.event_id * e.event_id + e.user_id) % 37) = ph.idx")


def msg_variants_sql() -> str:
    rows = ", ".join(f"({i}, {q(m)})" for i, m in enumerate(variants()))
    n = len(variants())
    return (f"SELECT e.event_id AS msg_id, e.user_id AS sender, e.ts, e.event_type, v.message "
            f"FROM events e JOIN (VALUES {rows}) AS v(idx, message) "
            f"ON ((e.event_id % {n}) * 13 + e.user_id % {n}) % {n} = v.idx")


def msg_conv_sql() -> str:
    return ("SELECT conv_id, turn, conv_id * 1000000 + turn AS msg_id, text AS message "
            "FROM conversations WHERE role = 'user'")


def msg_docs_sql() -> str:
    return "SELECT doc_id AS msg_id, text AS message, lang, source FROM documents"


def verb_values(extra: dict[str, str] | None = None) -> str:
    rows = ", ".join(f"({q(f)}, {q(lm)})" for f, lm in {**L.verb_map(), **(extra or {})}.items())
    return f"(VALUES {rows}) AS vf(form, lemma)"


def learned_values() -> str:
    rows = ", ".join(f"({q(f)}, {q(lm)})" for f, lm in shipped_learned_map().items())
    return f"(VALUES {rows}) AS lf(form, lemma)"


def features_cte(src_sql: str, extra: dict[str, str] | None = None) -> str:
    """CTEs base -> feat: msg columns + m (stripped), norm, toks, nw,
    lemma_text, has_verb.  ``extra`` adds forms to the static lexicon."""
    inf = ", ".join(q(x) for x in [*L.infinitives(), *(extra or {}).values()])
    return f"""
src AS ({src_sql}),
base AS (SELECT *, {strip("coalesce(CAST(message AS VARCHAR), '')")} AS m FROM src),
nrm AS (SELECT *, {norm("m")} AS norm FROM base),
tk AS (SELECT *, {toks("norm")} AS toks FROM nrm),
un AS (SELECT msg_id, UNNEST(toks) AS tok, UNNEST(generate_series(1, len(toks))) AS pos FROM tk),
lm AS (SELECT un.msg_id, un.pos, coalesce(vf.lemma, lf.lemma, un.tok) AS lemma
       FROM un LEFT JOIN {verb_values(extra)} ON un.tok = vf.form
               LEFT JOIN {learned_values()} ON un.tok = lf.form),
lagg AS (SELECT msg_id, string_agg(lemma, ' ' ORDER BY pos) AS lemma_text,
                bool_or(lemma IN ({inf})) AS has_verb,
                list_sort(list_distinct(list(lemma) FILTER (WHERE lemma IN ({inf})))) AS verbs
         FROM lm GROUP BY msg_id),
feat AS (SELECT tk.*, len(tk.toks) AS nw, coalesce(lagg.lemma_text, '') AS lemma_text,
                coalesce(lagg.has_verb, false) AS has_verb,
                coalesce(lagg.verbs, []::VARCHAR[]) AS verbs
         FROM tk LEFT JOIN lagg USING (msg_id))"""


# ---------------------------------------------------------------------------
# the cascade, spelled out again in SQL
# ---------------------------------------------------------------------------
def intent_sql(n: str = "norm", lt: str = "lemma_text", hv: str = "has_verb") -> str:
    excl = (f"({anyc(n, L.INTENT_CAPACITY)} OR ({anyc(n, L.INTENT_NARRATIVE_SUBJECTS)} AND "
            f"{anyc(n, L.INTENT_NARRATIVE_PAST)}) OR {anyc(n, L.INTEGRATION_EXCLUSIONS)})")
    email = (f"(({c(n, 'email')} OR {c(n, 'e-mail')}) AND ({hv} OR {c(n, 'para')} OR {c(n, '@')})"
             f" AND {anyc(n, L.EMAIL_CONTEXTS)})")
    doc = (f"(({c(n, 'documento')} OR {c(n, 'doc ')} OR {c(n, ' doc ')} OR ends_with({n}, 'doc') "
           f"OR starts_with({n}, 'doc ')) AND {hv})")
    arq = f"({c(n, 'arquivo')} AND ({hv} OR {c(lt, 'baixar')} OR {c(n, 'compartilhado')}))"
    cal = f"(({c(n, 'agenda')} OR {c(n, 'calendar')}) AND {hv} AND NOT {c(n, 'tempo')})"
    share = f"({c(lt, 'compartilhar')} AND {anyc(n, L.SHARE_CONTEXTS)})"
    sched = (f"(({c(lt, 'marcar')} OR {c(lt, 'agendar')} OR {c(lt, 'reservar')}) AND "
             f"{anyc(n, L.SCHEDULE_CONTEXTS)})")
    canc = f"(({c(lt, 'cancelar')} OR {c(lt, 'reagendar')}) AND {anyc(n, L.CANCEL_CONTEXTS)})"
    vog = f"({hv} AND {anyc(n, L.GENERIC_OBJECTS_WITH_VERB)})"
    hit = (f"({anyc(n, L.INTEGRATION_OBJECTS)} OR {email} OR {c(n, '@')} OR {c(n, '.com')} OR "
           f"{doc} OR {arq} OR {cal} OR {share} OR {sched} OR {canc} OR {vog})")
    return f"(NOT {excl} AND {hit})"


def question_sql(o: str = "m") -> str:
    low = f"lower({o})"
    first = f"coalesce({toks(low)}[1], '')"
    return (f"(NOT {anyc(low, L.QUESTION_PERSONAL)} AND NOT {anyc(low, L.QUESTION_DETAILED)} AND "
            f"({c(o, '?')} OR {eq_any(first, L.QUESTION_FIRST_WORDS)} OR "
            f"{anyc(low, L.QUESTION_PHRASES)}))")


def complex_sql(o: str = "m", n: str = "norm") -> str:
    marks = f"(length({o}) - length(regexp_replace({o}, '[.?!;]', '', 'g')))"
    simple = f"({anyc(n, L.SIMPLE_TASKS)} AND length({o}) < 80)"
    improv = (f"({c(n, L.IMPROVEMENT_PHRASE)} OR ({c(n, 'melhorar')} AND "
              f"{anyc(n, L.IMPROVEMENT_CONTEXT)}))")
    return (f"(NOT {simple} AND ({word_re(o, L.PERSONAL_REFERENCES)} OR {word_re(o, L.PLAN_TERMS)} "
            f"OR {marks} > 1 OR {anyc(n, L.PERSONALISATION)} OR {improv}))")


def language_sql(o: str = "m") -> str:
    pt = f"(regexp_matches({o}, '(?i)[{L.PT_ACCENT_CLASS}]') OR {word_re(o, L.PT_WORDS)})"
    en = word_re(o, L.EN_WORDS)
    return f"(CASE WHEN {en} AND NOT {pt} THEN 'en' ELSE 'pt' END)"


def rule_conditions(o="m", n="norm", nw="nw", lt="lemma_text", hv="has_verb", extra=None) -> list[tuple[str, str]]:
    ns = strip(n)
    short = f"(length({o}) <= 15 AND {nw} <= 2)"
    long_conv = f"(length({o}) > 100 AND {nw} > 15 AND {anyc(n, L.LONG_CONV_TERMS)})"
    pa = f"(NOT {anyc(n, L.CLEAR_NOUNS)} AND {anyc(n, [s for s, _ in L.LOOSE_PRONOUNS])})"
    pb = f"({c(n, ' e pra ela')} OR {c(n, ' e pra ele')})"
    pc = f"(({c(n, ' pra ela')} OR {c(n, ' pra ele')}) AND NOT {anyc(n, L.PROPER_NAMES)})"
    pieces = f"({nonblank(o, '.')} + {nonblank(o, '?')} + {nonblank(o, '!')})"
    return [
        ("R01", f"{short} AND {anyc(n, L.SHORT_GREETINGS)}"),
        ("R02", f"{short} AND {eq_any(ns, L.CONFIRMATIONS)}"),
        ("R03", f"{short} AND {anyc(n, L.SHORT_UNCERTAINTY)}"),
        ("R04", f"{short} AND {eq_any(ns, L.LONE_WORDS)}"),
        ("R05", f"{short} AND {eq_any(ns, L.DEMONSTRATIVES)}"),
        ("R06", f"{short} AND {eq_any(ns, L.LONE_INTERROGATIVES)}"),
        ("R07", f"{short} AND {nw} = 1 AND length({ns}) < 6"),
        ("R08", f"{nw} <= 3 AND length({o}) < 20 AND {anyc(n, L.TEST_WORDS)}"),
        ("R09", anyc(n, L.CONVERSATIONAL)),
        ("R10", anyc(n, L.REST_PHRASES)),
        ("R11", f"NOT {long_conv} AND ({pa} OR {pb} OR {pc})"),
        ("R12", anyc(n, L.VAGUE_REFERENCES)),
        ("R13", anyc(n, L.VAGUE_TERMS)),
        ("R14", anyc(n, L.OPEN_CONDITIONS)),
        ("R15", f"{anyc(n, [p for p, _ in L.GENERIC_OBJECT_ACTIONS])} AND "
                f"{anyc(n, L.GENERIC_OBJECT_WORDS)} AND NOT {anyc(n, L.OBJECT_SPECIFIERS)}"),
        ("R16", f"{c(n, L.REDO_MARK)} AND {anyc(n, L.REDO_VERBS)} AND NOT {anyc(n, L.REDO_SPECIFIERS)}"),
        ("R17", f"{anyc(n, [p for p, _ in L.GENERIC_DESTINATIONS])} AND NOT "
                f"{anyc(n, L.DESTINATION_NAMES)} AND NOT {anyc(n, L.DESTINATION_SPECIFIERS)}"),
        ("R18", f"{anyc(n, [p for p, _ in L.OTHER_DESTINATIONS])} AND NOT "
                f"{anyc(n, L.OTHER_DESTINATION_SPECIFIERS)}"),
        ("R19", f"{anyc(n, L.DOUBLE_INTENT_CONNECTORS)} AND len({found(n, L.DOUBLE_INTENT_VERBS)}) >= 2"
                f" AND NOT {anyc(n, L.DOUBLE_INTENT_CAPACITY)}"),
        ("R20", anyc(n, [p for p, _ in L.POLYSEMOUS])),
        ("R21", long_conv),
        ("R22", f"{anyc(n, L.UNCERTAINTY)} AND {anyc(n, L.UNCERTAIN_ACTIONS)}"),
        ("R23", f"{c(n, ' ou ')} AND ends_with({o}, '?') AND {anyc(n, L.OPTION_WORDS)}"),
        ("R24", anyc(n, L.CAPACITY_QUESTIONS)),
        ("R25", f"{anyc(n, L.INTERNAL_SYSTEM)} AND ({anyc(n, L.INTERNAL_VERBS)} OR "
                f"{c(n, L.INTERNAL_CHECK)})"),
        ("R26", anyc(n, L.EXTERNAL_APIS)),
        ("R27", f"{anyc(n, L.SYSTEM_KEYWORDS)} AND {intent_sql(n, lt, hv)}"),
        ("R28", f"{anyc(n, L.NARRATIVE_SUBJECTS)} AND {anyc(n, L.NARRATIVE_PAST)}"),
        ("R29", anyc(n, L.PERSONAL_TASKS)),
        ("R30", anyc(n, L.GENERIC_HELP)),
        ("R31", f"{anyc(n, L.GREETING_QUESTIONS)} AND {c(o, '?')}"),
        ("R32", anyc(n, L.HYPOTHETICALS)),
        ("R33", f"{anyc(n, L.COMMAND_OBJECTS)} AND {anyc(lt, [*L.infinitives(), *(extra or {}).values()])} AND NOT "
                f"{c(o, '?')} AND NOT {anyc(n, L.ABSTRACT_WORDS)}"),
        ("R34", f"(length({o}) <= 80 AND ends_with({o}, '?')) OR {word_re(n, L.FACTUAL_TERMS)}"),
        ("R35", question_sql(o)),
        ("R36", complex_sql(o, n)),
        ("R37", f"{pieces} > 2 OR length({o}) > 150"),
        ("R38", anyc(f"(' ' || {n} || ' ')", L.PERSONAL_PRONOUNS)),
        ("R39", f"length({o}) < 10 AND {anyc(n, L.FALLBACK_GREETINGS)}"),
        ("R40", f"length({o}) < 10"),
        ("R41", f"list_has_any(toks, {list_lit(L.FALLBACK_INTERROGATIVES)}) AND NOT {c(o, '?')} "
                f"AND NOT {anyc(n, L.FALLBACK_TECHNICAL)}"),
        ("R42", f"length({o}) < 20"),
        ("R43", "TRUE"),
    ]


def rule_case(extra: dict[str, str] | None = None) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN {q(rid)}" for rid, cond in rule_conditions(extra=extra)) + " END"


def bucket_case(rule: str = "rule_id") -> str:
    return "CASE " + " ".join(f"WHEN {rule} = {q(r)} THEN {q(b)}"
                              for r, b in L.RULE_BUCKETS.items()) + " END"


def reason_case(rule: str = "rule_id", n: str = "norm") -> str:
    R = L.REASONS

    def fill(key, detail):
        pre, post = R[key].split("{}")
        return f"({q(pre)} || {detail} || {q(post)})"

    pa = f"(NOT {anyc(n, L.CLEAR_NOUNS)} AND {anyc(n, [s for s, _ in L.LOOSE_PRONOUNS])})"
    pb = f"({c(n, ' e pra ela')} OR {c(n, ' e pra ele')})"
    pc = f"(({c(n, ' pra ela')} OR {c(n, ' pra ele')}) AND NOT {anyc(n, L.PROPER_NAMES)})"
    pron = (f"CASE WHEN {pc} THEN (CASE WHEN {c(n, ' pra ela')} THEN 'ela' ELSE 'ele' END) "
            f"WHEN {pb} THEN (CASE WHEN {c(n, ' e pra ela')} THEN 'ela/ele' ELSE 'ele' END) "
            f"WHEN {pa} THEN {first_of(n, L.LOOSE_PRONOUNS)} END")
    special = {
        "R11": fill("R11", pron),
        "R15": fill("R15", first_of(n, L.GENERIC_OBJECT_ACTIONS)),
        "R17": fill("R17", first_of(n, L.GENERIC_DESTINATIONS)),
        "R18": fill("R18", first_of(n, L.OTHER_DESTINATIONS)),
        "R19": fill("R19", f"array_to_string({found(n, L.DOUBLE_INTENT_VERBS)}[1:2], ', ')"),
        "R20": fill("R20", first_of(n, L.POLYSEMOUS)),
        "R27": fill("R27", f"array_to_string({found(n, L.SYSTEM_KEYWORDS)}[1:6], ', ')"),
        "R35": (f"CASE WHEN {anyc(n, L.TECHNICAL_QUESTION_TERMS)} THEN {q(R['R35_TECH'])} "
                f"ELSE {q(R['R35'])} END"),
    }
    return "CASE " + " ".join(f"WHEN {rule} = {q(r)} THEN {special.get(r, q(R[r]))}"
                              for r in L.RULE_IDS) + " END"


def scopes_sql(n: str = "norm") -> str:
    def arr(*xs):
        return list_lit(xs)
    empty = "[]::VARCHAR[]"
    mail_act, mail_word = anyc(n, L.MAIL_ACTIONS), anyc(n, L.MAIL_WORDS)
    cal_act, cal_word = anyc(n, L.CALENDAR_ACTIONS), anyc(n, L.CALENDAR_WORDS)
    multi = anyc(n, L.MULTI_ACTION_CONNECTORS)
    pat = "CASE " + " ".join(f"WHEN {c(n, p)} THEN {arr(*s)}" for p, s in L.SCOPE_PATTERNS) + " END"
    cal_part = (f"CASE WHEN {anyc(n, L.CALENDAR_LOOSE)} THEN {arr(L.CALENDAR)} "
                f"WHEN {c(n, L.COMMITMENT)} AND NOT {mail_act} THEN {arr(L.CALENDAR)} ELSE {empty} END")
    loose = (f"list_concat(list_concat(CASE WHEN {mail_word} THEN {arr(L.MAIL)} ELSE {empty} END, "
             f"CASE WHEN {c(n, 'drive')} THEN {arr(L.DRIVE)} ELSE {empty} END), "
             f"CASE WHEN {anyc(n, L.BILLING_WORDS)} THEN {arr(L.BOLETO)} ELSE {empty} END)")
    tail = (f"list_concat({cal_part}, CASE WHEN {anyc(n, L.SHEET_WORDS)} THEN {arr(L.SHEETS, L.DRIVE)} "
            f"WHEN {anyc(n, L.DOC_WORDS)} THEN {arr(L.DRIVE, L.DOCUMENTS)} ELSE {loose} END)")
    return (f"CASE WHEN {anyc(n, [p for p, _ in L.SCOPE_PATTERNS])} THEN {pat} "
            f"WHEN {mail_act} AND {mail_word} AND ({cal_act} OR {cal_word}) AND {multi} "
            f"THEN {arr(L.MAIL, L.CALENDAR)} "
            f"WHEN {mail_act} AND {mail_word} THEN {arr(L.MAIL)} "
            f"WHEN {cal_act} AND ({cal_word} OR {c(n, L.COMMITMENT)}) THEN {arr(L.CALENDAR)} "
            f"ELSE {tail} END")


def triage_ctes(src_sql: str, extra: dict[str, str] | None = None) -> str:
    """features -> cls (rule_id, bucket0, reason0) -> tri (bucket, reasons, scope)."""
    reclass = f"len({toks('m')}) <= {L.RECLASSIFY_MAX_WORDS}"
    pre, post = L.REASONS["RECLASSIFIED"].split("{}")
    return features_cte(src_sql, extra) + f""",
r1 AS (SELECT *, {rule_case(extra)} AS rule_id FROM feat),
cls AS (SELECT *, {bucket_case()} AS bucket0, {reason_case()} AS reason0 FROM r1),
sc AS (SELECT *, CASE WHEN bucket0 = 'system' THEN {scopes_sql()} ELSE []::VARCHAR[] END AS scope0
       FROM cls),
tri AS (SELECT *, (bucket0 = 'system' AND len(scope0) = 0) AS reclassified,
               CASE WHEN bucket0 = 'system' AND len(scope0) = 0 THEN
                    (CASE WHEN {reclass} THEN 'messages' ELSE 'user' END) ELSE bucket0 END AS bucket
        FROM sc),
fin AS (SELECT *, CASE WHEN reclassified THEN []::VARCHAR[] ELSE scope0 END AS scope,
               CASE WHEN reclassified THEN [reason0, {q(pre)} || bucket || {q(post)}]
                    ELSE [reason0] END AS reasons
        FROM tri)"""
