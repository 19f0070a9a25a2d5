"""Language-model request assembly.

Everything is a column expression over the triaged row plus its ``ctx``
struct and ``history`` array; the result is a nested struct that ``to_json``
writes out.  The four system prompts come from a tiny bucket-keyed table of
our own short texts (the reference's prompt wording is not reproduced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T

# Our own prompt texts (only their order and role matter for the payload).
BASE_PROMPT = ("You are a personal assistant on a chat channel that helps the user work with "
               "tools and APIs. Available APIs: {scopes}. Keep replies short, friendly and in "
               "the channel's plain formatting.")
BUCKET_PROMPTS = {
    "system": "Category SYSTEM: confirm the request, explain the action, list what is needed "
              "and ask for confirmation.",
    "user": "Category USER: acknowledge, structure the answer in topics, give examples and "
            "suggest next steps.",
    "messages": "Category MESSAGES: answer directly in two to four sentences.",
    "unclear": "Category UNCLEAR: say what was understood and ask a specific question.",
}
FALLBACK_PROMPT = "Answer naturally and clearly."
REMINDER_PROMPT = "Reminder: keep the reply compatible with the channel formatting."

CTX_SCHEMA = "struct<lang:string,model:string,temperature:double>"
MSG_SCHEMA = "struct<role:string,content:string>"


def effective_language(ctx_lang: Column, orig: Column) -> Column:
    """Ctx.lang when non-empty, else the detected language."""
    return F.coalesce(F.nullif(ctx_lang, F.lit("")), T.language(orig))


def generation_params(bucket: Column, ctx: Column) -> Column:
    """B1: struct(model, temperature, max_tokens)."""
    model = F.coalesce(F.nullif(ctx.getField("model"), F.lit("")), F.lit(L.DEFAULT_MODEL))
    base = F.coalesce(ctx.getField("temperature"), F.lit(L.DEFAULT_TEMPERATURE)).cast("double")
    cap, max_tokens = None, None
    for b, (c, mt) in L.GENERATION_PARAMS.items():
        cap = F.when(bucket == b, F.lit(c)) if cap is None else cap.when(bucket == b, F.lit(c))
        max_tokens = (F.when(bucket == b, F.lit(mt)) if max_tokens is None
                      else max_tokens.when(bucket == b, F.lit(mt)))
    user_cap, user_mt = L.GENERATION_PARAMS["user"]
    cap = cap.otherwise(F.lit(user_cap))
    max_tokens = max_tokens.otherwise(F.lit(user_mt))
    return F.struct(model.alias("model"), F.least(base, cap).alias("temperature"),
                    max_tokens.alias("max_tokens"))


def system_prompts(bucket: Column, lang: Column, scope: Column) -> Column:
    """B2: four system messages: language, base (with scope list or
    'nenhuma'), bucket prompt, reminder."""
    scopes = F.when(F.size(scope) > 0, F.array_join(scope, ", ")).otherwise(F.lit(L.NO_SCOPES))
    pre, post = BASE_PROMPT.split("{scopes}")
    cat = None
    for b, txt in BUCKET_PROMPTS.items():
        cat = F.when(bucket == b, F.lit(txt)) if cat is None else cat.when(bucket == b, F.lit(txt))
    cat = cat.otherwise(F.lit(FALLBACK_PROMPT))

    def sysmsg(c):
        return F.struct(F.lit("system").alias("role"), c.alias("content"))
    lang_prompt = F.when(lang == "en", F.lit(L.LANG_PROMPT_EN)).otherwise(F.lit(L.LANG_PROMPT_PT))
    return F.array(sysmsg(lang_prompt), sysmsg(F.concat(F.lit(pre), scopes, F.lit(post))),
                   sysmsg(cat), sysmsg(F.lit(REMINDER_PROMPT)))


def last_history(history: Column, n: int = L.HISTORY_TURNS) -> Column:
    """Items having both role and content, the last ``n`` of them."""
    valid = F.filter(history, lambda m: m.getField("role").isNotNull()
                     & m.getField("content").isNotNull())
    valid = F.transform(valid, lambda m: F.struct(m.getField("role").alias("role"),
                                                  m.getField("content").alias("content")))
    size = F.size(valid)
    return F.when(size <= n, valid).otherwise(F.slice(valid, size - n + 1, n))


def history_from_turns(turns: DataFrame, n: int = L.HISTORY_TURNS, conv_col: str = "conv_id",
                       turn_col: str = "turn") -> DataFrame:
    """For every turn, the ``n`` turns before it in its conversation (a
    bounded ``rowsBetween(-n, -1)`` frame, so a long conversation never
    materialises more than n items per row)."""
    w = Window.partitionBy(conv_col).orderBy(turn_col).rowsBetween(-n, -1)
    return turns.withColumn("history", F.collect_list(
        F.struct(F.col("role").alias("role"), F.col("text").alias("content"))).over(w))


def assemble(df: DataFrame) -> DataFrame:
    """Payload struct(model, messages, temperature, max_tokens) and its
    JSON text.  Needs bucket, scope, message, ctx, history."""
    ctx = F.col("ctx")
    lang = effective_language(ctx.getField("lang"), F.col("message"))
    params = generation_params(F.col("bucket"), ctx)
    user = F.array(F.struct(F.lit("user").alias("role"), F.col("message").alias("content")))
    msgs = F.concat(system_prompts(F.col("bucket"), lang, F.col("scope")),
                    last_history(F.col("history")), user)
    payload = F.struct(params.getField("model").alias("model"), msgs.alias("messages"),
                       params.getField("temperature").alias("temperature"),
                       params.getField("max_tokens").alias("max_tokens"))
    return (df.withColumn("lang", lang).withColumn("payload", payload)
              .withColumn("payload_json", F.to_json(F.col("payload"))))
