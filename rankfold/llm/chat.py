"""Chat formatting with typed content parts, by DataFrame operations only.

A turn's content is an array of parts (type, text, ref, n_tokens).  The visitor maps text parts to
escaped text and image, audio and document parts to a placeholder in place, and records each
attachment with its reference and the tokens that the placeholder stands for.

A turn is written <|turn|>role<|say|>content<|end|>.  Escaping is reversible: a backslash becomes
two, and a control string in a text gets a backslash after its first character, so that no control
string is left in it; unescaping drops each backslash and keeps the character after it.

Defined results: a null text is empty, a null role is empty, a null turn sorts first; turns that
tie are ordered by role, then content; repeated rows are turns of their own; rows of a null
conv_id form one conversation; an empty table gives an empty result.  Only the named columns are
read.  A whole conversation becomes one value, so one must stay under Spark's 2 GB for a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

TURN, SAY, END = "<|turn|>", "<|say|>", "<|end|>"
# Control strings of this and other templates, and the tokens that an attachment of unknown length takes.
KINDS = {"image": 576, "audio": 750, "document": 1024}
CONTROL = r"([<\[])(\|(?:turn|say|end|image|audio|document)\|>|/?s>|/?INST\])"

PART = "struct<type string, text string, ref string, n_tokens int>"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def visit(parts: Column) -> tuple[Column, Column]:
    """(content, attachments) of an array of parts; unknown types count as text."""
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def piece(p: Column) -> Column:
        return F.when(F.array_contains(kinds, p["type"]), F.concat(F.lit("<|"), p["type"], F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))

    def tokens(p: Column) -> Column:
        unknown = F.coalesce(*[F.when(p["type"] == k, F.lit(n)) for k, n in KINDS.items()])
        return F.struct(p["type"].alias("kind"), p["ref"].alias("ref"), F.coalesce(p["n_tokens"], unknown).alias("n_tokens"))

    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    content = F.array_join(F.transform(parts, piece), "")
    return content, F.transform(F.filter(parts, lambda p: F.array_contains(kinds, p["type"])), tokens)


def text_part(c: Column) -> Column:
    empty = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("type"), c.alias("text"), empty.alias("ref"), F.lit(None).cast("int").alias("n_tokens")))


def format_chats(turns: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", parts: Column | None = None, learn_from=("assistant",)) -> DataFrame:
    """conv_id, formatted, segments (text, loss: their texts make up `formatted`), attachments in order."""
    content, attached = visit(text_part(F.col("text")) if parts is None else parts)
    raw = F.coalesce(F.col("text"), F.lit("")) if parts is None else F.lit("")
    flat = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), raw.alias("raw"), content.alias("content"), attached.alias("attached")
    )
    # Tied turns are in the order of what was said, not of its escaped form.
    convs = flat.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "raw", "content", "attached"))).alias("turns"))

    def pieces(t: Column) -> Column:
        learned = t["role"].isin(*learn_from)
        made = ((F.concat(F.lit(TURN), escape(t["role"]), F.lit(SAY)), F.lit(False)), (t["content"], learned), (F.lit(END), F.lit(False)))
        return F.array(*[F.struct(x.alias("text"), loss.alias("loss")) for x, loss in made])

    convs = convs.select(
        "conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"), F.flatten(F.transform("turns", lambda t: t["attached"])).alias("attachments")
    )
    return convs.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "attachments")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    cut = F.split(formatted, r"<\|end\|>", -1)
    whole = F.slice(cut, 1, F.size(cut) - 1)

    def turn(t: Column) -> Column:
        both = F.split(t, r"<\|say\|>", -1)
        return F.struct(unescape(F.substring(both[0], len(TURN) + 1, 1 << 30)).alias("role"), unescape(both[1]).alias("text"))

    return F.transform(whole, turn)


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader finds in the output of format_chats()."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    out = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), learned.alias("learned"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    return digests(format_chats(turns.unionByName(extra)))


OP5_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '([<\[])(\|(?:turn|say|end|image|audio|document)\|>|/?s>|/?INST\])', '\1#\2', 'g'))
    + length(regexp_replace(replace(role, '\', '\\'), '([<\[])(\|(?:turn|say|end|image|audio|document)\|>|/?s>|/?INST\])', '\1#\2', 'g')) + 22 AS n FROM rows_)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
