"""Chat formatting with typed content parts, in DataFrame functions only.

A turn holds a list of parts (text, image, audio or document). A visit of the parts in order renders texts and
ordered placeholders, and records each attachment's reference and the number of tokens that its placeholder stands
for. Texts cannot hold control strings: every "<|" in them is escaped, and the escape is undone on reading back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, PART, END = "<|turn|>", "<|part|>", "<|end|>\n"
ESC = "␛"
KINDS = ("text", "image", "audio", "document")
PART_TYPE = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    """Every escape sign is followed by e, n or | afterwards, so unescape finds exactly what was put in."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit(ESC), F.lit(ESC + "e"))
    return F.replace(text, F.lit("<|"), F.lit(f"<{ESC}|"))


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit(f"<{ESC}|"), F.lit("<|"))
    return F.replace(text, F.lit(ESC + "e"), F.lit(ESC))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(ESC + "n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(ESC + "n"), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """The part list of a turn that is one text; null text is the empty text."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
                    *[F.lit(None).cast(t).alias(n) for n, t in
                      (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    return F.array(part)


def expanded_tokens(part: Column, patch: int, audio_rate: float, page_tokens: int) -> Column:
    """Tokens that an attachment takes in place of its placeholder; unknown sizes count as one unit."""
    def units(x):
        return F.greatest(F.lit(1), F.ceil(F.coalesce(x, F.lit(1.0)))).cast("long")
    return (F.when(part["kind"] == "image", units(part["width"] / patch) * units(part["height"] / patch))
            .when(part["kind"] == "audio", units(part["seconds"] * audio_rate))
            .otherwise(units(part["pages"].cast("double")) * page_tokens))


def format_chat(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                parts: str = "parts", patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 256,
                loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: formatted, loss_spans and attachments.

    messages: a row for each turn, parts of PART_TYPE. Turns stand in order of turn, then role, then content, so
    that repeated turn numbers have one result; a null turn comes first, a null role or text is empty, a null or
    unknown part kind is text, and a null part list is no part. loss_spans holds, for each text part of a turn of
    loss_role, the turn's position and the part's start and length (code points) from that turn's start in
    formatted; attachments holds ordinal, kind, ref and tokens in order over the conversation, with turn and part, their places. Rows of a null
    conversation form one conversation. An empty table gives an empty table.

    A conversation is one row of the result and so one task's work; conversations are bounded by what a string
    can hold.
    """
    def is_text(p):
        return ~F.coalesce(p["kind"].isin(*KINDS[1:]), F.lit(False))

    visited = F.transform(F.coalesce(F.col(parts), F.array().cast(f"array<{PART_TYPE}>")), lambda p: F.struct(
        is_text(p).alias("is_text"),
        F.when(is_text(p), escape(p["text"])).otherwise(F.concat(F.lit("<|"), p["kind"], F.lit("|>"))).alias("shown"),
        p["kind"].alias("kind"), p["ref"].alias("ref"),
        expanded_tokens(p, patch, audio_rate, page_tokens).alias("tokens")))
    head = F.concat(F.lit(TURN), escape_role(F.col("role_")), F.lit("\n"))
    rows = messages.select(F.col(conv).alias("conv_"), F.col(turn).alias("turn_"), F.col(role).alias("role_"),
                           visited.alias("seen"))
    rows = rows.withColumn("content", F.concat(
        head, F.array_join(F.transform("seen", lambda p: F.concat(F.lit(PART), p["shown"])), ""), F.lit(END)))
    # starts of the parts: only lengths are folded, a turn at a time
    starts = F.aggregate(
        F.col("seen"),
        F.struct((F.length(head) + len(PART)).alias("at"),
                 F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["shown"]) + len(PART)).alias("at"),
            F.when(p["is_text"], F.concat(acc["spans"], F.array(F.struct(
                acc["at"].alias("start"), F.length(p["shown"]).alias("length"))))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    rows = rows.select(
        "conv_", F.struct(
            F.col("turn_").alias("turn"), F.coalesce("role_", F.lit("")).alias("role"), "content",
            F.when(F.coalesce(F.col("role_"), F.lit("")) == loss_role, starts)
            .otherwise(F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
            F.filter(F.transform("seen", lambda p, k: F.struct(
                p["is_text"], p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"), k.alias("part"))),
                lambda p: ~p["is_text"]).alias("files")).alias("t"))
    grouped = rows.groupBy("conv_").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return grouped.select(
        F.col("conv_").alias(conv),
        F.array_join(F.col("turns.content"), "").alias("formatted"),
        F.flatten(F.transform("turns", lambda t, i: F.transform(t["spans"], lambda s: F.struct(
            i.alias("turn"), s["start"].alias("start"), s["length"].alias("length"))))).alias("loss_spans"),
        F.transform(F.flatten(F.transform("turns", lambda t, i: F.transform(t["files"], lambda f: F.struct(f.alias("f"), i.alias("turn"))))), lambda x, i: F.struct(
            i.alias("ordinal"), x["f"]["kind"].alias("kind"), x["f"]["ref"].alias("ref"), x["f"]["tokens"].alias("tokens"),
            x["turn"].alias("turn"), x["f"]["part"].alias("part"))).alias("attachments"))


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Parse formatted again: turns (role, parts) and loss_texts, the unescaped texts under loss_spans, in order.

    A part is (kind, text, ref): a placeholder stands in formatted as no text can, whose "<|" is escaped, and has the ref of the
    attachment in its place; its text is null. Kinds that are unknown come back as text.
    """
    pieces = F.slice(F.split(F.col("formatted"), r"<\|turn\|>", -1), 2, 2**30)
    df = formatted.withColumn("pieces", pieces)

    def parse(p, i):
        here = F.filter("attachments", lambda a: a["turn"] == i)

        def part(raw, k):
            kind = F.regexp_extract(raw, rf"^<\|({'|'.join(KINDS[1:])})\|>$", 1)
            return F.struct(F.when(kind == "", "text").otherwise(kind).alias("kind"), F.when(kind == "", unescape(raw)).alias("text"),
                            F.when(kind != "", F.get(F.filter(here, lambda a: a["part"] == k), 0)["ref"]).alias("ref"))
        role = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(END))
        parts = F.slice(F.split(body, r"<\|part\|>", -1), 2, 2**30)
        return F.struct(unescape_role(role).alias("role"), F.transform(parts, part).alias("parts"))

    # spans count from the turn's marker, which split() took away
    cut = F.transform("loss_spans", lambda s: unescape(F.substr(
        F.get(F.col("pieces"), s["turn"]), s["start"] + 1 - len(TURN), s["length"])))
    return df.select(conv, "formatted", "attachments", F.transform("pieces", parse).alias("turns"), cut.alias("loss_texts"))


def op2(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    out = read_back(format_chat(rows.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), F.array_join(t["parts"]["text"], ""), F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(text, chr(9243), chr(9243) || 'e'), '<|', '<' || chr(9243) || '|') AS shown,
         replace(replace(replace(role, chr(9243), chr(9243) || 'e'), '<|', '<' || chr(9243) || '|'), chr(10), chr(9243) || 'n') AS who
  FROM c),
g AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, shown) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, shown) FILTER (WHERE role = 'assistant'), '') AS loss,
         CAST(sum(8 + length(who) + 1 + 8 + length(shown) + 8) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars
FROM g
"""
