"""Chat formatting: turns to one training text with a loss mask, and back. Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are
merged into a block by array aggregation; blocks are concatenated:

    <|block|>role<|text|>first text<|turn|>second text of the same role<|end|>

Control strings inside texts and roles are escaped by a tilde after their first character
(``<|`` becomes ``<~|``, ``[INST]`` becomes ``[~INST]``, and ``<~|`` becomes ``<~~|``), which no
control string contains, so reading back is exact. The loss mask lists the spans of assistant
texts in the formatted text, in code points, one span per turn; markers are outside it.

Defined results: turns sort by ``turn`` (null first), then role and text, so ties and repeated
rows have one order; a null text or role is empty; rows without a conversation id form one
conversation; a conversation is one training text, so its turns meet in one row, while
conversations spread over all tasks; an empty table gives an empty result. Other input columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsengine.llm.common import table

BLOCK, TEXT, TURN, END = "<|block|>", "<|text|>", "<|turn|>", "<|end|>"
#: What follows the first character of a control string, of this template and of common others.
_REST = r"(?=\||/?s>|/?INST\]|</?SYS>)"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(~*){_REST}", "$1~$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])~(~*){_REST}", "$1$2")


def conversations(rows: DataFrame) -> DataFrame:
    """One row per ``conv_id``: ``turns``, an array of structs in order."""
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks(turns: Column) -> Column:
    """Adjacent turns of one role as one struct of the role and the array of its texts.

    ``turns`` is a column. Blocks are slices from one change of role to the next, so the work grows with the turns.
    """
    opens = F.transform(turns, lambda t, i: F.when((i == 0) | (F.get(turns, i - 1)["role"] != t["role"]), i))

    def block(starts: Column):
        return lambda s, j: F.struct(
            F.get(turns, s)["role"].alias("role"),
            F.transform(F.slice(turns, s + 1, F.coalesce(F.get(starts, j + 1), F.size(turns)) - s), lambda t: t["text"]).alias("texts"),
        )

    return let(F.filter(opens, F.isnotnull), lambda starts: F.transform(starts, block(starts)))


#: Parts whose places are summed in one array that grows.
RUN = 128


def loss_spans(parts: Column) -> Column:
    """Spans of the parts under the loss: places within runs of ``RUN`` parts, moved by the lengths of the runs before."""
    none = F.array().cast("array<struct<start:int,length:int>>")

    def span(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["lead"])
        own = F.array(F.struct(begin.alias("start"), F.length(part["body"]).alias("length")))
        return F.struct(
            (begin + F.length(part["body"])).alias("at"),
            F.when(part["loss"], F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans"),
        )

    def run(k: Column) -> Column:
        return F.aggregate(F.slice(parts, k * RUN + 1, F.lit(RUN)), F.struct(F.lit(0).alias("at"), none.alias("spans")), span)

    def begins(runs: Column) -> Column:
        first = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(
            runs,
            first,
            lambda state, r: F.struct((state["at"] + r["at"]).alias("at"), F.concat(state["all"], F.array(state["at"])).alias("all")),
            lambda state: state["all"],
        )

    def moved(runs: Column) -> Column:
        def by(places: Column) -> Column:
            shift = lambda k: lambda s: F.struct((s["start"] + F.get(places, k)).alias("start"), s["length"].alias("length"))
            return F.flatten(F.transform(runs, lambda r, k: F.transform(r["spans"], shift(k))))

        return let(begins(runs), by)

    count = F.floor((F.size(parts) - 1) / RUN).cast("int")
    return let(F.transform(F.sequence(F.lit(0), count), run), moved)


def formatted(found: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss``, the spans (start from 1, length) of assistant texts."""
    merged = found.select("conv_id", blocks(F.col("turns")).alias("blocks"))

    def piece(text: Column, role: Column, lead: Column) -> Column:
        return F.struct(lead.alias("lead"), escaped(text).alias("body"), (role == LOSS_ROLE).alias("loss"))

    def pieces(b: Column) -> Column:
        first = F.concat(F.lit(BLOCK), escaped(b["role"]), F.lit(TEXT))
        texts = F.transform(b["texts"], lambda t, i: piece(t, b["role"], F.when(i == 0, first).otherwise(F.lit(TURN))))
        return F.concat(texts, F.array(F.struct(F.lit(END).alias("lead"), F.lit("").alias("body"), F.lit(False).alias("loss"))))

    parts = merged.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: F.concat(p["lead"], p["body"])), "")
    return parts.select("conv_id", whole.alias("formatted"), loss_spans(F.col("parts")).alias("loss"))


def format_chats(rows: DataFrame) -> DataFrame:
    return formatted(conversations(rows))


def turns_of(text: Column) -> Column:
    """The turns read back from a formatted text: array of structs of role and text."""
    quoted = {m: m.replace("|", r"\|") for m in (BLOCK, TEXT, TURN, END)}
    # every block begins with its marker, so the first element is empty
    each = F.filter(F.split(text, quoted[BLOCK]), lambda b, i: i > 0)

    def block(b: Column) -> Column:
        halves = F.split(F.regexp_replace(b, quoted[END] + r"\z", ""), quoted[TEXT])
        role = unescaped(F.element_at(halves, 1))
        return F.transform(
            F.split(F.element_at(halves, 2), quoted[TURN]), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text"))
        )

    return F.flatten(F.transform(each, block))


def masked(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order. The text is cut once for ``RUN`` spans, then for each span."""

    def cut(some: Column) -> Column:
        first, last = F.try_element_at(some, F.lit(1))["start"], F.try_element_at(some, F.lit(-1))
        piece = F.substring(text, first, last["start"] + last["length"] - first)
        each = lambda p: F.transform(some, lambda s: unescaped(F.substring(p, s["start"] - first + 1, s["length"])))
        return let(piece, lambda p: F.array_join(each(p), ""))

    runs = F.sequence(F.lit(0), F.greatest(F.floor((F.size(loss) - 1) / RUN).cast("int"), F.lit(0)))
    return F.array_join(F.transform(runs, lambda k: let(F.slice(loss, k * RUN + 1, F.lit(RUN)), cut)), "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


#: A conversation whose texts look like markup; its id is no id of the table.
PROBE = "</s>[INST] ok [/INST]"


def op10_chat_format(spark, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    probe = spark.range(2).select(
        F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"),
        F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"),
        F.lit(PROBE).alias("text"),
    )
    out = format_chats(rows.unionByName(probe))
    out = out.select("conv_id", "formatted", turns_of(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss")).alias("learnt"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256(F.array_join(lines, "")).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        sha256(F.col("learnt")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Lengths follow from the template: an escape adds one character.
OP10_SQL = r"""
WITH raw AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k FROM raw),
lengths AS (
    SELECT *, length(role) + len(regexp_extract_all(role, '[<\[]~*(\||/?s>|/?INST\]|</?SYS>)')) AS role_chars,
           length(text) + len(regexp_extract_all(text, '[<\[]~*(\||/?s>|/?INST\]|</?SYS>)')) AS text_chars,
           (lag(role) OVER (PARTITION BY conv_id ORDER BY k)) IS DISTINCT FROM role OR k = 1 AS opens
    FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(text_chars + CASE WHEN opens THEN 9 + role_chars + 8 + 7 ELSE 8 END)::BIGINT AS formatted_chars
FROM lengths GROUP BY conv_id
"""
