r"""Chat formatting with a grammar round trip, by DataFrame functions only.

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "<s>[INST]" role ":" level "[/INST]" body "</s>"
    level        := "0" | "1"

A parser ends a turn at the first ``</s>``, a header at the first
``[/INST]``; a body of level 1 is unescaped, one of level 0 is taken as it is.
Anything else, be it before, between or after turns, raises an error.
Each turn is rendered at level 0, reparsed and compared with its source; where
these differ, or the text has a control string, it is rendered anew at level 1,
in which ``\`` is doubled and each control string gets a ``\`` after its first
character. Roles are always escaped. A turn that still differs raises an error.

The loss mask has a span for each turn, told when it is rendered: where its body
lies, and whether it counts. Loss text is cut out of the formatted text by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accordant.llm.common import table

#: Fixed values of the grammar.
OPEN, HEAD_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.when(F.instr(text, "\\") > 0, F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def render(role: Column, text: Column, level: int) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(f":{level}{HEAD_END}"), escape(text) if level else text, F.lit(CLOSE))


def parse_turn(piece: Column) -> Column:
    """A rendered turn without its ``</s>`` as struct(role, text). A piece that the grammar doesn't have raises an error."""
    head_end = F.instr(piece, HEAD_END)
    head = F.substring(piece, F.lit(len(OPEN) + 1), head_end - 1 - len(OPEN))
    body = F.substring(piece, head_end + len(HEAD_END), F.length(piece))
    level = F.right(head, F.lit(2))
    turn = F.struct(
        unescape(F.left(head, F.length(head) - 2)).alias("role"),
        F.when(level == ":1", unescape(body)).otherwise(body).alias("text"),
    )
    sound = F.startswith(piece, F.lit(OPEN)) & (head_end > 0) & level.isin(":0", ":1")
    return F.when(sound, turn).otherwise(_refused("a turn isn't of the grammar"))


def _refused(why: str) -> Column:
    return F.raise_error(F.lit(why)).cast("struct<role: string, text: string>")


def parse(formatted: Column) -> Column:
    """All turns of a formatted conversation, as an array of structs (role, text). Text after the last turn raises an error."""
    # The last piece comes after the last turn's end.
    pieces = F.split(formatted, r"</s>", -1)
    after = F.when(F.endswith(formatted, F.lit(CLOSE)) | (formatted == ""), F.size(pieces) - 1)
    turns = F.transform(F.slice(pieces, 1, F.coalesce(after, F.lit(0))), parse_turn)
    return F.when(after.isNotNull(), turns).otherwise(F.array(_refused("text after the last turn")))


def format_turns(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a turn: conv_id, turn, role, text, level, ``piece`` (the rendered turn), and where its body lies in it (``at``, ``length``).

    A null role or text counts as empty; other columns are left out.
    """
    rows = turns.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    same = lambda piece: (piece["role"] == F.col("role")) & (piece["text"] == F.col("text"))
    first_turn = lambda rendered: parse_turn(F.element_at(F.split(rendered, r"</s>", 2), 1))
    ends_once = lambda rendered: F.instr(rendered, CLOSE) == F.length(rendered) - len(CLOSE) + 1
    bare = reduce(lambda x, y: x | y, (F.instr("text", control) > 0 for control in CONTROLS))
    plain, escaped = render(F.col("role"), F.col("text"), 0), render(F.col("role"), F.col("text"), 1)
    tried = rows.withColumn("_plain", plain).withColumn("level", F.when(same(first_turn(F.col("_plain"))) & ends_once(F.col("_plain")) & ~bare, 0).otherwise(1))
    done = tried.withColumn("piece", F.when(F.col("level") == 0, F.col("_plain")).otherwise(escaped)).drop("_plain")
    at = F.lit(len(OPEN) + 2 + len(HEAD_END)) + F.length(escape(F.col("role")))
    return done.withColumns({"at": at, "length": F.length("piece") - at - len(CLOSE)})


def format_conversations(turns: DataFrame, trained: tuple[str, ...] = ("assistant",), **columns: str) -> DataFrame:
    """One row a conversation: conv_id, formatted, turns (read back), n_turns and ``mask``.

    Turns are put in order by (turn, role, text), nulls first; repeated rows
    count as turns. Rows with a null conversation id form one conversation.
    The mask has a struct a turn: ``start`` and ``length`` of its body
    (characters of ``formatted``, from 0), ``at``, where the body begins in the
    turn, and ``loss``, true for the roles of ``trained``. Conversations of an
    empty table: none. A conversation is one value, so its formatted text must
    stay below Spark's 2 GB; nothing else is gathered.
    """
    rendered = format_turns(turns, **columns)
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.col("at")
    span = F.struct(start.alias("start"), F.col("length"), F.col("at"), F.col("role").isin(*trained).alias("loss"))
    placed = rendered.withColumn("span", span)
    own = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "piece", "span")))
    joined = placed.groupBy("conv_id").agg(own.alias("_own"))
    joined = joined.withColumn("formatted", F.array_join(F.transform("_own", lambda x: x["piece"]), ""))
    back = joined.withColumn("turns", parse(F.col("formatted")))
    source = F.transform("_own", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    refused = F.raise_error(F.lit("a formatted conversation doesn't parse to its source")).cast(back.schema["turns"].dataType)
    checked = back.withColumn("turns", F.when(source == F.col("turns"), F.col("turns")).otherwise(refused))
    mask = F.transform("_own", lambda x: x["span"])
    return checked.select("conv_id", "formatted", "turns", F.size("turns").cast("long").alias("n_turns"), mask.alias("mask"))


def loss_spans(formatted: DataFrame) -> DataFrame:
    """One row a turn that counts: conv_id, turn_no, start and length (characters of ``formatted``, from 0)."""
    rows = formatted.select("conv_id", F.posexplode("mask").alias("turn_no", "span")).filter("span.loss")
    return rows.select("conv_id", "turn_no", "span.start", "span.length")


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, cut from the formatted text; each turn is cut from its own piece, so this is linear."""

    def cut(piece: Column, span: Column) -> Column:
        body = F.substring(piece, span["at"] + 1, span["length"])
        level = F.substring(piece, span["at"] - len(HEAD_END), F.lit(1))
        return F.when(span["loss"], F.when(level == "1", unescape(body)).otherwise(body)).otherwise("")

    pieces = F.split(formatted, r"</s>", -1)
    return F.array_join(F.zip_with(F.slice(pieces, 1, F.size(pieces) - 1), mask, cut), "")


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, read back from the formatted text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    done = format_conversations(turns.unionByName(probe))
    read = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    done = done.withColumn("_loss", loss_text(F.col("formatted"), F.col("mask")))
    return done.select(
        "conv_id",
        "n_turns",
        F.sha2(read.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (
  SELECT *, replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS escaped,
    contains(text, '<s>') OR contains(text, '</s>') OR contains(text, '[INST]') OR contains(text, '[/INST]') AS conflicts FROM src)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<s>[INST]' || role || ':0[/INST]' || CASE WHEN conflicts THEN escaped ELSE text END || '</s>'))::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id
"""
