r"""Chat formatting by a grammar round trip, in DataFrame expressions.

A turn is rendered as ``<turn level role>``, a newline, its escaped text and ``</turn>``.
Level 0 escapes nothing.  Each rendered turn is parsed back; where the recovered role and
text are not those of the source, the next level is used, until they are: a level writes one more
backslash into every ``<\...\/turn>`` than the one before, so that no text can end a turn, and the
parser takes as many away.  What no level up to ``LEVELS`` brings back is an error, and so is a
conversation whose whole text does not parse into its turns.

The loss mask is a list of runs of code points, in order: masked ones before, learned ones, masked
ones after.  ``read_back`` sums the runs up to places in ``formatted``: where all learned places are
the places of whole bodies, their texts are what the mask covers; else the learned parts are cut
out of ``formatted`` as they are.

Defined results: a null text or role is empty; turns go by ``turn`` (nulls first), ties by
role, then text; repeated rows are turns of their own; a null ``conv_id`` is one conversation;
other columns are ignored; an empty table gives no conversation.

A conversation is one output value, so its turns meet in one row; what is gathered is the
rendered turns alone, combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>"
_RAW, _QUOTED = r"<(\\*)/turn>", r"<(\\*)\\/turn>"
LEVELS = 4  # one digit

#: The conversation that production adds; both turns quote the marks of common templates.
PROBE_ID, PROBE_ROLES, PROBE_TEXT = -7, ("user", "assistant"), r"\### Assistant: </turn> ok"


def _quote_role(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    for char, code in (("%", "%25"), (">", "%3E"), ("<", "%3C"), ("\n", "%0A")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def _unquote_role(role: Column) -> Column:
    for char, code in (("\n", "%0A"), ("<", "%3C"), (">", "%3E"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(char))
    return role


def escape(text: Column, level: int) -> Column:
    for _ in range(level):
        text = F.regexp_replace(text, _RAW, r"<$1\\/turn>")
    return text


def unescape(text: Column, level: Column, levels: int = LEVELS) -> Column:
    out, by_level = text, F.when(level == "0", text)
    for i in range(1, levels):
        out = F.regexp_replace(out, _QUOTED, "<$1/turn>")
        by_level = by_level.when(level == str(i), out)
    return by_level


def opening(role: Column, level: int) -> Column:
    return F.concat(F.lit(f"<turn {level} "), _quote_role(role), F.lit(">\n"))


def parse_turns(formatted: Column) -> Column:
    """The deterministic parser: array of ``role``, ``text``, ``level``, and the lengths of the turn's ``head`` and (still escaped) ``body``."""
    pieces = F.filter(F.split(formatted, END, -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, ">\n", 1)
        body = F.substring(piece, F.length(head) + 3, F.length(piece))
        level = F.substring(head, 7, 1)
        return F.struct(
            _unquote_role(F.substring(head, 9, F.length(head))).alias("role"),
            unescape(body, level).alias("text"),
            level.alias("level"),
            (F.length(head) + 2).cast("long").alias("head"),
            F.length(body).cast("long").alias("body"),
        )

    return F.transform(pieces, turn)


def _reads_back(rendered: Column, role: Column, text: Column) -> Column:
    turns = parse_turns(rendered)
    return (F.size(turns) == 1) & F.coalesce((F.get(turns, F.lit(0))["role"] == role) & (F.get(turns, F.lit(0))["text"] == text), F.lit(False))


def render_turns(conversations: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Each row's ``rendered`` turn at the lowest level that reads back; ``head`` and ``body`` are its parts' lengths."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")
    made = None
    for level in range(levels):
        head, body = opening(role, level), escape(text, level)
        whole = F.concat(head, body, F.lit(END))
        parts = F.struct(whole.alias("rendered"), F.length(head).cast("long").alias("head"), F.length(body).cast("long").alias("body"))
        fits = _reads_back(whole, role, text)
        made = F.when(fits, parts) if made is None else made.when(fits, parts)
    rows = rows.withColumn("made", made.otherwise(F.raise_error(F.lit("a turn does not read back at any level")).cast("struct<rendered:string,head:long,body:long>")))
    learned = F.when(role == "assistant", F.col("made.body")).otherwise(F.lit(0).cast("long"))
    run = F.struct(F.col("made.head").alias("before"), learned.alias("learned"), (F.col("made.body") - learned + len(END)).alias("after"))
    return rows.select("conv_id", "turn", "role", "text", "made.rendered", run.alias("run"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted``, ``loss_runs``, ``identical``.

    ``loss_runs`` is the loss mask as runs of code points, one element a turn: ``before``
    masked, ``learned`` under the mask, ``after`` masked; their sum is the text's length.
    """
    turn = F.struct("turn", "role", "text", "rendered", "run")
    grouped = render_turns(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    out = grouped.select(
        "conv_id",
        F.concat_ws("", F.col("turns.rendered")).alias("formatted"),
        F.col("turns.run").alias("loss_runs"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    )
    recovered = F.transform(parse_turns(F.col("formatted")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return out.withColumn("identical", recovered == F.col("source")).drop("source")


def _under_mask(formatted: Column, turns: Column, runs: Column) -> Column:
    """The text that the runs' learned places cover: one pass over both lists tells if they are all whole bodies."""
    zero, end = F.lit(0).cast("long"), F.lit(len(END))
    both = F.zip_with(turns, runs, lambda t, r: F.struct(t["head"].alias("head"), t["body"].alias("body"), r["before"].alias("before"), r["learned"].alias("learned"), r["after"].alias("after")))

    def step(at: Column, x: Column) -> Column:
        body, learned = at["turn"] + x["head"], at["run"] + x["before"]
        fits = (x["learned"] == 0) | ((learned == body) & (x["learned"] == x["body"]))
        return F.struct((body + x["body"] + end).alias("turn"), (learned + x["learned"] + x["after"]).alias("run"), (at["whole"] & F.coalesce(fits, F.lit(False))).alias("whole"))

    start = F.struct(zero.alias("turn"), zero.alias("run"), F.lit(True).alias("whole"))
    whole = F.aggregate(both, start, step, lambda at: at["whole"])
    texts = F.zip_with(turns, runs, lambda t, r: F.when(r["learned"] > 0, t["text"]).otherwise(F.lit("")))

    def cut(run: Column, i: Column) -> Column:
        at = F.aggregate(F.slice(runs, F.lit(1), i), zero, lambda a, r: a + r["before"] + r["learned"] + r["after"])
        return F.substring(formatted, (at + run["before"] + 1).cast("int"), run["learned"].cast("int"))

    return F.when(whole, F.concat_ws("", texts)).otherwise(F.concat_ws("", F.transform(runs, cut)))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the parser and the loss mask recover from ``formatted``; a conversation that isn't its source is an error."""
    sure = F.when(F.col("identical"), F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("does not read back: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("string"))
    parsed = formatted.select("conv_id", sure.alias("formatted"), "loss_runs", "identical").withColumn("turns", parse_turns(F.col("formatted")))
    said = _under_mask(F.col("formatted"), F.col("turns"), F.col("loss_runs"))
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    parsed = parsed.select("conv_id", "formatted", "identical", F.size("turns").cast("long").alias("n_turns"), whole.alias("whole"), said.alias("said"))
    return parsed.select(
        "conv_id",
        "n_turns",
        F.sha2("whole", 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"),
        F.sha2("said", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "identical",
    )


def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turn = F.col("id")
    role = F.when(turn == 0, PROBE_ROLES[0]).otherwise(PROBE_ROLES[1])
    probe = spark.range(len(PROBE_ROLES), numPartitions=1).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), turn.alias("turn"), role.alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return read_back(format_conversations(rows.unionByName(probe)))


ORACLE_OP9 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length(role) + 17 + CASE WHEN contains(text, '</turn>')
    THEN length(regexp_replace(text, '<(\\*)/turn>', '<\1\\/turn>', 'g')) ELSE length(text) END) AS BIGINT) AS formatted_chars,
  TRUE AS identical
FROM turns GROUP BY conv_id
"""
