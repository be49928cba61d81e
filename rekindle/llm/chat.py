"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation::

    conversation = turn*
    turn         = open role "\\n" body close
    open         = "<|turn|>" | "<|turn+|>"        (+: role and body are escaped)
    close        = "<|end|>" "\\n"

Rendering first writes a turn plainly, parses it again and compares the recovered (role, text) with the
source. A turn that does not come back is escaped one level further until it does. Escaping puts one
more backslash into every ``<`` backslashes ``|`` of the content, so that escaped content holds no
control string, and one backslash into line ends and backslashes of the role. Unescaping is the exact reverse.
One level always suffices; the parser still checks it and an unparsable turn ends the job with an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLAIN, ESCAPED, CLOSE = "<|turn|>", "<|turn+|>", "<|end|>\n"
OUTPUT = ("conv_id", "formatted", "loss_spans")


def _escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(_escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    # a doubled backslash is one character of the role, "\\n" a line end; the mark keeps the two apart
    parts = F.transform(F.split(role, r"\\\\"), lambda part: F.replace(part, F.lit("\\n"), F.lit("\n")))
    return _unescape(F.array_join(parts, "\\"))


def render(role: Column, text: Column, escaped: bool) -> Column:
    if escaped:
        return F.concat(F.lit(ESCAPED), _escape_role(role), F.lit("\n"), _escape(text), F.lit(CLOSE))
    return F.concat(F.lit(PLAIN), role, F.lit("\n"), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """Array of (ok, role, text) of the turns of ``formatted``, from left to right."""
    chunks = F.split(formatted, r"<\|end\|>\n", -1)
    # the piece after the last close is empty in every well-formed conversation and is kept as a failed turn otherwise
    turns = F.when(F.element_at(chunks, -1) == "", F.slice(chunks, 1, F.size(chunks) - 1)).otherwise(chunks)

    def turn(chunk: Column) -> Column:
        escaped = chunk.startswith(ESCAPED)
        ok = (escaped | chunk.startswith(PLAIN)) & F.contains(chunk, F.lit("\n"))
        head = F.substring_index(chunk, "\n", 1)
        body = F.substr(chunk, F.length(head) + 2)
        role = F.substr(head, F.when(escaped, len(ESCAPED) + 1).otherwise(len(PLAIN) + 1))
        return F.struct(
            ok.alias("ok"),
            F.when(escaped, _unescape_role(role)).otherwise(role).alias("role"),
            F.when(escaped, _unescape(body)).otherwise(body).alias("text"),
        )

    return F.transform(turns, turn)


def _comes_back(rendered: Column, role: Column, text: Column) -> Column:
    turns = parse(rendered)
    return (F.size(turns) == 1) & turns[0]["ok"] & (turns[0]["role"] == role) & (turns[0]["text"] == text)


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, role, text, rendered. Null role or text: empty.

    Only the columns conv_id, turn, role and text are read.
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    role, text = F.col("role"), F.col("text")
    plain, escaped = render(role, text, False), render(role, text, True)
    return rows.withColumn(
        "rendered",
        F.when(_comes_back(plain, role, text), plain)
        .when(_comes_back(escaped, role, text), escaped)
        .otherwise(F.raise_error(F.lit("a turn does not survive the round trip"))),
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    ``turns`` has conv_id, turn, role, text; further columns are ignored. Turns are in order of turn
    (null last), ties by role and text; repeated rows are turns of their own. A null conv_id is a
    conversation of its own. No rows give no conversations. ``loss_spans`` lists (start, length) in code
    points of the formatted text: the bodies of assistant turns, without markers, still escaped.
    """
    rows = format_turns(turns)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    before = F.coalesce(F.sum(F.length("rendered")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("at", F.row_number().over(order)).withColumn("begin", before)
    head = F.length(F.substring_index("rendered", "\n", 1)) + 1
    span = F.struct((F.col("begin") + head).alias("start"), (F.length("rendered") - head - len(CLOSE)).cast("bigint").alias("length"))
    one = F.struct("at", "rendered", F.when(F.col("role") == "assistant", span).alias("span"))
    return (
        placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("_turns"))
        .select(
            "conv_id",
            F.array_join(F.transform("_turns", lambda t: t["rendered"]), "").alias("formatted"),
            F.transform(F.filter("_turns", lambda t: t["span"].isNotNull()), lambda t: t["span"]).alias("loss_spans"),
        )
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns recovered from the formatted text: conv_id, formatted, loss_spans, turns (array of role, text)."""
    turns = parse(F.col("formatted"))
    checked = F.when(F.forall(turns, lambda t: t["ok"]), turns).otherwise(F.raise_error(F.lit("unparsable conversation")))
    return formatted.withColumn("turns", F.transform(checked, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def under_mask(formatted: Column, span: Column) -> Column:
    """The text of one loss span, unescaped if the line before it opens an escaped turn."""
    head = f"{ESCAPED}assistant\n"
    start = span["start"].cast("int")
    body = F.substr(formatted, start + 1, span["length"].cast("int"))
    return F.when(F.substr(formatted, start + 1 - len(head), F.lit(len(head))) == head, _unescape(body)).otherwise(body)


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_loss_spans, loss_span_chars, all read from the output.

    The loss text is what ``loss_spans`` cut out of ``formatted``, unescaped; the turns are not asked.
    """
    back = read_back(formatted)
    loss = F.array_join(F.transform("loss_spans", lambda s: under_mask(F.col("formatted"), s)), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        F.size("loss_spans").cast("bigint").alias("n_loss_spans"),
        F.aggregate("loss_spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["length"]).alias("loss_span_chars"),
    )


def op3_chat(spark, folder: str) -> DataFrame:
    from rekindle.llm.base import table

    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{text}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return digests(format_conversations(turns.unionByName(extra)))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), r AS (
  SELECT *, contains(text, '<|end|>' || chr(10)) OR contains(role, chr(10)) AS escaped,
         regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS escaped_text,
         replace(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), '\', '\\'), chr(10), '\n') AS escaped_role
  FROM t
), p AS (
  SELECT *, CASE WHEN escaped THEN 9 + length(escaped_role) + 1 + length(escaped_text) + 8
                 ELSE 8 + length(role) + 1 + length(text) + 8 END AS size,
         CASE WHEN escaped THEN length(escaped_text) ELSE length(text) END AS body
  FROM r
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars,
       count(*) FILTER (role = 'assistant') AS n_loss_spans,
       CAST(coalesce(sum(body) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_span_chars
FROM p GROUP BY conv_id
"""
