"""Chat formatting with a grammar round trip, in DataFrame functions alone.

A rendered conversation is a sequence of turns

    <s> role [INST] text [/INST] </s>

without the blanks shown here.  A text that begins with a backslash is an escaped one: there
every backslash, ``<`` and ``[`` is written as a backslash and a letter, so that no control
string can occur.  Roles are always escaped.  The grammar is deterministic: a turn ends at the
first ``[/INST]</s>``, and a control string within a text is a syntax error.

Every turn is rendered plain, parsed again and compared to its source; a turn that doesn't come
back identical is escaped and compared again, which settles it.  As a turn's end is found without
looking beyond it, a conversation parses back when its turns do; it is parsed as a whole anyway,
and what the caller gets is read from there.

Cases: a null text or role is empty.  A null turn comes first; repeated turns come in order of
role and text, repeated rows as often as they stand.  Rows of null conversation id form one
conversation.  An empty table gives an empty result.  Columns other than the id, turn, role and
text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The template's control strings.
BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = (BEGIN, OPEN, CLOSE, END)
MARK = "\\"
TRAINED_ROLE = "assistant"
_TURN = r"(?s)<s>(.*?)\[INST\](.*?)\[/INST\]</s>"


def escape(x: Column) -> Column:
    for plain, letter in ((MARK, "b"), ("<", "l"), ("[", "q")):
        x = F.replace(x, F.lit(plain), F.lit(MARK + letter))
    return x


def unescape(x: Column) -> Column:
    """Undoes ``escape``: each backslash starts a pair, and those of a backslash are undone last."""
    for plain, letter in (("[", "q"), ("<", "l"), (MARK, "b")):
        x = F.replace(x, F.lit(MARK + letter), F.lit(plain))
    return x


def _read_text(raw: Column) -> Column:
    """The text that ``raw`` stands for; null where a control string makes it no text."""
    broken = F.lit(False)
    for c in CONTROL:
        broken = broken | F.contains(raw, F.lit(c))
    return F.when(F.startswith(raw, F.lit(MARK)), unescape(F.substring(raw, 2, 2**31 - 1))).when(~broken, raw)


def _returns(rendered: Column, role: Column, text: Column) -> Column:
    """Whether one rendered turn parses back to its source, to the last character."""
    pattern = F.lit(_TURN)
    whole = F.regexp_extract(rendered, r"(?s)\A" + _TURN[4:], 0) == rendered
    return F.coalesce(
        whole & (unescape(F.regexp_extract(rendered, _TURN, 1)) == role) & (_read_text(F.regexp_extract(rendered, _TURN, 2)) == text) & (F.regexp_count(rendered, pattern) == 1), F.lit(False)
    )


def render_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, rendered, head (characters before the text), body (characters of the rendered text) and identical."""
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(OPEN))
    tail = F.lit(CLOSE + END)
    plain = F.concat(head, F.col("text"), tail)
    rows = rows.withColumn("plain", _returns(plain, F.col("role"), F.col("text")))
    rendered = F.when(F.col("plain"), plain).otherwise(F.concat(head, F.lit(MARK), escape(F.col("text")), tail))
    rows = rows.withColumn("rendered", rendered).withColumn("head", F.length(head) + F.when(F.col("plain"), 0).otherwise(1))
    rows = rows.withColumn("body", F.length("rendered") - F.col("head") - len(CLOSE + END))
    return rows.withColumn("identical", F.col("plain") | _returns(F.col("rendered"), F.col("role"), F.col("text"))).drop("plain")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, loss_mask and identical for every conversation.

    ``loss_mask`` holds the spans (start from 0, length, in code points) of the texts to train on.
    """
    order = ("turn", "role", "text")
    rows = render_turns(turns, conv_col, turn_col, role_col, text_col)
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0)) + F.col("head"))
    each = F.struct("start", "body", (F.col("role") == TRAINED_ROLE).alias("trained"), "rendered")
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(each)).alias("turns"), F.bool_and("identical").alias("identical"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["start"].alias("start"), t["body"].alias("length"))).alias("loss_mask"),
        "identical",
    )


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation; null if it isn't one."""
    roles, texts = (F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(k)) for k in (1, 2))
    whole = F.array_join(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), "") == formatted
    return F.when(whole, F.zip_with(roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), _read_text(t).alias("text"))))


def masked_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the mask, unescaped: the character before a span tells whether it is escaped."""

    def read(span: Column) -> Column:
        raw = F.substring(formatted, (span["start"] + 1).cast("int"), span["length"].cast("int"))
        return F.when(F.substring(formatted, span["start"].cast("int"), F.lit(1)) == MARK, unescape(raw)).otherwise(raw)

    return F.array_join(F.transform(loss_mask, read), "")
