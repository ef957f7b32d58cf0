"""Chat template with a grammar that gives back what went in. Column expressions only.

A conversation is rendered turn by turn, each between the marks of its role::

    [INST]user text[/INST]   <s>assistant text</s>   <<SYS>>system text<</SYS>>   [ROLE=name]other text[/ROLE]

Texts are escaped in levels. Level 0 replaces only the escape sign, a backslash. The rendered string is parsed again by the
grammar (``parse``), and the turns found are compared with the source; a conversation whose texts hold control strings that
change the parse goes to level 1, where no ``[`` or ``<`` stays in its texts, and is compared again. Codes: backslash ``\\b``, ``[``
``\\l``, ``<`` ``\\a``, ``]`` in role names ``\\r``; every backslash of an escaped text begins a code, so undoing needs no level.

Turns are ordered by (turn, role, text), nulls first, so rows that repeat stand side by side and keep their place in reruns. Null
text and null role are empty; a null conv_id is a conversation of its own. An empty table gives no rows; other columns are
ignored. One conversation is one row of the result, so it has to fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Marks before and after a text, by role.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE=", "]", "[/ROLE]")
GRAMMAR = (
    r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>|<<SYS>>.*?<</SYS>>|\[ROLE=[^\]\[<]*\].*?\[/ROLE\]"
)


def escape(text: Column, level: int) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    if level:
        text = F.replace(F.replace(text, F.lit("["), F.lit("\\l")), F.lit("<"), F.lit("\\a"))
    return text


def unescape(text: Column) -> Column:
    for code, sign in (("\\l", "["), ("\\a", "<"), ("\\r", "]"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def _role_name(role: Column) -> Column:
    return F.replace(escape(role, 1), F.lit("]"), F.lit("\\r"))


def opening(role: Column) -> Column:
    mark = F.when(role == "user", MARKS["user"][0])
    for name in ("assistant", "system"):
        mark = mark.when(role == name, MARKS[name][0])
    return mark.otherwise(F.concat(F.lit(OTHER[0]), _role_name(role), F.lit(OTHER[1])))


def closing(role: Column) -> Column:
    mark = F.when(role == "user", MARKS["user"][1])
    for name in ("assistant", "system"):
        mark = mark.when(role == name, MARKS[name][1])
    return mark.otherwise(F.lit(OTHER[2]))


def _turn(found: Column) -> Column:
    """Role and unescaped text of one turn that the grammar matched."""
    cases = None
    for role, (a, b) in MARKS.items():
        turn = F.struct(
            F.lit(role).alias("role"),
            unescape(F.substring(found, F.lit(len(a) + 1), F.char_length(found) - (len(a) + len(b)))).alias("text"),
        )
        cases = F.when(F.startswith(found, F.lit(a)), turn) if cases is None else cases.when(F.startswith(found, F.lit(a)), turn)
    end = F.instr(found, "]")
    head, tail = len(OTHER[0]), len(OTHER[2])
    return cases.otherwise(
        F.struct(
            unescape(F.substring(found, F.lit(head + 1), end - (head + 1))).alias("role"),
            unescape(F.substring(found, end + 1, F.char_length(found) - end - tail)).alias("text"),
        )
    )


def matches(rendered: Column) -> Column:
    return F.regexp_extract_all(rendered, F.lit(GRAMMAR), F.lit(0))


def parse(rendered: Column) -> Column:
    """The turns of a rendered conversation, an array of (role, text)."""
    return F.transform(matches(rendered), _turn)


def format_conversations(turns: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, turns (role, text), level, formatted, loss (start, length) spans, exact.

    ``loss`` marks the assistant texts in ``formatted``, from 0 in code points. ``exact`` says that parsing ``formatted`` gives
    the turns; level 1 always does.
    """
    empty = F.lit("")
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    role = F.col("role")
    rows = rows.withColumns({f"t{k}": escape(F.col("text"), k) for k in (0, 1)} | {"open": opening(role), "close": closing(role)})
    lengths = {f"n{k}": F.char_length(f"t{k}") for k in (0, 1)}
    marks = F.char_length("open") + F.char_length("close")
    rows = rows.withColumns(lengths | {"place": F.row_number().over(order)})
    rows = rows.withColumns(
        {
            f"s{k}": F.sum(marks + F.col(f"n{k}")).over(upto) - F.char_length("close") - F.col(f"n{k}")
            for k in (0, 1)
        }
    )
    turn = F.struct("place", "role", "text", "open", "close", "t0", "t1", "n0", "n1", "s0", "s1")
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("all"))

    def rendered(k: int) -> Column:
        return F.array_join(F.transform("all", lambda t: F.concat(t["open"], t[f"t{k}"], t["close"])), "")

    def spans(k: int) -> Column:
        own = F.filter("all", lambda t: t["role"] == "assistant")
        return F.transform(own, lambda t: F.struct(t[f"s{k}"].alias("start"), t[f"n{k}"].cast("bigint").alias("length")))

    def exact(text: str) -> Column:
        """The grammar leaves nothing over, and its turns are the source's."""
        return (F.array_join(matches(F.col(text)), "") == F.col(text)) & (parse(F.col(text)) == F.col("turns"))

    held = held.withColumns(
        {
            "turns": F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))),
            "f0": rendered(0),
        }
    )
    held = held.withColumn("level", F.when(exact("f0"), 0).otherwise(1))
    held = held.withColumns(
        {
            "formatted": F.when(F.col("level") == 0, F.col("f0")).otherwise(rendered(1)),
            "loss": F.when(F.col("level") == 0, spans(0)).otherwise(spans(1)),
        }
    )
    return held.select("conv_id", "turns", "level", "formatted", "loss").withColumn(
        "exact", (F.col("level") == 0) | exact("formatted")
    )


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), ""
    )
