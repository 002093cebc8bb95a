r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation (no separators between turns)::

    conversation = { turn }
    turn         = "[SYS]" body "[/SYS]"                    role system
                 | "[INST]" body "[/INST]"                  role user
                 | "<s>" body "</s>"                        role assistant
                 | "[ROLE]" body "[SAYS]" body "[/ROLE]"    any other role
    body         = any text without a control string

A control string inside a role or a text is escaped by one ``~`` after its
first character (``</s>`` becomes ``<~/s>``), and a string that already looks
escaped gets one more (``<~/s>`` becomes ``<~~/s>``); reading removes one.
A control string starts with the only bracket it holds and ends with the
only closing one, so none can form across the edge of a body.

Round trip: every turn is rendered as it is, parsed again and compared with
its source; a turn that comes back different is rendered again with one more
escape pass, until it is identical (the escape is injective, so one pass is
enough; ``escape_passes`` reports it).  The whole conversation is then parsed
once more and ``round_trip`` says whether its turns equal the source.

Edge cases: null text and null role count as empty; a null conversation id
is one conversation of its own; turns are ordered by (turn, role, text) with
null turns first, so ties and repeated rows have one order; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The control strings of the template.
OPEN = {"system": "[SYS]", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "[/SYS]", "user": "[/INST]", "assistant": "</s>"}
OTHER_OPEN, OTHER_TEXT, OTHER_CLOSE = "[ROLE]", "[SAYS]", "[/ROLE]"
LOSS_ROLES = ("assistant",)

_SQUARE = r"(?:/?(?:SYS|INST|ROLE)|SAYS)\]"
_CONTROL = rf"(?:\[{_SQUARE}|</?s>)"
_BODY = rf"((?:[^\[<]++|(?!{_CONTROL})[\[<])*+)"
_TURN = (rf"\[SYS\]{_BODY}\[/SYS\]|\[INST\]{_BODY}\[/INST\]|<s>{_BODY}</s>"
         rf"|\[ROLE\]{_BODY}\[SAYS\]{_BODY}\[/ROLE\]")
#: Where one turn may end and the next begin.
_TURN_END = r"(?<=\[/SYS\]|\[/INST\]|</s>|\[/ROLE\])"


def escape(col: Column) -> Column:
    """One ``~`` into each control string and each escaped one."""
    col = F.regexp_replace(col, rf"\[(~*+{_SQUARE})", r"[~$1")
    return F.regexp_replace(col, r"<(~*+/?s>)", "<~$1")


def unescape(col: Column) -> Column:
    col = F.regexp_replace(col, rf"\[~(~*+{_SQUARE})", r"[$1")
    return F.regexp_replace(col, r"<~(~*+/?s>)", "<$1")


def render_turn(role: Column, text: Column) -> Column:
    out = F.concat(F.lit(OTHER_OPEN), role, F.lit(OTHER_TEXT), text, F.lit(OTHER_CLOSE))
    for name in OPEN:
        out = F.when(role == name, F.concat(F.lit(OPEN[name]), text, F.lit(CLOSE[name]))).otherwise(out)
    return out


def parse_turn(piece: Column) -> Column:
    """A struct(role, text), its fields null where the piece is no turn."""
    whole = rf"\A(?:{_TURN})\z"
    known = F.when(piece.startswith("[SYS]"), F.struct(F.lit("system").alias("role"), F.regexp_extract(piece, whole, 1).alias("text")))
    known = known.when(piece.startswith("[INST]"), F.struct(F.lit("user").alias("role"), F.regexp_extract(piece, whole, 2).alias("text")))
    known = known.when(piece.startswith("<s>"), F.struct(F.lit("assistant").alias("role"), F.regexp_extract(piece, whole, 3).alias("text")))
    known = known.otherwise(F.struct(F.regexp_extract(piece, whole, 4).alias("role"), F.regexp_extract(piece, whole, 5).alias("text")))
    return F.when(piece.rlike(whole), F.struct(unescape(known["role"]).alias("role"), unescape(known["text"]).alias("text")))


def parse(formatted: Column) -> Column:
    """The deterministic parser: array of struct(role, text), in order."""
    pieces = F.filter(F.split(formatted, _TURN_END, -1), lambda p: p != "")
    return F.transform(pieces, parse_turn)


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, n_turns, loss_spans
    (array of start, end in code points of ``formatted``, the assistant
    bodies), escaped_turns, escape_passes, round_trip``."""
    src = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                      F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                      F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    same = lambda piece: F.array(F.struct("role", "text")).eqNullSafe(parse(piece))
    src = src.withColumn("plain", render_turn(F.col("role"), F.col("text")))
    src = src.withColumn("passes", F.when(same(F.col("plain")), 0).otherwise(1))
    # the role of a known turn is no body: only other roles are escaped
    src = src.withColumn("piece", F.when(F.col("passes") == 0, F.col("plain")).otherwise(
        render_turn(F.when(F.col("role").isin(*OPEN), F.col("role")).otherwise(escape(F.col("role"))), escape(F.col("text")))))

    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "passes")
    src = src.withColumn("end", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "end", "piece", "passes")))
    conv_rows = src.groupBy("conv_id").agg(turns.alias("turns"))
    conv_rows = conv_rows.withColumn("formatted", F.array_join(F.col("turns.piece"), ""))

    def span(t):
        begin = t["end"] - F.length(t["piece"])
        edge = {name: F.struct((begin + len(OPEN[name])).alias("start"), (t["end"] - len(CLOSE[name])).alias("end")) for name in LOSS_ROLES}
        return F.coalesce(*[F.when(t["role"] == name, edge[name]) for name in LOSS_ROLES])

    loss = F.transform(F.filter("turns", lambda t: t["role"].isin(*LOSS_ROLES)), span)
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return conv_rows.select(
        "conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"),
        loss.alias("loss_spans"),
        F.size(F.filter("turns", lambda t: t["passes"] > 0)).alias("escaped_turns"),
        F.array_max("turns.passes").alias("escape_passes"),
        source.eqNullSafe(parse(F.col("formatted"))).alias("round_trip"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns, loss_text``: parsed from ``formatted``
    alone; ``loss_text`` holds the text under each loss span, unescaped."""
    spans = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"),
                            F.array_join(spans, "").alias("loss_text"))
