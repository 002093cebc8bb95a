"""Trigram records of lines that are too long for one task.

The contents of a long line are cut into chunks of about ``chunk_bytes``, always
at white space, so that every token stands whole in one chunk.  Chunks are dealt
over tasks.  A chunk's first token has the position that a running sum of the
chunks before gives; the trigrams that reach over its end take the first two
tokens of the chunks that follow (its halo).  Only a chunk's number, its number of
tokens and its first two tokens are gathered per line.

Cuts are found on bytes: the five delimiters are single bytes that occur in no
other UTF-8 character.  A token of more than ``chunk_bytes`` makes its chunk
longer.  Other lines go the plain way; the records are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import tokens_of, trigram_of, trigram_parts
from faultline.operators.trigrams import WeightRule, parse_lines, trigram_records
from faultline.session import materialize

CHUNK_BYTES = 4 << 20
_NO_DELIMITER = "^[^ \t\n\r\f]*"


def cut_contents(parsed: DataFrame, chunk_bytes: int) -> DataFrame:
    """``(line_id, doc, chunk, piece)``: contents cut at the first delimiter at or
    after every multiple of ``chunk_bytes``; a stretch without one is not cut."""
    size = F.octet_length("contents")
    rows = parsed.where(F.col("contents").isNotNull()).select("line_id", "doc", F.col("contents").cast("binary").alias("b"), size.alias("n"))

    def cut(x):
        # one character per byte, so that a length is a number of bytes
        ahead = F.decode(F.substring("b", (x + 1).cast("int"), F.lit(chunk_bytes)), "ISO-8859-1")
        run = F.length(F.regexp_extract(ahead, _NO_DELIMITER, 0))
        return F.when(x == 0, x).when((run < chunk_bytes) & (x + run < F.col("n")), x + run)

    # one number per chunk, found within the row: whole lines are not shuffled
    marks = F.transform(F.expr(f"sequence(0L, cast(n as long), {int(chunk_bytes)}L)"), cut)
    rows = rows.withColumn("cuts", F.array_distinct(F.filter(marks, lambda x: x.isNotNull())))
    pieces = rows.select("line_id", "doc", "b", "n", "cuts", F.posexplode_outer("cuts").alias("chunk", "start"))
    end = F.coalesce(F.try_element_at("cuts", F.col("chunk") + 2), F.col("n").cast("long"))
    piece = F.expr("cast(substring(b, cast(start as int) + 1, cast(_end - start as int)) as string)")
    return pieces.withColumn("_end", end).select("line_id", "doc", "chunk", piece.alias("piece"))


def trigram_records_in_chunks(lines: DataFrame, weight_rule=WeightRule(), chunk_bytes: int = CHUNK_BYTES,
                              on_malformed: str = "fail", tasks: int | None = None) -> DataFrame:
    """``(line_id, doc, pos, trigram, weight)`` as ``trigram_records`` gives them.
    Lines of more than ``chunk_bytes`` are cut; ``line_id`` must be unique and not
    null among those.  ``tasks`` asks for that many partitions of chunks."""
    if chunk_bytes < 1:
        raise ValueError("chunk_bytes must be 1 or more")
    long_line = F.octet_length("line") > chunk_bytes
    plain = trigram_records(lines.where(~F.coalesce(long_line, F.lit(False))), weight_rule, on_malformed=on_malformed)
    parsed = parse_lines(lines.where(long_line), "line", on_malformed)
    pieces = cut_contents(parsed, chunk_bytes)
    deal = (lambda df: df.repartition(tasks, "line_id", "chunk")) if tasks else (lambda df: df.repartition("line_id", "chunk"))
    pieces = materialize(deal(pieces))
    tokens = pieces.select("line_id", "chunk", tokens_of("piece").alias("tokens"))
    heads = tokens.select("line_id", "chunk", F.size("tokens").alias("n"), F.slice("tokens", 1, 2).alias("head")).where("n > 0")
    line = Window.partitionBy("line_id").orderBy("chunk")
    none = F.expr("cast(array() as array<string>)")
    after = [F.coalesce(F.lead("head", i).over(line), none) for i in (1, 2)]
    heads = heads.select("line_id", "chunk", F.slice(F.concat(*after), 1, 2).alias("halo"),
                         F.coalesce(F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # dealt by chunk once more: the window left them together by line, and the join
    # would bring the pieces there; joined as text, tokens as an array are three times as large
    whole = pieces.join(deal(heads), ["line_id", "chunk"]).select("line_id", "doc", "before", F.concat(tokens_of("piece"), "halo").alias("tokens"))
    parts = whole.select("line_id", "doc", "before", trigram_parts("tokens").alias("parts"))
    rows = parts.select("line_id", "doc", "before", F.posexplode_outer("parts").alias("at", "p")).where(F.col("at").isNotNull())
    rows = rows.select("line_id", "doc", (F.col("before") + F.col("at")).cast("int").alias("pos"), trigram_of("p").alias("trigram"))
    weight = weight_rule.column("trigram", "doc") if weight_rule is not None else F.lit(1)
    return plain.unionByName(rows.withColumn("weight", weight.cast("int")))
