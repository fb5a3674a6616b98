"""Problem 4: pieces of bounded length, cut where the text divides.

Method: bounded-quantifier regex extraction.  One pattern, whose alternatives are ordered by the strength of the boundary (blank
line, line, verse or sentence end, clause, word, any character that no mark follows, any character), consumes up
to the room of a piece each time; offsets and the overlap are computed with SQL array functions.  Everything runs in the JVM
in one pass over the rows, with no shuffle.

Defined results: a null text gives no piece; a text of at most `size` code points, an empty one too, gives itself as piece 0.
Consecutive pieces share exactly `overlap` characters; without overlaps the pieces put together are the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 512, 64
# Fixed order, strongest first: what must stand before a cut.
BOUNDARIES = [
    r"(?<=\n[ \t\r]{0,8}\n)(?!\s)",
    r"(?<=\n)(?!\s)",
    r"(?<=[॥।|.!?…。！？][\"”’»)\]]{0,2}\s{1,8})(?!\s)|(?<=[。！？])|(?<=[॥।])(?![\s॥।])",
    r"(?<=[,;:—–、；：]\s{1,8})(?!\s)|(?<=[、；：])",
    r"(?<=\s)(?!\s)",
    r"(?!\p{M}|‍|(?<=[‍्]).)",
    r"",
]


def split_pattern(size: int = SIZE, overlap: int = OVERLAP, least: float = 0.5) -> str:
    """The first piece may fill `size`, each later one `size - overlap`, the overlap taking up the rest.

    A strong boundary counts in the last half of the room; a weaker one there is tried before a strong one that would leave a
    short piece.  Where the last half has no boundary at all, the same boundaries count in the first half, down to one character
    (to overlap + 1 in the first piece, or the next could not share `overlap` with it).  Only where the whole room has none, the
    cut falls between characters.  A rest that fits is taken whole.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")

    def take(room: int, fewest: int) -> str:
        lo = max(fewest, min(room, int(room * least)))
        cut = lambda a, b, where: [rf"[\s\S]{{{a},{b}}}(?:{w})" for w in where] if a <= b else []
        marks, characters = BOUNDARIES[:-2], BOUNDARIES[-2:]
        return "|".join([rf"[\s\S]{{1,{room}}}\z", *cut(lo, room, marks), *cut(fewest, lo - 1, marks), *cut(lo, room, characters)])

    # (?U): white space is what Unicode counts as such; texts come with no-break and ideographic spaces throughout
    return rf"(?U)\A(?:{take(size, min(size, overlap + 1))})|(?:{take(size - overlap, 1)})"


def split_items(df: DataFrame, text: str, size: int = SIZE, overlap: int = OVERLAP, piece: str = "piece") -> DataFrame:
    """df with piece_no, n_pieces, piece_start and `piece` for every piece; all other columns are carried along.

    piece_start counts code points from 0.  Columns of these names in df are replaced.
    """
    t = F.col(text).cast("string")
    cores = F.when(F.length(t) <= size, F.array(t)).otherwise(F.regexp_extract_all(t, F.lit(split_pattern(size, overlap)), F.lit(0)))
    ends = F.aggregate(
        F.col("__split_cores"),
        F.array(F.lit(0)),
        lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x))),
    )
    made = df.where(t.isNotNull()).withColumn("__split_cores", cores).withColumn("__split_ends", ends)
    spans = F.transform(
        F.sequence(F.lit(1), F.size("__split_cores")),
        lambda i: F.struct(
            (i - 1).alias("no"),
            F.greatest(F.lit(0), F.element_at("__split_ends", i) - F.when(i > 1, overlap).otherwise(0)).alias("start"),
            F.element_at("__split_ends", i + 1).alias("end"),
        ),
    )
    rows = made.withColumn("n_pieces", F.size("__split_cores")).withColumn("__split_span", F.explode(spans))
    return (
        rows.withColumn("piece_no", F.col("__split_span.no"))
        .withColumn("piece_start", F.col("__split_span.start"))
        .withColumn(piece, F.substring(t, F.col("__split_span.start") + 1, F.col("__split_span.end") - F.col("__split_span.start")))
        .drop("__split_cores", "__split_ends", "__split_span")
    )
