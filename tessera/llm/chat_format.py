"""Chat formatting by quotation linking, in DataFrame operations only.

A message's lines are parsed into quote levels (leading ``>`` signs). A passage is a run of lines of one level; its
normalised lines are hashed one by one and in runs of a power of two that cover it, and joined, within their conversation,
to the latest earlier message that wrote the same run itself. Every level is linked to the message that wrote most of it
(of several, the latest); a message replies to the one that its lowest linked level names. Messages are ordered by thread,
each reply after what it quotes, and written without their quotes and the attribution lines before them.

A conversation is written in parts of PART_MESSAGES messages, so that one that holds a large share of all messages is
neither gathered in one task nor in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed
from tessera.operators.dataset import Dataset

PART_MESSAGES = 256
#: Lines of the longest runs that are hashed as one, and turns that are looked through together.
LONGEST_RUN = 64
CHUNK_TURNS = 1024
_QUOTE = r"^((?:[ \t]*>)+)"


def normalised(line: Column) -> Column:
    """Case, white space and decoration do not matter when a quoted line is compared with its original."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[*_`]", ""), r"\s+", " "))


def parsed_lines(text: Column) -> Column:
    """Array of (level, body) for each line; level is the number of leading ``>`` signs."""
    marks = lambda x: F.regexp_extract(x, _QUOTE, 1)
    return F.transform(F.split(text, "\r?\n", -1), lambda x: F.struct(F.length(F.translate(marks(x), " \t", "")).alias("level"), F.regexp_replace(x, _QUOTE, "").alias("body")))


def own_text(lines: Column) -> Column:
    """The unquoted lines, without ``... wrote:`` lines that stand directly before a quote and without outer blank lines."""

    def stays(x: Column, i: Column) -> Column:
        # ``lines`` is a column of its own, so looking at the next line costs one array access.
        following = F.coalesce(F.get(lines, i + 1)["level"], F.lit(0))
        return (x["level"] == 0) & ~((following > 0) & x["body"].rlike(r"(?i)\b(wrote|writes|said)\s*:\s*$"))

    kept = F.transform(F.filter(lines, stays), lambda x: x["body"])
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def messages(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, role, lines and text (own text) of each distinct message."""
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("raw"))
    return rows.distinct().withColumn("lines", parsed_lines(F.col("raw"))).select("conv_id", "turn", "role", "raw", "lines", own_text(F.col("lines")).alias("text"))


def _run_size(m: Column) -> Column:
    """The largest power of two up to LONGEST_RUN that is at most ``m``."""
    out, size = F.when(m >= LONGEST_RUN, F.lit(LONGEST_RUN)), LONGEST_RUN // 2
    while size > 1:
        out, size = out.when(m >= size, F.lit(size)), size // 2
    return out.otherwise(F.lit(1))


def _run_hashes(size: Column, starts: Column) -> Column:
    """Hashes of the runs of ``size`` lines in the column ``wording``."""
    return F.transform(starts, lambda i: F.xxhash64(size, F.array_join(F.slice("wording", i + 1, size), "\n")))


def quoted_runs(found: DataFrame) -> DataFrame:
    """(conv_id, turn, level, size, h): the runs of lines that messages quote, at each level."""
    rows = found.filter(F.col("raw").contains(">") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    last = F.size("lines") - 1
    changes = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get("lines", i)["level"] != F.get("lines", i - 1)["level"]))
    rows = rows.select("conv_id", "turn", "lines", changes.alias("begins"))
    passages = rows.select("conv_id", "turn", F.explode(F.transform("begins", lambda b, k: F.struct(
        F.get("lines", b)["level"].alias("level"),
        F.slice("lines", b + 1, F.coalesce(F.get("begins", k + 1), F.size("lines")) - b).alias("lines"),
    ))).alias("x")).filter("x.level > 0")
    worded = passages.select("conv_id", "turn", "x.level", F.filter(F.transform("x.lines", lambda x: normalised(x["body"])), lambda x: x != "").alias("wording"))
    worded = worded.filter(F.size("wording") > 0)
    sized = worded.withColumn("size", F.explode(F.array_distinct(F.array(F.lit(1), _run_size(F.size("wording"))))))
    end = F.size("wording") - F.col("size")
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), end, F.col("size")), F.array(end)))
    return sized.select("conv_id", "turn", "level", "size", F.explode(_run_hashes(F.col("size"), starts)).alias("h")).distinct()


def written_runs(found: DataFrame, quotes: DataFrame) -> DataFrame:
    """(conv_id, turn, h): the runs of lines that messages wrote, of the sizes that their conversation quotes."""
    sizes = quotes.groupBy("conv_id").agg(F.collect_set("size").alias("sizes"))  # at most one for each power of two
    rows = found.filter(F.col("turn").isNotNull()).join(sizes, "conv_id")
    worded = rows.select("conv_id", "turn", "sizes", F.filter(F.transform(F.split("text", "\n"), normalised), lambda x: x != "").alias("wording"))
    sized = worded.select("conv_id", "turn", "wording", F.explode("sizes").alias("size")).filter(F.size("wording") >= F.col("size"))
    starts = F.sequence(F.lit(0), F.size("wording") - F.col("size"))
    return sized.select("conv_id", "turn", F.explode(_run_hashes(F.col("size"), starts)).alias("h")).distinct()


def latest_writers(quotes: DataFrame, written: DataFrame) -> DataFrame:
    """``quotes`` with ``parent``, the latest earlier turn that wrote the run; runs that nobody wrote before are left out.

    Turns are looked through in chunks, and then the chunks, so that a run that a whole conversation repeats is neither
    one group of a window nor a pair for each quote and writer.
    """
    chunk = F.floor(F.col("turn") / CHUNK_TURNS).alias("chunk")
    marks = quotes.select("conv_id", "h", "turn", chunk, F.lit(None).cast("long").alias("wrote")).distinct().unionAll(written.select("conv_id", "h", "turn", chunk, F.col("turn").alias("wrote")))
    before = Window.partitionBy("conv_id", "h", "chunk").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = marks.withColumn("near", F.max("wrote").over(before)).filter("wrote is null")
    earlier = Window.partitionBy("conv_id", "h").orderBy("chunk").rangeBetween(Window.unboundedPreceding, -1)
    chunks = marks.groupBy("conv_id", "h", "chunk").agg(F.max("wrote").alias("last")).withColumn("far", F.max("last").over(earlier))
    found = near.join(chunks, ["conv_id", "h", "chunk"]).select("conv_id", "h", "turn", F.coalesce("near", "far").alias("parent")).filter("parent is not null")
    return quotes.join(found, ["conv_id", "h", "turn"])


def quote_links(found: DataFrame) -> DataFrame:
    """(conv_id, turn, level, parent, n): for each quote level of a message the earlier message that wrote most of it."""
    quotes = checkpointed(quoted_runs(found))
    met = latest_writers(quotes, written_runs(found, quotes))
    votes = met.groupBy("conv_id", "turn", "level", "parent").agg(F.sum("size").alias("n"))
    best = votes.groupBy("conv_id", "turn", "level").agg(F.max(F.struct("n", "parent")).alias("best"))
    return best.select("conv_id", "turn", "level", "best.parent", "best.n")


def reply_links(found: DataFrame) -> DataFrame:
    """(conv_id, turn, parent): the message that a message replies to."""
    return quote_links(found).groupBy("conv_id", "turn").agg(F.min(F.struct("level", "parent"))["parent"].alias("parent"))


def thread_roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, root): the first message of each linked message's thread, by pointer doubling."""
    roots = checkpointed(links.withColumn("root", F.col("parent")))
    while True:
        above = roots.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("higher"))
        moved = checkpointed(roots.join(above, ["conv_id", "root"], "left").select("conv_id", "turn", "parent", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
        roots = moved.drop("moved")
        if not moved.filter("moved").limit(1).count():
            return roots


def format_message(role: Column, text: Column) -> Column:
    """``<|role|>``, the text and an end mark; such marks inside a text are broken up."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("\n<|end|>\n"))


def linked_messages(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text (without quotes), parent (null: none) and root of each distinct message.

    Repeated rows count once; messages that share a turn are ordered by role and text. A null text is empty, a null role
    ``unknown``. Messages of a null conversation or with a null turn link to nothing. A quote whose original is not in
    the conversation links to nothing, and is left out of the text all the same; where no original of the lowest level
    is found, a deeper one gives the parent. Very long texts are handled as any other.
    """
    found = messages(conversations, conv_col, turn_col, role_col, text_col)
    roots = thread_roots(reply_links(found))
    joined = found.join(roots, ["conv_id", "turn"], "left")
    return joined.select("conv_id", "turn", "role", "text", "parent", F.coalesce("root", "turn").alias("root"))


def format_conversations(conversations: DataFrame, part_messages: int = PART_MESSAGES, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, part (from 0), n_messages, n_linked and text: the formatted messages of a part in reply order.

    Messages without words of their own are left out; a conversation of only such messages gives no row, nor does an
    empty table.
    """
    linked = linked_messages(conversations, conv_col, turn_col, role_col, text_col).filter(F.trim("text") != "")
    order = ["conv_id", "root", "turn", "role", "text"]
    # A place for each message by a range-partitioned sort; a window by conversation would put a large one in one task.
    placed = Dataset(linked).zip_with_index(order_by=order, name="at").df
    begins = placed.groupBy("conv_id").agg(F.min("at").alias("begin")).withColumnRenamed("conv_id", "c")
    parts = placed.join(begins, F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("part", F.floor((F.col("at") - F.col("begin")) / part_messages))
    one = F.struct("at", format_message(F.col("role"), F.col("text")).alias("text"))
    grouped = parts.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n_messages"), F.count("parent").alias("n_linked"), F.array_sort(F.collect_list(one)).alias("all"))
    return grouped.select("conv_id", "part", "n_messages", "n_linked", F.array_join(F.transform("all", lambda x: x["text"]), "").alias("text"))
