r"""Quality rules with DataFrame functions only: signals of each text, and cross-document line frequency.

A line that has a word is normalised (lower case, white space runs as one space, trimmed) and hashed. A
line's frequency within a host is the number of distinct documents of the host that hold it; exact copies of
a document count as one. A line in more than ``max(min_docs, share * documents of the host)`` of them is
boilerplate: it is removed, and a document that keeps less than ``keep_share`` of its lines' characters is
depleted and rejected, as is one that fails the base rules. With ``keep_first`` a boilerplate line stays in
one of the host's texts that hold it, that of the least text hash. Of a group of near copies, whose shared
lines are all frequent, the text of the least hash so keeps its lines but those that stay in a text outside
the group; without it the whole group goes.

Counts are summed map-side, so a line or a host that a third of all rows have spreads over all tasks; no
group is gathered. Signals are written once as a light table (hashes, not texts) that later steps read.

Edge cases: a null text has no words and fails; a null host is the host ''; a repeated row gets the verdict
of its twin; a document without lines is judged by the base rules alone; columns of any name ride along in
``doc``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Windows are first compared by a hash beside their position; longer texts are compared in full at once.
POSITION_BITS = 20


def normalised_line(line: Column) -> Column:
    # Most lines have single spaces only, which a search for plain strings tells faster than the expression.
    spaced = line.contains("  ")
    for c in SPACES[1:]:
        spaced = spaced | line.contains(c)
    return F.lower(F.trim(F.when(spaced, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line)))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(normalised_line(line))


def _repeats(words: Column, windows: Column) -> Column:
    """Of candidate window positions those whose three words occur at another one too, ascending."""
    full = F.transform(windows, lambda p: F.struct(F.concat_ws(" ", F.slice(words, p + 1, 3)).alias("w"), p.alias("p")))
    return F.sort_array(full)


def _with_neighbour(items: Column, same) -> Column:
    """Elements of a sorted array that equal the one before or after them."""
    last = F.size(items) - 1
    return F.filter(items, lambda x, i: ((i > 0) & same(x, items[F.greatest(i - 1, F.lit(0))])) | ((i < last) & same(x, items[F.least(i + 1, last)])))


def with_signals(df: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines (array of h, chars)."""
    bits = POSITION_BITS
    out = df.withColumn("t", F.coalesce(text, F.lit("")))
    out = out.select(*keep, "t", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("words"), F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("held"))
    at = lambda i: F.xxhash64(F.col("words")[i], F.col("words")[i + 1], F.col("words")[i + 2])
    coded = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.shiftleft(F.shiftright(at(i), bits), bits).bitwiseOR(i.cast("long")))
    some = F.size("words") >= 3
    short = F.size("words") <= (1 << bits)
    none = F.expr("cast(array() as array<bigint>)")
    out = out.select(
        *keep,
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("held") - F.size(F.array_distinct("held"))).cast("long").alias("n_dup_lines"),
        F.transform("held", lambda x: F.struct(_line_hash(x).alias("h"), F.char_length(x).alias("chars"))).alias("lines"),
        "words",
        F.when(some & short, F.sort_array(coded)).otherwise(none).alias("coded"),
    )
    kept = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "lines", "words"]
    near = _with_neighbour(F.col("coded"), lambda a, b: F.shiftright(a, bits) == F.shiftright(b, bits))
    mask = (1 << bits) - 1
    all_positions = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: i.cast("long"))
    out = out.select(*kept, F.when(some & ~short, all_positions).otherwise(F.transform(near, lambda x: x.bitwiseAND(F.lit(mask).cast("long")))).alias("cand"))
    out = out.select(*kept, _repeats(F.col("words"), F.transform("cand", lambda x: x.cast("int"))).alias("cand"))
    out = out.select(*kept[:-1], F.sort_array(F.transform(_with_neighbour(F.col("cand"), lambda a, b: a["w"] == b["w"]), lambda x: x["p"])).alias("pos"))
    covered = F.aggregate(
        "pos",
        F.expr("struct(0 as sum, -3 as last)"),
        lambda s, p: F.struct((s["sum"] + F.least(F.lit(3), p - s["last"])).alias("sum"), p.alias("last")),
        lambda s: s["sum"],
    )
    return out.select(*kept[:-1], covered.cast("long").alias("n_repeat_words"))


def judge(spark: SparkSession, docs: DataFrame, carry: list[str], text: str = "text", host: str = "source", min_docs: int = 20, share: float = 0.02, keep_share: float = 0.3, min_words: int = 50, keep_first: bool = False) -> DataFrame:
    """One row per document: doc (struct of the columns ``carry``), signals, removed (hashes of boilerplate
    lines it holds), line_chars, left_chars, base_failed, kept."""
    scratch = Scratch(spark, "quality")
    q = lambda c: F.col(f"`{c}`")
    shaped = docs.select(
        F.struct(*[q(c) for c in carry]).alias("doc"), F.coalesce(q(host).cast("string"), F.lit("")).alias("host"),
        F.struct(F.xxhash64(q(text)), F.md5(q(text))).alias("same"), q(text).alias("raw"), F.monotonically_increasing_id().alias("row"),
    )
    table = scratch.keep(with_signals(shaped, F.col("raw"), ["row", "doc", "host", "same"]), "signals")
    distinct_lines = table.select("host", "same", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).distinct()
    limits = table.select("host", "same").distinct().groupBy("host").agg(F.greatest(F.lit(min_docs), F.floor(F.count("*") * F.lit(share))).alias("limit"))
    # Twins have one text hash, so they keep the same lines.
    first = [F.min("same.col1").alias("first")] if keep_first else []
    frequent = distinct_lines.groupBy("host", "h").agg(F.count("*").alias("n"), *first).where(F.col("n") > min_docs).join(limits, "host").where("n > limit").drop("n", "limit")
    mark = [F.col("same.col1").alias("text_hash")] if keep_first else []
    held = table.select("row", "host", *mark, F.explode("lines").alias("x")).select("row", "host", *(["text_hash"] if keep_first else []), "x.h", "x.chars")
    cut = held.join(frequent, ["host", "h"])
    removed = (cut.where("text_hash <> first") if keep_first else cut).groupBy("row").agg(F.sum("chars").alias("gone"), F.collect_set("h").alias("removed"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x["chars"])
    out = table.withColumn("line_chars", total).drop("lines", "same").join(removed, "row", "left")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("line_chars") - F.coalesce("gone", F.lit(0))
    return out.select(
        "doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed", "line_chars", left.alias("left_chars"),
        base.alias("base_failed"), (~base & (left >= keep_share * F.col("line_chars"))).alias("kept"),
    )


def without_lines(text: Column, removed: Column) -> Column:
    """``text`` without the lines whose hashes are in ``removed`` (null: none)."""
    left = F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(WORD) & F.array_contains(removed, _line_hash(x))))
    return F.when(removed.isNull(), text).otherwise(F.array_join(left, "\n"))


def clean(spark: SparkSession, docs: DataFrame, text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The documents that stay, their boilerplate lines removed; columns as they came, n_chars counted anew."""
    names = docs.columns
    scratch = Scratch(spark, "quality")
    q = lambda c: F.col(f"doc.`{c}`")
    stored = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc")), "docs", "zstd")
    judged = judge(spark, stored.select("row", q(text).alias("text"), q(host).alias("host")), ["row"], "text", "host", **limits)
    # Most documents stay as they are, so only the light verdicts of the others are joined.
    changed = scratch.keep(judged.where("not kept or removed is not null").select("doc.row", "kept", "removed"), "changed")
    out = stored.join(changed, "row", "left").where(F.coalesce("kept", F.lit(True)))
    new = without_lines(q(text), F.col("removed"))
    out = out.select(*[new.alias(c) if c == text else q(c).alias(c) for c in names])
    return out.withColumn("n_chars", F.char_length(f"`{text}`").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
