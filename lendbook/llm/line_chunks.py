"""Repeated passages removed by content-defined chunks of lines.

A document is a sequence of lines. A hash rolls over the hashes of neighbouring lines, and a chunk
ends where it is smaller than before and not greater than after. Boundaries thus depend on the
lines around them and not on where in a document they stand: the same passage is cut the same way
wherever it was pasted, and no two boundaries are neighbours. A very long line is a passage by
itself and ends the chunks before and after it. Chunks of several lines, or one such long line,
that occur more than once in all documents are kept where they come first and removed elsewhere,
after their bytes have been compared with the kept ones.

The first and the last chunk of a pasted passage take in lines of the text around it, and a passage
of few lines may hold no boundary at all. So the pairs of neighbouring lines are counted as well: a
line is covered if it is in a chunk that goes or in a pair that stood before, and an unbroken
stretch of covered lines goes if it has ``MIN_WORDS`` words. This takes what is left of a passage
on both sides of its chunks, and passages without a whole chunk. Every line that goes has an equal
one that stays, at an earlier place.

Only DataFrame functions are used. Texts are cut into chunks once, to write the digests of chunks
and pairs with their places; digests are counted, and the places of those that repeat are written
again. Whole texts are shuffled once, to meet these places, and written. From there the texts of
repeated chunks and pairs alone meet the ones that are kept; what differs from them, though its
digest does not, stays. Pairs inside of chunks that go are not compared again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendbook.llm.common import cut_lineage

BASE = 31                   # of the hash that rolls over two lines
#: Code points from which a line is a passage by itself; fifty words are about 300.
LONG_LINE = 200
MIN_LINES = 2
#: Words of a stretch of repeated lines that goes though it is not made of whole chunks.
MIN_WORDS = 50
_BLANK = " \t\n\x0b\x0c\r"


def _line_hash(digest: Column) -> Column:
    """The first 32 bits of a line's digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _rolled(hashes: Column) -> Column:
    """The hash of every line and the one before it."""
    return F.transform(hashes, lambda own, at: F.coalesce(
        F.get(hashes, at - 1), F.lit(0)) * BASE + own)


def _ends_after(lengths: Column, rolled: Column, at: Column) -> Column:
    """Whether a chunk ends after line ``at`` (from 0); there is a line after it."""
    own, before, after = rolled[at], F.get(rolled, at - 1), rolled[at + 1]
    return F.coalesce((own < before) & (own <= after), F.lit(False)) | (
        lengths[at] >= LONG_LINE) | (lengths[at + 1] >= LONG_LINE)


def with_chunks(docs: DataFrame, text_col: str, into: str = "_chunks") -> DataFrame:
    """Add the chunks of a text: array of (start, n_lines), lines counted from 0.

    Null texts have no chunks. The lines, their digests and their lengths come along as ``_lines``,
    ``_digests`` and ``_lengths``. What is asked of every line is computed once.
    """
    split = docs.withColumn("_lines", F.split(F.col(text_col), "\n"))
    hashed = split.withColumn("_digests", F.transform("_lines", F.md5)).withColumn(
        "_lengths", F.transform("_lines", F.length)).withColumn(
        "_hashes", F.transform("_digests", _line_hash)).withColumn(
        "_rolled", _rolled(F.col("_hashes")))
    lengths, rolled = F.col("_lengths"), F.col("_rolled")
    starts = hashed.withColumn("_starts", F.filter(
        F.sequence(F.lit(0), F.size(lengths) - 1),
        lambda at: (at == 0) | _ends_after(lengths, rolled, at - 1)))
    chunk = F.transform("_starts", lambda start, place: F.struct(
        start.alias("start"), (F.coalesce(F.get(F.col("_starts"), place + 1), F.size(lengths))
                               - start).alias("n_lines")))
    return starts.withColumn(into, chunk).drop("_hashes", "_rolled", "_starts")


def _of(values: str, chunk: Column) -> Column:
    """The part of an array by line that belongs to a chunk."""
    return F.slice(F.col(values), chunk["start"] + 1, chunk["n_lines"])


def _chunk_units() -> Column:
    """(pair, at, n_lines, key) of the chunks, ``at`` being the first line; no key where a chunk is
    too little to be removed."""
    def unit(chunk: Column) -> Column:
        filled = F.size(F.filter(_of("_filled", chunk), lambda line: line))
        length = F.aggregate(_of("_lengths", chunk), chunk["n_lines"] - 1,
                             lambda total, own: total + own)
        counts = F.when(filled >= MIN_LINES, True).otherwise(
            (filled > 0) & (length >= LONG_LINE))
        key = F.unhex(F.md5(F.array_join(_of("_digests", chunk), "\n")))
        return F.struct(F.lit(False).alias("pair"), chunk["start"].alias("at"),
                        chunk["n_lines"].alias("n_lines"), F.when(counts, key).alias("key"))

    return F.transform("_chunks", unit)


def _pair_units() -> Column:
    """(pair, at, n_lines, key) of every line and the next one, ``at`` being the first line.

    No key where both are long, as these are chunks of their own, or where both are blank.
    """
    lengths, filled = F.col("_lengths"), F.col("_filled")

    def unit(digest: Column, at: Column) -> Column:
        after = F.get(F.col("_digests"), at + 1)
        counts = after.isNotNull() & (
            (F.get(lengths, at) < LONG_LINE) | (F.get(lengths, at + 1) < LONG_LINE)) & (
            F.get(filled, at) | F.get(filled, at + 1))
        return F.struct(F.lit(True).alias("pair"), at.alias("at"), F.lit(2).alias("n_lines"),
                        F.when(counts, F.unhex(F.md5(F.concat(digest, after)))).alias("key"))

    return F.transform("_digests", unit)


def _row_key(doc_id: Column, text: Column) -> Column:
    """A key of the row that is never null and that only rows equal in id and text share."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")),
                                     text)))


def occurrences(docs: DataFrame) -> DataFrame:
    """What may be removed of (doc_id, _id, text): both ids, whether a pair of lines or a chunk,
    its first line (from 0), how many lines it has, and its digest."""
    # The outer form: for the other, the optimizer would compute the chunks once more in a filter
    # on the scan, with every step of theirs inside the loops of the next.
    # A line is blank if nothing is left of it from the left: only its first characters are read.
    chunks = with_chunks(docs, "text").withColumn("_filled", F.transform(
        "_lines", lambda line: F.ltrim(line, F.lit(_BLANK)) != ""))
    return chunks.select("doc_id", "_id", F.explode_outer(F.concat(
        _chunk_units(), _pair_units())).alias("unit")).select("doc_id", "_id", "unit.*").where(
        "key IS NOT NULL")


def remove_repeated(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, the text without repeated passages, and what was removed; one row per row.

    A passage stays in the document with the smallest id, where it comes first. Null texts stay
    null and have no lines. Rows equal in id and text are one document; of other rows with equal
    ids, as of those with null ids, which are smaller than all others, the one with the smaller
    digest of its text comes first. A text of which everything is removed becomes empty. Other
    columns are not read; an empty table gives an empty result. Two neighbouring blank lines are
    no pair, so three blank lines or more end a stretch.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rewrite(texts).select("doc_id", "text", *COUNTS)


#: Counts that ``rewrite`` adds: lines of the text, chunks removed whole, lines removed in all.
COUNTS = ("n_lines", "n_chunks_removed", "n_lines_removed")


def rewrite(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any others) with the text of ``remove_repeated`` in place.

    Columns are named as in ``COUNTS`` besides; they replace any of that name.
    """
    rows = docs.withColumn("_id", _row_key(F.col("doc_id"), F.col("text")))
    seen = cut_lineage(occurrences(rows.select("doc_id", "_id", "text")))
    # Counted apart from the first places: a count fits a hash aggregate, a place takes a sort.
    often = cut_lineage(seen.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(
        "n > 1").select("key"))
    units = cut_lineage(seen.join(often, "key"))
    place = F.struct("doc_id", "_id", "pair", "at")
    repeated = units.groupBy("key").agg(
        F.min(place).alias("first"), F.max(place).alias("_last")).where(
        "first < _last").select("key", "first")
    marks = units.join(repeated, "key").groupBy("_id").agg(F.collect_set(F.struct(
        "pair", "at", "n_lines", (place == F.col("first")).alias("stays"), "key")).alias("_marks"))
    held = cut_lineage(rows.join(marks, "_id", "left"))
    other = _differing(held)
    if other.isEmpty():
        held = held.withColumn("_other", F.array().cast(
            "array<struct<pair:boolean,at:int,n_lines:int>>"))
    else:
        held = held.join(other.groupBy("_id").agg(F.collect_set(
            F.struct("pair", "at", "n_lines")).alias("_other")), "_id", "left")
    marked = held.withColumn("_marked", F.when(F.col("_marks").isNotNull(), F.col("text")))
    return _without(marked.withColumn("_lines", F.split("_marked", "\n"))).select(
        *[c for c in docs.columns if c not in COUNTS], *COUNTS)


def _chosen(marks: str, pair: bool) -> Column:
    """(at, n_lines) of the chunks, or pairs, among marks that do not stay; none without marks."""
    return F.coalesce(F.transform(F.filter(marks, lambda mark: (
        mark["pair"] == pair) & ~(mark["stays"] if marks == "_marks" else F.lit(False))),
        lambda mark: F.struct(mark["at"].alias("at"), mark["n_lines"].alias("n_lines"))),
        F.array().cast("array<struct<at:int,n_lines:int>>"))


def _lines_of(units: str) -> Column:
    """Numbers of the lines in chunks or pairs."""
    return F.flatten(F.transform(units, lambda unit: F.sequence(
        unit["at"], unit["at"] + unit["n_lines"] - 1)))


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Add ``_later``, the chunks that stood before, and ``_inside``, the pairs within them."""
    claimed = rows.withColumn("_later", _chosen("_marks", False)).withColumn(
        "_claimed", _lines_of("_later"))
    return claimed.withColumn("_inside", F.array_intersect(
        "_claimed", F.transform("_claimed", lambda at: at - 1))).drop("_claimed")


def _differing(held: DataFrame) -> DataFrame:
    """(_id, pair, at, n_lines) of chunks and pairs whose bytes are not those that are kept by
    their digest."""
    marked = _with_repeats(held.where("_marks IS NOT NULL").select(
        "_id", "_marks", F.split("text", "\n").alias("_lines")))

    def compared(mark: Column) -> Column:
        text = F.array_join(F.slice(F.col("_lines"), mark["at"] + 1, mark["n_lines"]), "\n")
        return F.struct(*[mark[name].alias(name) for name in (
            "pair", "at", "n_lines", "stays", "key")], text.alias("unit_text"))

    # ``_inside`` as a value of the outer step: as a column it would be computed for every mark.
    needed = F.flatten(F.transform(F.array("_inside"), lambda inside: F.filter(
        "_marks", lambda mark: ~mark["pair"] | mark["stays"] | ~F.array_contains(
            inside, mark["at"]))))
    texts = marked.select("_id", F.explode_outer(F.transform(needed, compared)).alias("u")).select(
        "_id", "u.*")
    kept = texts.where("stays").groupBy("key").agg(F.min("unit_text").alias("kept_text"))
    return cut_lineage(texts.where("NOT stays").join(kept, "key").where(
        "unit_text <> kept_text").select("_id", "pair", "at", "n_lines").distinct())


def _stretches(numbers: str) -> Column:
    """(first, last) of the unbroken stretches of sorted, distinct numbers."""
    every = F.col(numbers)
    firsts = F.filter(every, lambda own, at: ~F.coalesce(
        F.get(every, at - 1) == own - 1, F.lit(False)))
    lasts = F.filter(every, lambda own, at: ~F.coalesce(
        F.get(every, at + 1) == own + 1, F.lit(False)))
    return F.zip_with(firsts, lasts, lambda first, last: F.struct(
        first.alias("first"), last.alias("last")))


def _without(rows: DataFrame) -> DataFrame:
    """Marked chunks that do not stay or differ leave the text, and long stretches of lines.

    Texts without marks, which have no lines here, pass as they are.
    """
    lines = F.col("_lines")

    def words(stretch: Column) -> Column:
        within = F.slice(lines, stretch["first"] + 1, stretch["last"] - stretch["first"] + 1)
        return F.size(F.filter(F.split(F.array_join(within, " "), r"[\x20\x09-\x0D]+"),
                               lambda word: word != ""))

    found = _with_repeats(rows).withColumn(
        "_gone_chunks", F.array_except("_later", _chosen("_other", False))).withColumn(
        "_in_chunks", _lines_of("_gone_chunks")).withColumn(
        "_pairs", F.array_except(F.array_except(_chosen("_marks", True), F.transform(
            "_inside", lambda at: F.struct(at.alias("at"), F.lit(2).alias("n_lines")))),
            _chosen("_other", True)))
    covered = found.withColumn("_covered", F.sort_array(F.array_union(
        "_in_chunks", _lines_of("_pairs"))))
    gone = covered.withColumn("_wordy", F.filter(
        _stretches("_covered"), lambda stretch: words(stretch) >= MIN_WORDS)).withColumn(
        "_gone", F.sort_array(F.array_union("_in_chunks", F.flatten(F.transform(
            "_wordy", lambda stretch: F.sequence(stretch["first"], stretch["last"])))))).withColumn(
        "_gaps", _stretches("_gone"))
    # What stays lies between the stretches that go.
    staying = F.flatten(F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform("_gaps", lambda gap: gap["last"] + 1)),
        F.concat(F.transform("_gaps", lambda gap: gap["first"]), F.array(F.size(lines))),
        lambda start, end: F.slice(lines, start + 1, end - start)))
    is_marked = F.col("_marked").isNotNull()
    newlines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    # Through a generated row, so that a filter on the result stays above it. Else the optimizer
    # would compute the text again in a filter on the scan, with every step inside the next.
    result = F.explode_outer(F.array(F.struct(
        F.when(is_marked, F.array_join(staying, "\n")).otherwise(F.col("text")).alias("text"),
        F.coalesce(newlines + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.when(is_marked, F.size("_gone_chunks")).otherwise(0).cast("long").alias(
            "n_chunks_removed"),
        F.when(is_marked, F.size("_gone")).otherwise(0).cast("long").alias("n_lines_removed"))))
    names = [c for c in rows.columns if c not in ("text", *COUNTS)]
    return gone.select(*names, result.alias("_result")).select(*names, "_result.*")
