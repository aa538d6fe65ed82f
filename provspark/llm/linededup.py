"""Line dedup by content-defined chunks of lines; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.llm.common import WORD, materialize

#: One boundary in so many lines, before runs of boundaries are thinned; words that make a line a stretch of its own.
MODULUS, LONG_WORDS = 3, 50
_NO_ID = -(2**63)


def _once(value: Column, of) -> Column:
    """``of(value)``, with ``value`` made once for each row."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _boundary(k: Column, modulus: int) -> Column:
    """Whether a chunk starts at the ``k``-th line with words of the array ``w``.

    The rolling hash of the two lines before says so, unless it says so for the line before as well: a chunk has
    two lines at least, and where chunks start follows from three lines, wherever the passage stands.
    """
    rolled = lambda i: ((F.get("w", i - 1)["h"] % 1000003) * 31 + F.get("w", i - 2)["h"] % 1000003) % modulus == 0
    return (k == 0) | ((k > 1) & rolled(k) & ((k < 3) | ~rolled(k - 1)))


def _spans(modulus: int) -> Column:
    """Chunks and stretches of the lines with words ``w(pos, h, long)``, as (start, lines); ``hs`` has the hashes of all lines.

    A stretch is a long line, or a line and the next one; it carries chunks on to both sides and stands for runs too
    short for a chunk. Blank lines inside a span belong to it.
    """
    key = lambda start, lines, kind: F.xxhash64(F.slice("hs", start + 1, lines), F.lit(kind))

    def span(start: Column, end: Column, kind: str) -> Column:
        lines = end - start + 1
        return F.when(end.isNotNull(), F.struct(start.alias("start"), lines.alias("lines"), key(start, lines, kind).alias("ck")))

    def chunks(starts: Column) -> Column:
        def chunk(a: Column, k: Column) -> Column:
            last = F.coalesce(F.get(starts, k + 1), F.size("w")) - 1
            return F.when(last - a >= 2, span(F.get("w", a)["pos"], F.get("w", last)["pos"], "chunk"))

        return F.transform(starts, chunk)

    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0))), lambda k: _boundary(k, modulus))
    pairs = F.transform("w", lambda x, k: span(x["pos"], F.get("w", k + 1)["pos"], "pair"))
    longs = F.transform(F.filter("w", lambda x: x["long"]), lambda x: span(x["pos"], x["pos"], "long"))
    return F.filter(F.concat(_once(starts, chunks), pairs, longs), lambda s: s.isNotNull())


def _keyed(docs: DataFrame) -> DataFrame:
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_id"), F.col("text").cast("string").alias("text"))
    return plain.select("_id", F.xxhash64("text").alias("_th"), "text").where("text is not null")


def spans(docs: DataFrame, modulus: int = MODULUS, long_words: int = LONG_WORDS) -> DataFrame:
    """``(_id, _th, start, lines, ck)``: each document's content-defined chunks of three lines or more, and its stretches.

    What a document gives follows from its own lines alone. ck hashes the hashes of the span's lines.
    """
    long = lambda x: F.coalesce((F.length(x) >= 2 * long_words - 1) & (F.regexp_count(x, F.lit(WORD)) >= long_words), F.lit(False))
    line = lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("h"), x.rlike(WORD).alias("solid"), long(x).alias("long"))
    split = _keyed(docs).select("_id", "_th", F.transform(F.split("text", "\n", -1), line).alias("l"))
    shaped = split.select("_id", "_th", F.transform("l", lambda x: x["h"]).alias("hs"), F.filter("l", lambda x: x["solid"]).alias("w"))
    return shaped.select("_id", "_th", F.explode(_spans(modulus)).alias("c")).select("_id", "_th", "c.*")


def _lines_at(split: Column, start: Column, lines: Column) -> Column:
    return F.array_join(F.slice(split, start + 1, lines), "\n")


def _merged(pairs: DataFrame) -> DataFrame:
    """Of ``(_id, _th, start, lines, keep)``, spans that touch or overlap and have the same shift to the same earlier text, as one."""
    group = ["_id", "_th", "kid", "kth", "shift"]
    order = Window.partitionBy(*group).orderBy("start")
    flat = pairs.select("_id", "_th", F.col("keep._id").alias("kid"), F.col("keep._th").alias("kth"), (F.col("start") - F.col("keep.start")).alias("shift"), "start", (F.col("start") + F.col("lines")).alias("end"))
    flat = flat.withColumn("before", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    flat = flat.withColumn("part", F.sum(F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = flat.groupBy(*group, "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumn("lines", F.col("end") - F.col("start"))
    keep = F.struct(F.col("kid").alias("_id"), F.col("kth").alias("_th"), (F.col("start") - F.col("shift")).alias("start"), "lines")
    return whole.select("_id", "_th", "start", "lines", keep.alias("keep"))


def repeats(docs: DataFrame, modulus: int = MODULUS, long_words: int = LONG_WORDS) -> DataFrame:
    """``(_id, _th, rm)``: for each document, the runs of lines an earlier place of the corpus has, with that place's bytes."""
    found = materialize(spans(docs, modulus, long_words), "line-spans")
    place = F.struct("_id", "_th", "start", "lines")
    kept = found.groupBy("ck").agg(F.count("*").alias("n"), F.min(place).alias("keep")).where("n > 1").drop("n")
    kept = materialize(kept, "line-keepers")  # a table, so that AQE can split the join at a span that very many documents have
    own = (F.col("_id") == F.col("keep._id")) & (F.col("_th") == F.col("keep._th")) & (F.col("start") < F.col("keep.start") + F.col("keep.lines"))
    runs = _merged(found.join(kept, "ck").where((place != F.col("keep")) & ~own)).withColumn("ck", F.xxhash64("keep"))
    runs = materialize(runs.withColumnRenamed("keep", "at"), "line-runs")
    kept = runs.select("ck", F.col("at").alias("keep")).distinct()
    by_doc = kept.groupBy(F.col("keep._id").alias("_id"), F.col("keep._th").alias("_th")).agg(F.collect_list(F.struct("ck", "keep")).alias("ks"))
    # both sides of this join, and of the last one, grow with the corpus: neither is broadcast
    bytes_at = lambda split: F.transform("ks", lambda k: F.struct(k["ck"].alias("ck"), k["keep"].alias("keep"), _lines_at(split, k["keep"]["start"], k["keep"]["lines"]).alias("bytes")))
    first = _keyed(docs).join(by_doc.hint("merge"), ["_id", "_th"]).select(F.explode(_once(F.split("text", "\n", -1), bytes_at)).alias("k")).select("k.*")
    # one join on the run, each side an exchange of its own, so that AQE can split a run that very many documents have
    pairs = runs.join(first, "ck").where("at = keep").select("_id", "_th", F.struct("start", "lines", "bytes").alias("r"))
    return pairs.groupBy("_id", "_th").agg(F.collect_set("r").alias("rm"))


def without_repeats(docs: DataFrame, modulus: int = MODULUS, long_words: int = LONG_WORDS, counted: bool = False) -> DataFrame:
    """``docs`` with every run of lines removed that an earlier place has, byte for byte; n_chars, if there, is renewed.

    A run is two lines with words that follow each other, blank lines between them included, or one line of
    ``long_words`` words, or any longer run made of these. Content-defined chunks find the long ones, and stretches
    of two lines carry them on to both sides, so what is removed does not depend on where chunks are cut. The
    earliest place is that of the smallest doc_id (nulls first), text hash and line; it stays, so each line's first
    copy stays, and a run that reaches into its own first place stays too. All rows stay: a text that loses every
    line is empty; null and empty texts are unchanged. Repeated rows (equal id and text) are one document and are
    treated alike. ``counted`` adds ``removed_lines``. Extra columns pass through, whatever their names.
    """
    names = docs.columns
    row = F.struct(*(F.col(f"`{n}`") for n in names)).alias("_row")
    own = docs.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_th"))
    joined = own.join(repeats(docs, modulus, long_words).hint("merge"), ["_id", "_th"], "left")

    def cut(split: Column) -> Column:
        equal = F.filter("rm", lambda r: _lines_at(split, r["start"], r["lines"]) == r["bytes"])
        gone = F.array_distinct(F.flatten(F.transform(equal, lambda r: F.sequence(r["start"], r["start"] + r["lines"] - 1))))

        def rest(gone: Column) -> Column:
            left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone)
            return F.struct(F.size(gone).cast("long").alias("gone"), F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n").alias("text"))

        return _once(gone, rest)

    joined = joined.select("_row", F.when(F.col("rm").isNotNull(), _once(F.split(F.col("_row.text").cast("string"), "\n", -1), cut)).alias("_new"))
    changed, text = F.coalesce(F.col("_new.gone") > 0, F.lit(False)), F.col("_new.text")
    renewed = {"text": text, "n_chars": F.length(text).cast("long")}
    out = [(F.when(changed, renewed[n]).otherwise(F.col("_row")[n]) if n in renewed else F.col("_row")[n]).alias(n) for n in names]
    return joined.select(*out, *([F.coalesce("_new.gone", F.lit(0)).cast("long").alias("removed_lines")] if counted else []))
