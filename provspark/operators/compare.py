"""Comparison of recomputed and recorded results: rules, rows, artifacts, environments, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdicts from the least to the most severe.
VERDICTS = ("exact", "within_tolerance", "not_verified", "different")


def severity(verdict: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), verdict)


def applied_rule(rule: Column, named: Column, environment: Column, same_environment: Column, atol: Column, rtol: Column) -> Column:
    """``exact`` or ``tolerance`` for one output role.

    Exact if there is no rule, it is exact, it does not name the role, or the environment is the same and the
    rule asks for exactness there; an unknown environment keeps the tolerance. Null where the limits are not
    both zero or more, NaN included.
    """
    exact = rule.isNull() | (rule == "exact") | ~F.coalesce(named, F.lit(False)) | F.coalesce((environment == "same") & (same_environment == "exact"), F.lit(False))
    sound = F.coalesce((atol >= 0) & (rtol >= 0) & ~F.isnan(atol) & ~F.isnan(rtol), F.lit(False))
    return F.when(exact, "exact").when(sound, "tolerance")


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def differences(pairs: DataFrame, keys: Sequence[str], ref: str = "ref", cand: str = "cand", atol: Column | float = 0.0, rtol: Column | float = 0.0) -> DataFrame:
    """Per group: n, mismatches, out_of_tolerance, undefined_abs, undefined_rel, max_abs and max_rel.

    NaN equals NaN and -0 equals 0. A mismatch is in tolerance if its error is finite and at most
    atol + rtol * |ref|. A maximum is null if some mismatch has no finite error of its kind, 0 without mismatch.
    One aggregate, with map-side combine.
    """
    a, b = F.col(ref).cast("double"), F.col(cand).cast("double")
    error = F.abs(b - a)
    relative = F.try_divide(error, F.abs(a))
    limit = (F.lit(atol) if isinstance(atol, float) else atol) + (F.lit(rtol) if isinstance(rtol, float) else rtol) * F.abs(a)
    marked = pairs.withColumn("_off", ~a.eqNullSafe(b)).withColumn("_abs", error).withColumn("_rel", relative).withColumn("_limit", limit)
    off, good_abs = F.col("_off"), F.coalesce(finite(F.col("_abs")), F.lit(False))
    good_rel = F.coalesce(finite(F.col("_rel")), F.lit(False))
    return _finished(
        marked.groupBy(*keys).agg(
            F.count("*").alias("n"),
            F.count_if(off).alias("mismatches"),
            F.count_if(off & ~(good_abs & (F.col("_abs") <= F.col("_limit")))).alias("out_of_tolerance"),
            F.count_if(off & ~good_abs).alias("undefined_abs"),
            F.count_if(off & ~good_rel).alias("undefined_rel"),
            F.max(F.when(off & good_abs, F.col("_abs"))).alias("max_abs"),
            F.max(F.when(off & good_rel, F.col("_rel"))).alias("max_rel"),
        )
    )


def _finished(found: DataFrame) -> DataFrame:
    out = found
    for kind in ("abs", "rel"):
        out = out.withColumn(f"max_{kind}", F.when(F.col(f"undefined_{kind}") > 0, None).otherwise(F.coalesce(f"max_{kind}", F.lit(0.0))))
    return out


def complex_pairs(pairs: DataFrame, ref: str = "ref", cand: str = "cand") -> DataFrame:
    """Complex values as struct(re, im): equality on both parts, errors by modulus, as ``differences`` columns.

    Adds ``_off``, ``_abs`` and ``_rel``.
    """
    re, im = F.col(f"{cand}.re") - F.col(f"{ref}.re"), F.col(f"{cand}.im") - F.col(f"{ref}.im")
    error = F.hypot(re, im)
    return (
        pairs.withColumn("_off", ~(F.col(f"{ref}.re").eqNullSafe(F.col(f"{cand}.re")) & F.col(f"{ref}.im").eqNullSafe(F.col(f"{cand}.im"))))
        .withColumn("_abs", error)
        .withColumn("_rel", F.try_divide(error, F.hypot(F.col(f"{ref}.re"), F.col(f"{ref}.im"))))
    )


def aligned(ref: DataFrame, cand: DataFrame, keys: Sequence[str], values: str) -> DataFrame:
    """Arrays of the same group and row name side by side: (keys, row, pos, ref, cand), one row an element.

    The arrays are zipped where they meet; only their groups are joined.
    """
    left = ref.select(*keys, "row", F.col(values).alias("_a"))
    right = cand.select(*keys, "row", F.col(values).alias("_b"))
    zipped = F.arrays_zip(F.col("_a").alias("ref"), F.col("_b").alias("cand"))
    return left.join(right, [*keys, "row"]).select(*keys, "row", F.posexplode(zipped).alias("pos", "_p")).select(*keys, "row", "pos", "_p.ref", "_p.cand")


def compared_rows(ref: DataFrame, cand: DataFrame, keys: Sequence[str], rule: Column, atol: float = 0.0, rtol: float = 0.0) -> DataFrame:
    """Verdict for each group of rows ``(keys, ord, row, dtype, values)``.

    Rows must come under the same names in the same order and sizes: else every element of the largest reference
    row counts as a mismatch and no error is defined. A differing dtype alone makes a group different. Under a
    tolerance rule, values in tolerance and of equal dtype are within_tolerance.
    """
    shape = lambda df, p: df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("ord", "row", F.size("values").alias("n")))).alias(f"{p}_shape"),
        F.sort_array(F.collect_list(F.struct("ord", "dtype"))).alias(f"{p}_types"),
        F.max(F.size("values")).alias(f"{p}_most"),
    )
    names = lambda p: F.transform(F.col(f"{p}_shape"), lambda x: F.struct(x["row"], x["n"]))
    types = lambda p: F.transform(F.col(f"{p}_types"), lambda x: x["dtype"])
    shapes = shape(ref, "r").join(shape(cand, "c"), list(keys))
    same = F.coalesce(names("r") == names("c"), F.lit(False))
    shapes = shapes.select(*keys, same.alias("shape_match"), F.coalesce(types("r") == types("c"), F.lit(False)).alias("dtype_match"), F.col("r_most").alias("most"))
    errors = differences(aligned(ref, cand, keys, "values"), keys, atol=atol, rtol=rtol)
    joined = shapes.join(errors, list(keys), "left")
    off = F.when(F.col("shape_match"), F.coalesce("mismatches", F.lit(0))).otherwise(F.col("most")).cast("long")
    tolerant = rule == "tolerance"
    verdict = (
        F.when(F.col("shape_match") & F.col("dtype_match") & (off == 0), "exact")
        .when(tolerant & F.col("shape_match") & F.col("dtype_match") & (F.coalesce("out_of_tolerance", F.lit(0)) == 0), "within_tolerance")
        .otherwise("different")
    )
    shown = lambda c: F.when(F.col("shape_match"), F.col(c))
    return joined.select(*keys, "shape_match", "dtype_match", off.alias("mismatches"), F.when(tolerant, shown("out_of_tolerance")).alias("out_of_tolerance"), *[shown(c).alias(c) for c in ("undefined_abs", "undefined_rel", "max_abs", "max_rel")], verdict.alias("verdict"))


def overall(outputs: DataFrame, keys: Sequence[str], verdict: str = "verdict", position: str = "position", compared: Column | None = None) -> DataFrame:
    """The most severe verdict of each group's outputs, ``not_verified`` without any, and the first compared position."""
    used = F.lit(True) if compared is None else compared
    found = outputs.groupBy(*keys).agg(F.max_by(verdict, severity(F.col(verdict))).alias("verdict"), F.min(F.when(used, F.col(position))).alias("first_compared"))
    return found.withColumn("verdict", F.coalesce("verdict", F.lit("not_verified")))


def flattened(record: str, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A string map column as rows ``(keys, item, value)``."""
    return df.select(*keys, F.explode_outer(record).alias("item", "value")).where("item is not null")


def environment_differences(recorded: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items of two flattened environments that differ: ``(keys, item, recorded, current)``, absent as null."""
    a = recorded.select(*keys, "item", F.col("value").alias("recorded"))
    b = current.select(*keys, "item", F.col("value").alias("current"))
    return a.join(b, [*keys, "item"], "full_outer").where(~F.col("recorded").eqNullSafe(F.col("current"))).select(*keys, "item", "recorded", "current")


def environment_match(recorded: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, match, differences)``: same, different, or unknown where either side has no record."""
    diff = environment_differences(recorded, current, keys).groupBy(*keys).agg(F.count("*").alias("differences"))
    sides = recorded.select(*keys).distinct().withColumn("_r", F.lit(True)).join(current.select(*keys).distinct().withColumn("_c", F.lit(True)), list(keys), "full_outer")
    n = F.coalesce("differences", F.lit(0))
    return sides.join(diff, list(keys), "left").select(*keys, F.when(F.col("_r").isNull() | F.col("_c").isNull(), "unknown").when(n == 0, "same").otherwise("different").alias("match"), n.cast("long").alias("differences"))


def table_columns(artifacts: DataFrame, keys: Sequence[str], names: str = "names", data: str = "data") -> DataFrame:
    """A table artifact, rows of text cells, as columns: (keys, ord, row, dtype, values, texts).

    A column whose filled cells are all numbers is numeric, its empty cells NaN; any other is text. Tables whose
    rows differ in width give no column.
    """
    cells = artifacts.where(F.size(F.array_distinct(F.transform(data, lambda r: F.size(r)))) <= 1)
    column = lambda i: F.transform(F.col(data), lambda r: F.get(r, i))
    listed = cells.select(*keys, F.posexplode(names).alias("ord", "row"), F.col(data)).withColumn("texts", column(F.col("ord")))
    numeric = F.forall("texts", lambda t: t.isNull() | t.try_cast("double").isNotNull()) & F.exists("texts", lambda t: t.isNotNull())
    values = F.transform("texts", lambda t: F.coalesce(t.try_cast("double"), F.lit(float("nan"))))
    return listed.withColumn("_numeric", numeric).select(*keys, "ord", "row", F.when(F.col("_numeric"), "float64").otherwise("text").alias("dtype"), F.when(F.col("_numeric"), values).alias("values"), "texts")


def compared_artifacts(ref: DataFrame, cand: DataFrame, keys: Sequence[str], rule: Column, atol: float = 0.0, rtol: float = 0.0) -> DataFrame:
    """``compared_rows`` for table artifacts: numbers by the rule, texts and the places of empty cells exactly."""
    a, b = table_columns(ref, keys), table_columns(cand, keys)
    numbers = lambda df: df.withColumn("values", F.coalesce("values", F.transform("texts", lambda t: F.lit(0.0))))
    found = compared_rows(numbers(a), numbers(b), keys, rule, atol, rtol)
    plain = lambda df, p: df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", F.when(F.col("dtype") == "text", F.col("texts")).otherwise(F.transform("texts", lambda t: F.when(t.isNull(), "").otherwise("0"))).alias("t")))).alias(p))
    texts = plain(a, "_a").join(plain(b, "_b"), list(keys)).select(*keys, F.col("_a").eqNullSafe(F.col("_b")).alias("_texts"))
    return found.join(texts, list(keys)).withColumn("verdict", F.when(F.col("_texts"), F.col("verdict")).otherwise("different")).drop("_texts")


def geometry_rows(artifacts: DataFrame, keys: Sequence[str], coords: str = "coords") -> DataFrame:
    """A geometry artifact, ``coords array<array<double>>``, as one row of numbers in order: (keys, ord, row, dtype, values)."""
    return artifacts.select(*keys, F.lit(0).alias("ord"), F.lit("coords").alias("row"), F.lit("float64").alias("dtype"), F.flatten(coords).alias("values"))


def artifact_structure(kind: Column, shape: Column, roi: Column, names: Column) -> Column:
    """What of two results must be equal before their numbers are compared; titles and attributes do not count."""
    return F.to_json(F.struct(kind.alias("result_kind"), shape.alias("kind"), roi.alias("roi_indices"), F.when(kind != "geometry", names).alias("names")), {"ignoreNullFields": "false"})


def object_rows(objects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Objects as the rows that the rules compare: (keys, ord, row, dtype, values).

    ``objects(kind, x, y, dx, dy, data, x0, y0, sx, sy, xcoords, ycoords)``. A signal gives x, y, and uncertainties that are
    there and not all NaN. An image gives its data in C order, then origin and steps, or its coordinates where it has some.
    """
    real = lambda c: F.col(c).isNotNull() & F.exists(c, lambda v: ~F.isnan(v))
    row = lambda name, values: F.struct(F.lit(name).alias("row"), values.cast("array<double>").alias("values"))
    signal = F.array(row("x", F.col("x")), row("y", F.col("y")), F.when(real("dx"), row("dx", F.col("dx"))), F.when(real("dy"), row("dy", F.col("dy"))))
    uniform = F.col("xcoords").isNull()
    image = F.concat(F.array(row("data", F.col("data"))), F.when(uniform, F.array(*[row(n, F.array(F.col(c))) for n, c in (("x0", "x0"), ("y0", "y0"), ("dx", "sx"), ("dy", "sy"))])).otherwise(F.array(row("xcoords", F.col("xcoords")), row("ycoords", F.col("ycoords")))))
    listed = F.array_compact(F.when(F.col("kind") == "signal", signal).otherwise(image))
    return objects.select(*keys, F.posexplode(listed).alias("ord", "r")).select(*keys, "ord", "r.row", F.lit("float64").alias("dtype"), "r.values")
