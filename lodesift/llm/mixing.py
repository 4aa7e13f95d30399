"""Mixing sources to target weights, with DataFrame operations only.

Each row gets a hash-random key. Within its source, rows stand in the order of that key; sums of sizes by
ranges of the key give the prefix sums at the ranges' bounds, so that only the one range of each source in
which its budget ends has to be sorted row by row. A budget above the source's size is filled by whole
epochs and then by a cut in the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodesift.llm.common import WORD, free_names, materialize, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
#: Ranges of the key in a source.
RANGES = 1024


def order_key(id_col: Column) -> Column:
    """A hash-random key that any engine can compute: 32 hex digits."""
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(id_col.cast("string"), F.lit("null"))))


def key_range(key: Column, ranges: int = RANGES) -> Column:
    """Which of so many equal ranges (a power of two up to 65536) a key is in."""
    return F.floor(F.conv(F.substring(key, 1, 4), 16, 10).cast("long") * ranges / 65536).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """sizes: (source, source_size), a row for each source. Adds target: the total shared by weights that
    repeat along the sources by code point (null last), none above `most` times its size.

    A share is level times weight. Sources are capped in the order of size over weight, so the level is
    what the rest of the total is to the rest of the weights before the first source that it doesn't cap."""
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    capped = (
        weighted.withColumn("rest", F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("rest") / F.col("weights_left"))
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.col("level"))).over(whole))
    )
    return capped.select("source", "source_size", F.least(F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0)), (most * F.col("source_size")).cast("double")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(doc_id, size long, source_size long, target double, taken long), a row for each row of docs.

    size is the number of words; taken counts those that the mix takes over all epochs, and sums to the whole
    part of the target in each source: the row at the cut is taken in part. Null texts have size 0; null
    sources are one source, the last; null ids share a key. Rows that tie in key and id (repeated rows)
    stand by size, and equal ones are told apart by any order, which leaves equal results as a multiset.
    An empty table gives no rows; if there are no words, all targets are 0."""
    sized, plan = planned(docs, id_col, source_col, text_col, weights, most)
    placed = sized.join(plan, sized["source"].eqNullSafe(plan["s"]))
    at_cut = F.coalesce(F.col("range") == F.col("r_cut"), F.lit(False))
    shown = ["doc_id", "size", "source_size", "target"]
    plain = placed.where(~at_cut).select(*shown, (F.col("epochs") * F.col("size") + F.when(F.col("range") < F.col("r_cut"), F.col("size")).otherwise(0)).alias("taken"))
    return plain.unionByName(cut_rows(placed.where(at_cut)).select(*shown, (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken")))


def planned(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: tuple[float, ...], most: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, key, range) for each row, and for each source s its size, target, whole epochs, the
    budget left, and the range r_cut of the key in which it ends, with what comes before that range."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), order_key(F.col(id_col)).alias("key"))
    sized = materialize(sized.withColumn("range", key_range(F.col("key"))), "sized")
    by_range = materialize(sized.groupBy("source", "range").agg(F.sum("size").alias("n")), "ranges")
    goal = targets(by_range.groupBy("source").agg(F.sum("n").alias("source_size")), weights, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = materialize(goal.withColumn("budget", F.floor("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "s"), "goal")
    ends = by_range.withColumn("end", F.sum("n").over(Window.partitionBy("source").orderBy("range")))
    cut = ends.join(goal, ends["source"].eqNullSafe(goal["s"])).where(F.col("end") > F.col("budget")).groupBy("source").agg(F.min(F.struct("range", (F.col("end") - F.col("n")).alias("before"))).alias("c"))
    plan = goal.join(cut, goal["s"].eqNullSafe(cut["source"]), "left").select("s", "source_size", "target", "epochs", "budget", F.col("c.range").alias("r_cut"), F.col("c.before").alias("before_cut"))
    return sized, materialize(plan, "plan")


def cut_rows(placed: DataFrame) -> DataFrame:
    """Of the rows in the ranges at a cut: what each gives beside whole epochs."""
    order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("budget") - F.col("before_cut") - F.sum("size").over(order) + F.col("size")
    return placed.withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least(left, F.col("size"))))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", chars_col: str = "n_chars", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """The mix itself, with the columns of docs, whatever their names: each row once for every epoch that takes it, the
    row at a source's cut with only its first words. Rows without a word (null, empty) are in no mix, except those
    of sources without any word, which stay once. Null sources are one source; null ids share a key; repeated
    rows at a cut each give what the last of them gives; an empty table gives no rows.

    The texts meet only the plan, a row for each source; those in the ranges at cuts, about one in RANGES, meet
    what is cut as well."""
    sized, plan = planned(docs, id_col, source_col, text_col, weights, most)
    cuts = sized.join(plan, sized["source"].eqNullSafe(plan["s"]) & (F.col("range") == F.col("r_cut")))
    at_cut = materialize(cut_rows(cuts).groupBy("doc_id", "size").agg(F.min("extra").alias("extra")), "cuts")
    size, place, source, whole, epochs, r_cut, cut_id, cut_size, extra, part = free_names(docs, "size", "range", "source_at", "source_size", "epochs", "r_cut", "cut_id", "cut_size", "extra", "part")
    own = docs.withColumns({size: word_count(F.col(text_col)), place: key_range(order_key(F.col(id_col)))})
    told = plan.select(F.col("s").alias(source), F.col("source_size").alias(whole), F.col("epochs").alias(epochs), F.col("r_cut").alias(r_cut))
    own = own.join(told, F.col(source_col).eqNullSafe(F.col(source)))
    within = F.coalesce(F.col(place) == F.col(r_cut), F.lit(False))
    zero = F.lit(0).cast("long")
    rest = own.where(~within).withColumn(extra, F.when(F.col(place) < F.col(r_cut), F.col(size)).otherwise(zero))
    at_cut = at_cut.select(F.col("doc_id").alias(cut_id), F.col("size").alias(cut_size), F.col("extra").alias(extra))
    met = own.where(within).join(at_cut, F.col(id_col).eqNullSafe(F.col(cut_id)) & (F.col(size) == F.col(cut_size)), "left").withColumn(extra, F.coalesce(extra, zero))
    used = [F.col(f"`{c}`") for c in (*docs.columns, size, whole, epochs, extra)]
    own = rest.select(*used).unionByName(met.select(*used))
    none = F.array().cast("array<bigint>")
    parts = F.concat(F.array_repeat(size, F.col(epochs).cast("int")), F.when(F.col(extra) > 0, F.array(extra)).otherwise(none))
    parts = F.when(F.col(size) > 0, parts).when(F.col(whole) == 0, F.array(size)).otherwise(none)
    taken = own.withColumn(part, F.explode(parts))
    n = F.col(part).cast("int")
    words, gaps = F.regexp_extract_all(text_col, F.lit(f"({WORD})"), F.lit(1)), F.split(text_col, WORD, -1)
    first = F.array_join(F.flatten(F.zip_with(F.slice(gaps, 1, n), F.slice(words, 1, n), lambda g, w: F.array(g, w))), "")
    cut = F.col(part) < F.col(size)
    out = taken.withColumn(text_col, F.when(cut, first).otherwise(F.col(text_col)))
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(cut, F.length(text_col).cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM weighted
  WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size, least(coalesce((SELECT max(level) FROM levels WHERE level * weight <= 3 * source_size) * weight, 0), (3 * source_size)::DOUBLE) AS target FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS epochs FROM goal),
placed AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.epochs, floor(b.target)::BIGINT - b.epochs * b.source_size AS budget,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS LAST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS start
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(budget - start, size)))::BIGINT AS taken FROM placed
"""
