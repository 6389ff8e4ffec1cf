"""Group statistics, window transforms, fusion, top-k, sampling and splits over plain tables.

Rules kept throughout: null keys form no group (and get null statistics), a
sample deviation of one row is null, division by zero is null, and order is
always an explicit column.  Random choices are orders by md5(seed|key), so any
engine can repeat them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATS = {"max": F.max, "min": F.min, "mean": F.avg, "std": F.stddev_samp, "sum": F.sum}


def hashed(seed: str, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *(k.cast("string") for k in keys)))


# --------------------------------------------------------------- groups


def group_stats(df: DataFrame, key: str | Sequence[str], counted: Sequence[str] = (), numeric: Sequence[str] = (), stats: Sequence[str] = tuple(STATS)) -> DataFrame:
    """All statistics of one key in one grouped pass: count and distinct count of `counted`, five statistics of `numeric`.

    Each counted column costs one distinct aggregate; Spark plans them in one
    expand, so keep `counted` short on very large tables.
    """
    keys = [key] if isinstance(key, str) else list(key)
    aggregates = [F.count("*").alias("n_rows")]
    for c in counted:
        aggregates += [F.count(c).alias(f"{c}_count"), F.countDistinct(c).alias(f"{c}_nunique")]
    for c in numeric:
        aggregates += [STATS[s](c).alias(f"{c}_{s}") for s in stats]
    return df.filter(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(*aggregates)


def with_group_stats(df: DataFrame, key: str, **options) -> DataFrame:
    """Rows with the statistics of their group, null for a null key."""
    stats = group_stats(df, key, **options)
    renamed = stats.select(key, *(F.col(c).alias(f"{key}_{c}") for c in stats.columns if c != key))
    return df.join(renamed, key, "left")


def transformed(df: DataFrame, keys: Sequence[str], columns: Sequence[str], stats: Sequence[str] = ("mean", "sum")) -> DataFrame:
    """Rows with group statistics by one shared window; null where a key is null."""
    w = Window.partitionBy(*keys)
    known = None
    for k in keys:
        known = F.col(k).isNotNull() if known is None else known & F.col(k).isNotNull()
    return df.select("*", *(F.when(known, STATS[s](c).over(w)).alias(f"{'_'.join(keys)}_{c}_{s}") for c in columns for s in stats))


def top_values(df: DataFrame, key: str, value: str, order: str, k: int) -> DataFrame:
    """(key, value, n, rank): the k most frequent values of each key; ties by first appearance in `order`.

    Counting comes before ranking, so a key's rows meet in partial sums; the
    rank's window keeps only k rows a task before its shuffle.
    """
    counts = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "_first", value)
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("_first")


def top_lists(df: DataFrame, key: str, value: str, order: str, k: int) -> DataFrame:
    """(key, top): the k most frequent values of each key in rank order."""
    ranked = top_values(df, key, value, order, k)
    return ranked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", value))).alias("t")).select(key, F.col("t").getField(value).alias("top"))


def vocabulary(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, n, index): index from 0 by falling count, ties by first appearance.

    The index is made of range-partitioned ranks, so no task orders the whole
    vocabulary.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return dense_positions(counts, [F.desc("n"), F.asc("_first"), F.asc(value)], "index").drop("_first")


def _ranged(df: DataFrame, order: list[Column], amount: Column) -> tuple[DataFrame, DataFrame]:
    """(df range-partitioned in a total order with _part and _at; the sum of `amount` in the partitions before each).

    The sums are one row a partition, whatever the rows.
    """
    from quillon.sources.tables import cut

    at = F.monotonically_increasing_id()
    parted = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_q_at", at)).withColumn("_q_part", F.shiftright("_q_at", 33))
    sizes = parted.groupBy("_q_part").agg(F.sum(amount).alias("_n"))
    before = sizes.select("_q_part", (F.coalesce(F.sum("_n").over(Window.orderBy("_q_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_q_before"))
    return parted, before


def dense_positions(df: DataFrame, order: list[Column], name: str, from_: int = 0) -> DataFrame:
    """Rows numbered in a total order without bringing them to one task.

    Rows are range-partitioned, numbered inside their partition, and shifted
    by the counts of the partitions before; those counts are one row a
    partition.
    """
    parted, before = _ranged(df, order, F.lit(1))
    number = F.col("_q_before") + F.col("_q_at").bitwiseAND(F.lit((1 << 33) - 1)) + from_
    return parted.join(F.broadcast(before), "_q_part").withColumn(name, number).drop("_q_at", "_q_part", "_q_before")  # one row a partition


def running_total(df: DataFrame, order: list[Column], amount: str, name: str) -> DataFrame:
    """The sum of `amount` over the rows before each in a total order (0 for the first), by ranges as in dense_positions."""
    parted, before = _ranged(df, order, F.col(amount))
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy("_q_part").orderBy("_q_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parted.withColumn("_q_inside", inside).join(F.broadcast(before), "_q_part").withColumn(name, F.col("_q_before") + F.col("_q_inside")).drop("_q_at", "_q_part", "_q_before", "_q_inside")  # one row a partition


def concatenated(df: DataFrame, key: str, text: str, order: str, sep: str = " ") -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct(order, text)))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array_join(parts.getField(text), sep).alias(text))


# --------------------------------------------------------------- fusion


def min_max(df: DataFrame, group: Sequence[str], score: str = "score") -> DataFrame:
    """Scores brought to 0..1 in their group; 0 where all are equal."""
    w = Window.partitionBy(*group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(score, F.when(high != low, (F.col(score) - low) / (high - low)).otherwise(F.lit(0.0)))


def fuse(scores: DataFrame, weights: dict[str, float], leaders: Sequence[str], author: str = "author_id", item: str = "id") -> DataFrame:
    """One weighted score for each (author, item) of long scores (model, author, item, score).

    Items are those of the two leading models, authors those of the first;
    a model without the item counts 0.  One grouped pass takes the place of
    joins: scores are normalised by (model, author) and summed by (author,
    item).
    """
    normal = min_max(scores.filter(F.col("model").isin(*weights)), ["model", author])
    weight = F.coalesce(*(F.when(F.col("model") == m, F.lit(w)) for m, w in weights.items()))
    led = F.max(F.col("model").isin(*leaders))
    first = F.max(F.max((F.col("model") == leaders[0]).cast("int"))).over(Window.partitionBy(author))
    fused = normal.groupBy(author, item).agg(F.sum(F.col("score") * weight).alias("score"), led.alias("_led"), first.alias("_first"))
    return fused.filter("_led and _first = 1").select(author, item, "score")


def score_maps(scores: DataFrame, author: str = "author_id", item: str = "id", order: str | None = None) -> DataFrame:
    """(author, scores): a JSON object of item scores; of repeated items the last in `order` (or the largest score) wins."""
    last = F.max_by("score", order) if order else F.max("score")
    one = scores.groupBy(author, item).agg(last.alias("score"))
    entries = F.sort_array(F.collect_list(F.struct(F.col(item).cast("string").alias("key"), "score")))
    return one.groupBy(author).agg(F.to_json(F.map_from_entries(entries)).alias("scores"))


# --------------------------------------------------------------- windows


def within_budget(df: DataFrame, group: Sequence[str], order: Sequence[str], length: str, budget: float) -> DataFrame:
    """All rows of groups whose lengths sum to at most the budget; else those whose running sum stays under it."""
    w = Window.partitionBy(*group)
    running = F.sum(length).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_all", F.sum(length).over(w)).withColumn("_run", running).filter((F.col("_all") <= budget) | (F.col("_run") < budget)).drop("_all", "_run")


def history_windows(df: DataFrame, series: Sequence[str], order: str, value: str, history: int, ahead: int) -> DataFrame:
    """(series, order, x, y): `history` values from each row on and the one `ahead` steps after them.

    As many windows as rows less history and ahead.
    """
    w = Window.partitionBy(*series).orderBy(order)
    x = F.collect_list(value).over(w.rowsBetween(0, history - 1))
    y = F.lead(value, history + ahead - 1).over(w)
    place, size = F.row_number().over(w), F.count("*").over(Window.partitionBy(*series))
    made = df.select(*series, order, x.alias("x"), y.alias("y"), place.alias("_p"), size.alias("_n"))
    return made.filter(F.col("_p") <= F.col("_n") - history - ahead).drop("_p", "_n")


def chronological_split(df: DataFrame, series: Sequence[str], order: str, shares: Sequence[float] = (0.8, 0.1)) -> DataFrame:
    """Rows marked train, val or test by place in their series; sizes rounded half to even."""
    n = F.count("*").over(Window.partitionBy(*series))
    p = F.row_number().over(Window.partitionBy(*series).orderBy(order))
    a, b = F.bround(n * shares[0]), F.bround(n * shares[0]) + F.bround(n * shares[1])
    return df.withColumn("split", F.when(p <= a, "train").when(p <= b, "val").otherwise("test"))


def pair_windows(walks: DataFrame, walk: str, place: str, node: str, window: int) -> DataFrame:
    """(walk, centre, context) for nodes at most window places apart in a walk; a place holds one node.

    The `window` rows ahead come from one window over the walk, and every pair
    is told from both its ends: no walk is joined with itself.
    """
    w = Window.partitionBy(walk).orderBy(place)
    ahead = F.array(*(F.lead(F.struct(F.col(place).alias("p"), F.col(node).alias("n")), k).over(w) for k in range(1, window + 1)))
    rows = walks.select(walk, F.col(place).alias("_p"), F.col(node).alias("_n"), ahead.alias("_a"))
    near = rows.select(walk, "_p", "_n", F.explode("_a").alias("_x")).filter(F.col("_x.p") - F.col("_p") <= window)
    ends = F.array(F.struct(F.col("_n").alias("centre"), F.col("_x.n").alias("context")), F.struct(F.col("_x.n").alias("centre"), F.col("_n").alias("context")))
    return near.select(walk, F.explode(ends).alias("_e")).select(walk, "_e.centre", "_e.context")


# --------------------------------------------------------------- sampling and splits


def typed_pairs(walks: DataFrame, walk: str, place: str, node: str, kind: str, hop: int, nodes: DataFrame, seed: str = "0") -> DataFrame:
    """(x, y, relation, path, negative): nodes up to `hop` places on in a walk, the path of types between, its number, and a negative.

    Later places come from windows over the walk, so no pairs are joined; the
    negative is a node of y's type, drawn by md5 from the numbered nodes.
    """
    from quillon.sources.tables import cut

    w = Window.partitionBy(walk).orderBy(place)
    ahead = [F.lead(F.struct(F.col(node).alias("y"), F.col(kind).alias("k")), k).over(w).alias(f"_{k}") for k in range(1, hop + 1)]
    steps = walks.select(F.col(node).alias("x"), F.col(kind).alias("_0"), *ahead)
    path = lambda k: F.concat_ws(">", "_0", *(F.col(f"_{j}.k") for j in range(1, k + 1)))
    found = steps.select("x", F.explode(F.array(*(F.struct(F.col(f"_{k}.y").alias("y"), F.col(f"_{k}.k").alias("kind"), path(k).alias("path")) for k in range(1, hop + 1)))).alias("s")).select("x", "s.*").filter("y is not null")
    relations = dense_positions(found.select("path").distinct(), [F.asc("path")], "relation")
    numbered = cut(dense_positions(nodes.select(F.col(node).alias("negative"), F.col(kind).alias("kind")), [F.asc("kind"), F.asc("negative")], "_at"))
    sizes = cut(numbered.groupBy("kind").agg(F.count("*").alias("_n"), F.min("_at").alias("_from")))
    numbered = numbered.join(sizes.select("kind", "_from"), "kind").select("negative", "kind", (F.col("_at") - F.col("_from")).alias("_k"))
    spot = F.pmod(F.conv(F.substring(hashed(seed, F.col("x"), F.col("y"), F.col("path")), 1, 15), 16, 10).cast("long"), F.col("_n"))
    return found.join(sizes.drop("_from"), "kind").withColumn("_k", spot).join(numbered, ["kind", "_k"]).join(relations, "path").select("x", "y", "relation", "path", "negative")


def under_sampled(df: DataFrame, label: str, key: str, ratio: float = 1.0, seed: str = "0", minority=0) -> DataFrame:
    """All rows of the minority label, and of the others so many times as many, least md5 first.

    The others are counted by the first 16 bits of their md5 (a bounded table);
    whole ranges below the limit pass by a filter, and only the range that
    holds the limit is ordered.
    """
    few, rest = df.filter(F.col(label) == minority), df.filter(F.col(label) != minority)
    left, limit = int(few.count() * ratio), 1 << 16
    place = F.conv(F.substring(hashed(seed, F.col(key)), 1, 4), 16, 10).cast("int")
    for k, n in sorted(tuple(r) for r in rest.groupBy(place.alias("k")).agg(F.count("*").alias("n")).collect()):  # 2**16 rows at most
        if n > left:
            limit = k
            break
        left -= n
    edge = rest.filter(place == limit).orderBy(hashed(seed, F.col(key)), key).limit(left)
    return few.unionByName(rest.filter(place < limit)).unionByName(edge)


def first_by_hash(df: DataFrame, group: Sequence[str], key: Sequence[str], k: int, seed: str = "0") -> DataFrame:
    """At most k rows of each group, least md5 first: a repeatable sample without replacement."""
    w = Window.partitionBy(*group).orderBy(hashed(seed, *(F.col(c) for c in key)), *key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def hash_split(df: DataFrame, key: Sequence[str], shares: dict[str, float], seed: str = "0") -> DataFrame:
    """Rows marked with a split by the place of their md5 in 0..1: no ordering, no shuffle."""
    at = F.conv(F.substring(hashed(seed, *(F.col(c) for c in key)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    names, upper, out = list(shares), 0.0, None
    for name in names[:-1]:
        upper = round(upper + shares[name], 12)
        out = F.when(at < upper, name) if out is None else out.when(at < upper, name)
    out = F.lit(names[-1]) if out is None else out.otherwise(names[-1])
    return df.withColumn("split", out)


def group_folds(df: DataFrame, group: str, label: str, folds: int = 5, seed: str = "0") -> DataFrame:
    """(group, fold): whole groups dealt to folds with like label shares.

    Groups are cut into strata by label share and size (powers of two) and
    dealt round robin in md5 order inside each, by a window over groups, not
    rows.
    """
    per = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(label).alias("share"))
    strata = per.withColumn("_s", F.concat_ws("/", F.floor(F.log2("n")).cast("string"), F.round("share", 1).cast("string")))
    w = Window.partitionBy("_s").orderBy(hashed(seed, F.col(group)), group)
    return strata.select(group, F.pmod(F.row_number().over(w) - 1, F.lit(folds)).cast("int").alias("fold"))


def weighted_sample(df: DataFrame, group: Sequence[str], key: Sequence[str], weight: str, k: int, seed: str = "0") -> DataFrame:
    """k rows of each group without replacement, chances in proportion to weight: the exponential race -ln(u) / w."""
    u = (F.conv(F.substring(hashed(seed, *(F.col(c) for c in key)), 1, 12), 16, 10).cast("double") + 1) / float((1 << 48) + 1)
    w = Window.partitionBy(*group).orderBy((-F.log(u) / F.col(weight)), *key)
    return df.filter(F.col(weight) > 0).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def label_codes(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Rows with the rank of their value among the sorted distinct values, from 0; null for null."""
    distinct = df.filter(F.col(column).isNotNull()).select(column).distinct()
    return df.join(dense_positions(distinct, [F.asc(column)], name or f"{column}_code"), column, "left")


def downcast(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whole-number columns as the narrowest type that holds their range: one pass finds all ranges."""
    bounds = df.agg(*(f(c).alias(f"{c}{n}") for c in columns for f, n in ((F.min, "_lo"), (F.max, "_hi")))).first()
    for c in columns:
        lo, hi = bounds[f"{c}_lo"], bounds[f"{c}_hi"]
        if lo is not None:
            kind = next((t for t, n in (("tinyint", 7), ("smallint", 15), ("int", 31)) if -(1 << n) <= lo and hi < 1 << n), "bigint")
            df = df.withColumn(c, F.col(c).cast(kind))
    return df
