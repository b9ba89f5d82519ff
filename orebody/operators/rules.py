"""Frequent itemsets and association rules. Transactions are long: (tid, item), one row per item of a basket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

MAX_ITEMSET = 16  # a rule table row per subset: 2^k - 2 of an itemset of k


def baskets_from_flags(df: DataFrame, tid: str, items: list[str]) -> DataFrame:
    long = df.select(F.col(tid).alias("tid"), F.inline(F.array(*(F.struct(F.lit(i).alias("item"), F.col(i).alias("flag_")) for i in items))))
    return long.where("flag_ = 1").select("tid", "item")


def baskets_from_attributes(df: DataFrame, tid: str, attributes: dict[str, str]) -> DataFrame:
    """attribute -> prefix: items are prefix=value; nulls give none."""
    long = df.select(F.col(tid).alias("tid"), F.inline(F.array(*(F.struct(F.concat(F.lit(f"{p}="), F.col(a).cast("string")).alias("item")) for a, p in attributes.items()))))
    return long.where("item is not null").distinct()


def item_support(baskets: DataFrame) -> DataFrame:
    n = baskets.agg(F.count_distinct("tid").alias("n_"))
    counts = baskets.distinct().groupBy("item").agg(F.count("*").alias("cnt"))
    return counts.crossJoin(F.broadcast(n)).select("item", "cnt", F.round(F.col("cnt") / F.col("n_"), 6).alias("support"))


def support_count(baskets: DataFrame, items: list[str]) -> DataFrame:
    """One row: the baskets that hold all the items."""
    hits = baskets.where(F.col("item").isin(items)).groupBy("tid").agg(F.count_distinct("item").alias("k_")).where(F.col("k_") == len(set(items)))
    return hits.agg(F.count("*").alias("cnt"))


def candidates(frequent: DataFrame, k: int) -> DataFrame:
    """Itemsets of k items of which all subsets of k-1 are frequent: pairs with equal first k-2 items are joined, then
    a candidate must find its k subsets among the frequent ones. Items within a set are in order."""
    prefix = lambda c: F.slice(c, 1, k - 2)
    a = frequent.select(F.col("items").alias("a_"))
    b = frequent.select(F.col("items").alias("b_"))
    joined = a.join(b, (prefix(F.col("a_")) == prefix(F.col("b_"))) & (F.element_at("a_", -1) < F.element_at("b_", -1)))
    made = joined.select(F.concat("a_", F.slice("b_", k - 1, 1)).alias("items"))
    if k == 2:
        return made
    subsets = made.select("items", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("out_")).select(
        "items", F.filter("items", lambda x, i: i != F.col("out_")).alias("sub_")
    )
    found = subsets.join(frequent.select(F.col("items").alias("sub_")), "sub_", "left_semi")
    return found.groupBy("items").agg(F.count("*").alias("k_")).where(F.col("k_") == k).select("items")


SLICE = 1 << 15  # baskets of a slice, about: a bitmap of 4 kB
TASK_ROWS = 1 << 18  # rows dealt to a task, about


def dealt(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """The n rows by these columns. As the number of tasks is given, Spark neither joins them nor keeps to a number that is
    set for all tables: what a task holds does not grow with the table."""
    return rows.repartition(max(1, -(-n // TASK_ROWS)), *by)


def count_baskets(baskets: DataFrame) -> int:
    return dealt(baskets.select("tid"), baskets.count(), "tid").agg(F.count_distinct("tid")).first()[0]


def slices_of(baskets: DataFrame) -> int:
    return max(1, -(-count_baskets(baskets) // SLICE))


def in_slices(itemsets: DataFrame, slices: int) -> DataFrame:
    """Each row once for every slice: joined by slice too, no task gets all baskets of an item."""
    return itemsets.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))


def basket_words(baskets: DataFrame, slices: int) -> DataFrame:
    """(item, slice, words): for each item and slice of the baskets the words (w, b) of 64 baskets that are not zero. A slice
    is a share of the baskets by hash; a basket's bit is its rank in the slice. Baskets may repeat items. Rows are dealt by
    slice once, for ranks and words."""
    rows = baskets.select("tid", "item", F.pmod(F.xxhash64("tid"), F.lit(slices)).cast("int").alias("slice"))
    rows = dealt(rows, baskets.count(), "slice").withColumn("at", F.dense_rank().over(Window.partitionBy("slice").orderBy("tid")) - 1)
    words = rows.groupBy("item", "slice", F.floor(F.col("at") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, at % 64)")).alias("b"))
    return words.groupBy("item", "slice").agg(F.collect_list(F.struct("w", "b")).alias("words"))  # at most a slice's words


def dense_bitmaps(words: DataFrame) -> DataFrame:
    """(items, slice, bits) of basket_words, all of one length."""
    last = words.agg(F.max(F.array_max("words.w"))).first()[0] or 0
    held = F.map_from_entries("words")
    bits = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda w: F.coalesce(F.try_element_at(held, w), F.lit(0).cast("long")))
    return words.select(F.array("item").alias("items"), "slice", bits.alias("bits"))


def basket_bitmaps(baskets: DataFrame) -> DataFrame:
    """(items, slice, bits): for each item and slice of the baskets a bitmap of the baskets that hold it."""
    return dense_bitmaps(cut(basket_words(baskets, slices_of(baskets))))


def apriori(baskets: DataFrame, min_count: int) -> DataFrame:
    """(items, k, cnt), level by level until one is empty. Baskets are held as bitmaps, one for each frequent itemset of
    a level and slice of baskets. A candidate's baskets are the bits that two of its subsets share, so a level has a row
    per candidate and slice, and no row per basket. Joins are by itemset and slice, so a task's rows do not grow with the
    baskets of an item. Each level is cut, so none is computed again for the next."""
    slices = slices_of(baskets)
    words = cut(basket_words(baskets, slices))
    counted = words.groupBy("item").agg(F.sum(F.aggregate("words.b", F.lit(0).cast("long"), lambda n, b: n + F.bit_count(b))).alias("cnt"))
    level = cut(counted.where(F.col("cnt") >= min_count).select(F.array("item").alias("items"), F.lit(1).alias("k"), "cnt"))
    among = in_slices(level.select(F.col("items")[0].alias("item")), slices)
    held, out, k = cut(dense_bitmaps(words.join(among, ["item", "slice"], "left_semi"))), level, 1
    while not level.isEmpty():
        k += 1
        want = candidates(level, k)
        want = want.select("items", F.slice("items", 1, k - 1).alias("a_"), F.concat(F.slice("items", 1, k - 2), F.slice("items", k, 1)).alias("b_"))
        one = held.select(F.col("items").alias("a_"), "slice", F.col("bits").alias("x_"))
        two = held.select(F.col("items").alias("b_"), "slice", F.col("bits").alias("y_"))
        both = in_slices(want, slices).join(one, ["a_", "slice"]).join(two, ["b_", "slice"])
        grown = cut(both.select("items", "slice", F.zip_with("x_", "y_", lambda x, y: x.bitwiseAND(y)).alias("bits")))
        ones = F.aggregate("bits", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))
        level = cut(grown.groupBy("items").agg(F.sum(ones).alias("cnt")).where(F.col("cnt") >= min_count).select("items", F.lit(k).alias("k"), "cnt"))
        held = grown.join(in_slices(level.select("items"), slices), ["items", "slice"], "left_semi")
        out = out.unionByName(level)
    return out


def fp_growth(baskets: DataFrame, min_count: int) -> DataFrame:
    """(items, k, cnt) by MLlib's parallel FP-growth; the threshold is applied again on integer counts."""
    from pyspark.ml.fpm import FPGrowth

    sets = baskets.groupBy("tid").agg(F.collect_set("item").alias("items"))
    n = max(1, sets.count())
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (min_count - 0.5) / n), minConfidence=0.0).fit(sets)
    return model.freqItemsets.where(F.col("freq") >= min_count).select(F.sort_array("items").alias("items"), F.size("items").alias("k"), F.col("freq").alias("cnt"))


def association_rules(itemsets: DataFrame, n: int, min_confidence: float, min_lift: float) -> DataFrame:
    """Every split of every itemset into antecedent and consequent (size_left items). Itemsets are few next to baskets.
    The query fails on an itemset of more than MAX_ITEMSET items."""
    masks = F.expr("explode(sequence(1, shiftleft(1, size(items)) - 2))")
    held = F.when(F.size("items") > MAX_ITEMSET, F.raise_error(F.lit(f"an itemset has more than {MAX_ITEMSET} items"))).otherwise(F.size("items"))
    split = itemsets.where(held >= 2).select("items", "cnt", F.size("items").alias("k_"), F.col("cnt").alias("c_")).withColumn("m_", masks)
    pick = lambda want: F.expr(f"filter(items, (x, i) -> (shiftright(m_, i) & 1) = {want})")
    sides = split.select(pick(1).alias("antecedent"), pick(0).alias("consequent"), F.col("c_").alias("cnt"))
    a = itemsets.select(F.col("items").alias("antecedent"), F.col("cnt").alias("ca_"))
    b = itemsets.select(F.col("items").alias("consequent"), F.col("cnt").alias("cb_"))
    j = sides.join(a, "antecedent").join(b, "consequent")
    total = float(n)
    s, conf, sb = F.col("cnt") / total, F.col("cnt") / F.col("ca_"), F.col("cb_") / total
    lift = conf / sb
    rules = j.select(
        F.array_join("antecedent", ",").alias("antecedent"), F.array_join("consequent", ",").alias("consequent"), F.size("antecedent").alias("size_left"),
        F.round(s, 4).alias("support"), F.round(conf, 4).alias("confidence"), F.round(lift, 4).alias("lift"),
        F.when(F.col("cnt") == F.col("ca_"), F.expr("double('Infinity')")).otherwise(F.round((1 - sb) / F.nullif(1 - conf, F.lit(0.0)), 4)).alias("conviction"),
        F.round(s - F.col("ca_") / total * sb, 4).alias("leverage"), F.col("cnt"), conf.alias("c__"), lift.alias("l__"),
    )
    return rules.where((F.col("c__") >= min_confidence - 1e-12) & (F.col("l__") >= min_lift - 1e-12)).drop("c__", "l__")


def top_rules(rules: DataFrame, n: int, by: str = "lift") -> DataFrame:
    """The n best by lift (then confidence) or by confidence (then lift)."""
    other = {"lift": "confidence", "confidence": "lift"}[by]
    return rules.orderBy(F.desc(by), F.desc(other), "antecedent", "consequent").limit(n)


def by_size_and_support(itemsets: DataFrame) -> DataFrame:
    """Itemsets in the order of their size, the most frequent first."""
    return itemsets.orderBy("k", F.desc("cnt"), F.array_join("items", ","))


def cross_sell(rules: DataFrame) -> DataFrame:
    """(consequent, n, best_lift) of the rules with one item on the left, by what they suggest."""
    return rules.where("size_left = 1").groupBy("consequent").agg(F.count("*").alias("n"), F.max("lift").alias("best_lift"))


def rule_summary(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count("*").alias("n_rules"), F.round(F.avg("confidence"), 3).alias("avg_confidence"), F.round(F.avg("lift"), 3).alias("avg_lift"), F.count_if(F.col("lift") > 2).alias("n_lift_over_2"))


def pattern_base(baskets: DataFrame, item: str, min_count: int) -> DataFrame:
    """(item, cnt, frequent): what the baskets with an item hold besides."""
    own = baskets.where(F.col("item") == item).select("tid").distinct()
    rest = baskets.where(F.col("item") != item).join(own, "tid", "left_semi").distinct()
    return rest.groupBy("item").agg(F.count("*").alias("cnt")).withColumn("frequent", F.col("cnt") >= min_count)


def header_table(baskets: DataFrame, min_count: int) -> DataFrame:
    """(item, total, nodes): an item's count and its nodes in the prefix tree of baskets ordered by item frequency.
    A node is a distinct prefix, so a basket of n frequent items gives n rows."""
    counts = baskets.distinct().groupBy("item").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= min_count)
    ordered = baskets.distinct().join(counts, "item").groupBy("tid").agg(F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("o"), "item"))).alias("path"))
    prefixes = ordered.select(F.posexplode(F.col("path.item")).alias("p_", "item"), F.col("path.item").alias("all_")).select("item", F.expr("slice(all_, 1, p_ + 1)").alias("prefix_"))
    found = prefixes.groupBy("item", "prefix_").agg(F.count("*").alias("c_"))
    return found.groupBy("item").agg(F.sum("c_").alias("total"), F.count("*").alias("nodes"))


def frequency_summary(baskets: DataFrame, items: list[str]) -> DataFrame:
    """All listed items, also those in no basket."""
    spark = baskets.sparkSession
    listed = spark.createDataFrame([(i,) for i in items], "item string")
    return listed.join(item_support(baskets), "item", "left").select("item", F.coalesce("cnt", F.lit(0)).alias("cnt"), F.coalesce("support", F.lit(0.0)).alias("support"))


def by_consequent(rules: DataFrame, consequent: str) -> DataFrame:
    """The rules with this consequent, ranked."""
    best = Window.partitionBy("consequent").orderBy(F.desc("lift"), F.desc("confidence"), "antecedent")
    return rules.where(F.col("consequent") == consequent).withColumn("rank", F.row_number().over(best))
