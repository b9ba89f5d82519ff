"""Itemsets and rules over the part types of orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import rules
from .base import query, table

_B = "b AS (SELECT DISTINCT l_orderkey AS tid, split_part(p_type, ' ', 1) AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _baskets(spark, sf_dir):
    """Used several times by each query, so it is cut here. Rows are dealt by part to find its type and by order to be told
    apart: neither grows with the tables in one task, and no table of parts is sent to all."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    n = li.count()
    rows = rules.dealt(li.select("l_orderkey", "l_partkey"), n, "l_partkey").join(p.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    return cut(rules.dealt(rows.select(F.col("l_orderkey").alias("tid"), F.split("p_type", " ")[0].alias("item")), n, "tid").distinct())


def _least(baskets) -> tuple[int, int]:
    """(number of baskets, a twentieth of it rounded down)"""
    n = rules.count_baskets(baskets)
    return n, n // 20


_N = "n AS (SELECT count(DISTINCT tid) AS n, count(DISTINCT tid) // 20 AS least FROM b)"
# A basket is a number whose bits are its items; an itemset is in the baskets that have all its bits.
_SETS = f"""{_B}, {_N}, i AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS p FROM (SELECT DISTINCT item FROM b)),
baskets AS (SELECT bits, count(*) AS c FROM (SELECT tid, bit_or(1::BIGINT << p) AS bits FROM b JOIN i USING (item) GROUP BY tid) GROUP BY bits),
masks AS (SELECT unnest(range(1, 1::BIGINT << (SELECT count(*) FROM i))) AS m),
found AS (SELECT m, sum(c)::BIGINT AS cnt FROM masks JOIN baskets ON bits & m = m GROUP BY m HAVING sum(c) >= (SELECT least FROM n)),
sets AS (SELECT list(item ORDER BY item) AS items, count(*)::INT AS k, any_value(cnt) AS cnt FROM found JOIN i ON (m >> p) & 1 = 1 GROUP BY m)"""


@query(f"WITH {_B} SELECT item, count(*) AS cnt, round(count(*) / (SELECT count(DISTINCT tid) FROM b)::DOUBLE, 6) AS support FROM b GROUP BY item")
def item_support(spark, sf_dir):
    return rules.item_support(_baskets(spark, sf_dir))


@query(f"WITH {_SETS} SELECT array_to_string(items, ',') AS items, k, cnt FROM sets")
def apriori_itemsets(spark, sf_dir):
    b = _baskets(spark, sf_dir)
    return rules.apriori(b, _least(b)[1]).select(F.array_join("items", ",").alias("items"), "k", "cnt")


@query(f"WITH {_SETS} SELECT array_to_string(items, ',') AS items, k, cnt FROM sets")
def fp_growth_itemsets(spark, sf_dir):
    b = _baskets(spark, sf_dir)
    return rules.fp_growth(b, _least(b)[1]).select(F.array_join("items", ",").alias("items"), "k", "cnt")


_RULES = f"""{_SETS}, m AS (SELECT items, k, cnt, unnest(range(1, (1 << k) - 1)) AS m FROM sets WHERE k >= 2),
s AS (SELECT list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS a, list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 0) AS c, cnt FROM m),
j AS (SELECT s.a, s.c, s.cnt, x.cnt AS ca, y.cnt AS cb, n.n FROM s JOIN sets x ON x.items = s.a JOIN sets y ON y.items = s.c, n),
rules AS (SELECT array_to_string(a, ',') AS antecedent, array_to_string(c, ',') AS consequent, len(a)::INT AS size_left, round(cnt / n::DOUBLE, 4) AS support, round(cnt / ca::DOUBLE, 4) AS confidence, round(cnt / ca::DOUBLE / (cb / n::DOUBLE), 4) AS lift,
  CASE WHEN cnt = ca THEN 'Infinity'::DOUBLE ELSE round((1 - cb / n::DOUBLE) / (1 - cnt / ca::DOUBLE), 4) END AS conviction, round(cnt / n::DOUBLE - ca / n::DOUBLE * (cb / n::DOUBLE), 4) AS leverage, cnt
  FROM j WHERE cnt / ca::DOUBLE >= 0.3 - 1e-12 AND cnt / ca::DOUBLE / (cb / n::DOUBLE) >= 0.9 - 1e-12)"""


def _rules(spark, sf_dir):
    b = _baskets(spark, sf_dir)
    n, least = _least(b)
    return rules.association_rules(rules.apriori(b, least), n, 0.3, 0.9)


@query(f"WITH {_RULES} SELECT * FROM rules")
def association_rules(spark, sf_dir):
    return _rules(spark, sf_dir)


@query(f"WITH {_RULES} SELECT * FROM rules ORDER BY lift DESC, confidence DESC, antecedent, consequent LIMIT 5")
def top_rules(spark, sf_dir):
    return rules.top_rules(_rules(spark, sf_dir), 5)


@query(f"WITH {_RULES} SELECT count(*) AS n_rules, round(avg(confidence), 3) AS avg_confidence, round(avg(lift), 3) AS avg_lift, count_if(lift > 2)::BIGINT AS n_lift_over_2 FROM rules")
def rule_summary(spark, sf_dir):
    return rules.rule_summary(_rules(spark, sf_dir))


@query(f"WITH {_RULES} SELECT consequent, count(*) AS n, max(lift) AS best_lift FROM rules WHERE size_left = 1 GROUP BY consequent")
def cross_sell(spark, sf_dir):
    return rules.cross_sell(_rules(spark, sf_dir))


@query(f"WITH {_RULES} SELECT * FROM rules ORDER BY confidence DESC, lift DESC, antecedent, consequent LIMIT 1")
def surest_rule(spark, sf_dir):
    return rules.top_rules(_rules(spark, sf_dir), 1, "confidence")


@query(f"WITH {_RULES} SELECT *, (row_number() OVER (ORDER BY lift DESC, confidence DESC, antecedent))::INT AS rank FROM rules WHERE consequent = 'PROMO'")
def rules_for_promo(spark, sf_dir):
    return rules.by_consequent(_rules(spark, sf_dir), "PROMO")


@query(f"WITH {_SETS} SELECT array_to_string(items, ',') AS items, k, cnt, (row_number() OVER (PARTITION BY k ORDER BY cnt DESC, array_to_string(items, ',')))::INT AS place FROM sets ORDER BY k, place")
def itemsets_by_size(spark, sf_dir):
    b = _baskets(spark, sf_dir)
    found = rules.by_size_and_support(rules.fp_growth(b, _least(b)[1])).select(F.array_join("items", ",").alias("items"), "k", "cnt")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("cnt"), "items")))


@query(f"WITH {_B} SELECT count(*) AS cnt FROM (SELECT tid FROM b WHERE item IN ('PROMO', 'SMALL') GROUP BY tid HAVING count(*) = 2)")
def pair_support(spark, sf_dir):
    return rules.support_count(_baskets(spark, sf_dir), ["PROMO", "SMALL"])


@query(f"WITH {_B}, {_N} SELECT item, count(*) AS cnt, count(*) >= (SELECT least FROM n) AS frequent FROM b WHERE item <> 'PROMO' AND tid IN (SELECT tid FROM b WHERE item = 'PROMO') GROUP BY item")
def pattern_base(spark, sf_dir):
    b = _baskets(spark, sf_dir)
    return rules.pattern_base(b, "PROMO", _least(b)[1])


@query(f"""WITH {_B}, {_N}, f AS (SELECT item, count(*) AS cnt FROM b GROUP BY item HAVING count(*) >= (SELECT least FROM n)),
o AS (SELECT tid, list(item ORDER BY cnt DESC, item) AS p FROM b JOIN f USING (item) GROUP BY tid),
x AS (SELECT p[i] AS item, p[1:i] AS prefix FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM o))
SELECT item, count(*) AS total, count(DISTINCT prefix) AS nodes FROM x GROUP BY item""")
def header_table(spark, sf_dir):
    b = _baskets(spark, sf_dir)
    return rules.header_table(b, _least(b)[1]).withColumn("total", F.col("total").cast("long"))


@query("""SELECT item, count(*) AS cnt FROM (SELECT DISTINCT l_orderkey, l_linenumber, unnest(['flag=' || l_returnflag, 'status=' || l_linestatus, 'line=' || l_linenumber]) AS item FROM lineitem) GROUP BY item""")
def attribute_items(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    b = rules.baskets_from_attributes(li, "id", {"l_returnflag": "flag", "l_linestatus": "status", "l_linenumber": "line"})
    return b.groupBy("item").agg(F.count("*").alias("cnt"))


@query(f"WITH {_B} SELECT v.item, count(b.tid) AS cnt, round(count(b.tid) / (SELECT count(DISTINCT tid) FROM b)::DOUBLE, 6) AS support FROM (VALUES ('PROMO'), ('NOVELTY'), ('LARGE')) v(item) LEFT JOIN b ON b.item = v.item GROUP BY v.item")
def listed_items(spark, sf_dir):
    return rules.frequency_summary(_baskets(spark, sf_dir), ["PROMO", "NOVELTY", "LARGE"])
