"""Quality rules as a bitmask ledger (operator 7). DataFrame operations only.

`ledger` reads each text once: it measures, evaluates every rule once and stores one failure bit per rule next to
the measurements, as a table in the shared folder. What a policy keeps, and what each rule costs, are then questions to
the stored bits: a policy is a version and a mask, a document is kept if it fails none of the mask's rules, and
`ablation` counts, for every rule of a policy, the documents that it alone removes, by bitwise aggregation over the few
distinct bit patterns. `keep`, for tables whose rows go on to another step, forms the same bits once in the pass that
filters by a policy's mask; they need no table of their own then.

Repeated windows: the words' XXH64 hashes are combined into one per 5-word window, inside the row. Only texts with a
window hash that occurs twice sort them; nothing is exploded or shuffled, so neither a long text nor a frequent
window can gather rows. A text of n words would have to be of some 10^9 words for two different windows to share a
64-bit hash by chance.

Null and empty texts have no words and fail the base rule. Lines and words are those of the whole text. Rows with
null or repeated ids get a row each. An empty table gives none. Further columns are not read by `ledger`;
`keep` passes them on, whatever their names. A text's arrays are those of its own words: one row's memory grows with its
longest text, not with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, plain_names, table

WINDOW = 5

#: name -> condition on the measurements under which a document fails. The position is the bit; bits are never reused.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "capitals": "2 * n_capitals > word_chars",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
}
BASE = ("few_words", "repeated_windows")
#: version -> rules in force.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "repetition": (*BASE, "repeated_lines"),
    "v1": tuple(RULES),
}
CURRENT = "v1"

_SPACE = r"[\\x20\\x09-\\x0D]"
_TRIM = "' \\t\\n\\u000B\\f\\r'"


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def measured(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with the struct column m_ of measurements. Columns ending in _ are used on the way."""
    w = WINDOW
    own = documents.columns
    df = documents.withColumn("t_", F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.select(
        *own,
        F.expr(f"filter(split(t_, '{_SPACE}+'), x -> x <> '')").alias("words_"),
        F.expr(f"filter(split(t_, '\\n', -1), x -> btrim(x, {_TRIM}) <> '')").alias("lines_"),
        F.expr("length(t_) - length(regexp_replace(t_, '[#*$%&|<>]', ''))").cast("long").alias("n_symbols_"),
        F.expr("length(t_) - length(regexp_replace(t_, '[A-Z]+', ''))").cast("long").alias("n_capitals_"),
    )
    df = df.select(
        *own, "n_symbols_", "n_capitals_",
        F.expr("cast(size(words_) as bigint)").alias("n_words_"),
        F.expr("cast(length(array_join(words_, '')) as bigint)").alias("word_chars_"),
        F.expr("cast(size(lines_) as bigint)").alias("n_lines_"),
        F.expr("cast(size(lines_) - size(array_distinct(lines_)) as bigint)").alias("n_dup_lines_"),
        F.expr("transform(words_, x -> xxhash64(x))").alias("h1_"),
    )
    keep = [*own, "n_symbols_", "n_capitals_", "n_words_", "word_chars_", "n_lines_", "n_dup_lines_"]

    def joined(a: str, b: str, apart: int, name: str) -> Column:
        size = f"greatest(least(size({a}), size({b}) - {apart}), 0)"
        return F.expr(f"zip_with(slice({a}, 1, {size}), slice({b}, {apart + 1}, {size}), (x, y) -> xxhash64(x, y))").alias(name)

    df = df.select(*keep, "h1_", joined("h1_", "h1_", 1, "h2_"))
    df = df.select(*keep, "h1_", joined("h2_", "h2_", 2, "h4_"))
    df = df.select(*keep, joined("h4_", "h1_", w - 1, "win_"))
    df = df.select(*keep, "win_", F.expr("size(array_distinct(win_)) < size(win_)").alias("twice_"))
    df = df.select(*keep, F.expr("if(twice_, sort_array(transform(win_, (x, i) -> struct(x as h, i as at))), array())").alias("sorted_"))
    df = df.select(
        *keep, "sorted_",
        F.expr("if(size(sorted_) < 2, array(false), zip_with(slice(sorted_, 1, size(sorted_) - 1), slice(sorted_, 2, size(sorted_) - 1), (a, b) -> a.h = b.h))").alias("same_"),
    )
    df = df.select(*keep, "sorted_", F.expr("zip_with(concat(array(false), same_), concat(same_, array(false)), (a, b) -> a or b)").alias("hit_"))
    df = df.select(*keep, F.expr("if(size(sorted_) < 2, array(), array_sort(filter(zip_with(sorted_, hit_, (a, f) -> if(f, a.at, null)), x -> x is not null)))").alias("at_"))
    # Windows at sorted places p cover min(w, gap to the next) words each, the last one w.
    covered = f"""if(size(at_) = 0, 0L, cast({w} + aggregate(
        zip_with(slice(at_, 1, size(at_) - 1), slice(at_, 2, size(at_) - 1), (a, b) -> least(b - a, {w})), 0, (s, x) -> s + x) as bigint))"""
    m = F.struct(
        *(F.col(f"{c}_").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")),
        F.expr(covered).alias("n_repeat_words"),
        F.col("n_lines_").alias("n_lines"),
        F.col("n_capitals_").alias("n_capitals"),
    )
    # A filter on a measurement stays above this generator: pushed below, it would spell out all the steps again.
    return df.select(*own, F.explode(F.array(m)).alias("m_"))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def fail_bits(struct: str) -> Column:
    """The failure bits of all rules, from a struct column of the measurements."""

    def of(condition: str) -> Column:
        for name in MEASURES:
            condition = condition.replace(name, f"{struct}.{name}")
        return F.expr(condition)

    return sum((F.when(of(c), F.lit(bit(r))).otherwise(F.lit(0)) for r, c in RULES.items()), F.lit(0)).cast("long")


def ledger(documents: DataFrame) -> DataFrame:
    """(doc_id, measurements ..., fail_bits), written and read back."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return materialize(measured(docs).select("doc_id", "m_.*", fail_bits("m_").alias("fail_bits")), "ledger")


def fails(bits: Column, rules: tuple[str, ...]) -> Column:
    return bits.bitwiseAND(F.lit(sum(bit(r) for r in {*rules}))) != 0


def apply_policy(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """base_failed, kept and the policy's version, from the bits of a ledger."""
    base = fails(F.col("fail_bits"), BASE)
    kept = ~fails(F.col("fail_bits"), (*BASE, *POLICIES[policy]))
    return entries.withColumns({"base_failed": base, "kept": kept, "policy": F.lit(policy)})


def ablation(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """(policy, rule, failed, only, kept, kept_without): documents failing the rule, failing it alone among the
    policy's, kept by the policy, and kept if the rule is left out. One aggregate over at most 2^rules patterns;
    no rows from an empty ledger."""
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    rules = ", ".join(f"struct('{r}' as rule, {bit(r)}L as bit)" for r in POLICIES[policy])
    each = patterns.select("bits", "n", F.expr(f"inline(array({rules}))"))
    return (
        each.groupBy("rule")
        .agg(
            F.sum(F.expr("if(bits & bit <> 0, n, 0)")).alias("failed"),
            F.sum(F.expr("if(bits = bit, n, 0)")).alias("only"),
            F.sum(F.expr("if(bits = 0, n, 0)")).alias("kept"),
        )
        .select(F.lit(policy).alias("policy"), "rule", "failed", "only", "kept", (F.col("kept") + F.col("only")).alias("kept_without"))
    )


def keep(documents: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that a policy keeps by their failure bits, with all their columns."""
    plain, _, text = plain_names(documents)
    booked = measured(plain, text).select(*plain.columns, fail_bits("m_").alias("bits_"))
    return booked.where(~fails(F.col("bits_"), (*BASE, *POLICIES[policy]))).select(*plain.columns).toDF(*documents.columns)


def op7_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_capitals", "fail_bits",
    )


def ledger_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy costs, from one stored ledger."""
    entries = ledger(table(spark, sf_dir, "documents"))
    out = None
    for policy in POLICIES:
        found = ablation(entries, policy)
        out = found if out is None else out.unionByName(found)
    return out


_BITS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT r, i, list_aggregate(ws[i : i + 4], 'string_agg', ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM c, range(5) AS k(k) GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(p.n, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals
  FROM w LEFT JOIN p USING (r)),
b AS (SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
  + CASE WHEN 2 * n_capitals > word_chars THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
  + CASE WHEN word_chars > 25 * n_words THEN 64 ELSE 0 END AS bits FROM m)"""

OP7_SQL = f"""{_BITS}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed, bits = 0 AS kept,
  n_lines, n_capitals, bits::BIGINT AS fail_bits FROM b
"""

ABLATION_SQL = " UNION ALL ".join(
    f"""SELECT '{policy}' AS policy, '{rule}' AS rule, count_if(bits & {bit(rule)} <> 0)::BIGINT AS failed,
  count_if(bits & {mask(policy)} = {bit(rule)})::BIGINT AS only, count_if(bits & {mask(policy)} = 0)::BIGINT AS kept,
  count_if(bits & {mask(policy) & ~bit(rule)} = 0)::BIGINT AS kept_without FROM b"""
    for policy in POLICIES
    for rule in POLICIES[policy]
)
ABLATION_SQL = f"{_BITS} {ABLATION_SQL}"
