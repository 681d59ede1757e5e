"""Quality rules as a bitmask ledger, in DataFrame operations only.

measure() evaluates every rule once per document and stores the measurements and one long of failure bits. A policy is
a versioned set of rules; judge() applies it with one bitwise AND, and ablation() counts for every rule of a policy what
leaving it out would keep, from bitwise aggregates of the ledger alone.

Nulls have no words and fail the length rule. Empty texts likewise. Rows are judged alone, so ties and repeated rows
change nothing, and no row leaves its partition. Words of 8-word windows are told apart by 64-bit digests of the
windows within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_GAP, SPACES, let, plain_words

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A rule fails where the condition, SQL over the measurements, is true."""

    bit: int
    name: str
    fails: str


#: Bits are never given anew: a rule that goes leaves a gap.
RULES = (
    Rule(0, "too_few_words", "n_words < 20"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)"),
    Rule(3, "many_symbols", "10 * n_symbols > n_words"),
    Rule(4, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(5, "too_many_words", "n_words > 100000"),
)
#: Policies by version; "base" has the rules of the contract only.
POLICIES = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "word_length", "many_symbols", "repeated_lines"),
    "v2": tuple(r.name for r in RULES),
}
CURRENT = "v1"


def mask(names: tuple[str, ...]) -> int:
    found = {r.name: 1 << r.bit for r in RULES}
    return sum(found[n] for n in names)


def n_repeat_words(words: Column, n_words: Column, window: int = WINDOW) -> Column:
    """How many words stand in windows found twice or more in the array, the first one included."""
    digests = F.transform(F.sequence(F.lit(1), n_words - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))

    def covered(found: Column) -> Column:
        # Digest and place, sorted: a window is repeated if a neighbour has its digest.
        pairs = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            again = F.filter(
                p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"])
            )
            return F.array_sort(F.transform(again, lambda x: x["i"]))

        # Each repeated window adds the words between its start, or the end of the one before, and its end.
        def total(at: Column) -> Column:
            return F.aggregate(
                F.transform(at, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - x, F.lit(window)))),
                F.lit(0).cast("long"),
                lambda acc, x: acc + x,
            )

        return let(let(pairs, places), total)

    return F.when(n_words < window + 1, F.lit(0).cast("long")).otherwise(
        let(
            digests,
            lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(
                covered(found)
            ),
        )
    )


def measure(docs: DataFrame) -> DataFrame:
    """The ledger: doc_id, measurements and failed_bits; see RULES."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(F.col("doc_id").cast("long"), text.alias("text"), plain_words(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    counted = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("lines"),
        n_repeat_words(F.col("words"), F.size("words")).alias("n_repeat_words"),
    ).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.col("lines.n") - F.col("lines.d")).cast("long").alias("n_dup_lines"),
        F.col("lines.n").cast("long").alias("n_lines"),
        "n_repeat_words",
    )
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.withColumn("failed_bits", bits)


def judge(ledger: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with base_failed, and kept under the policy of that version."""
    failed = F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES["base"])).cast("long")) != 0
    wanted = F.lit(mask(POLICIES["base"]) | mask(POLICIES[version])).cast("long")
    return ledger.select(
        "*",
        failed.alias("base_failed"),
        (F.col("failed_bits").bitwiseAND(wanted) == 0).alias("kept"),
        F.lit(version).alias("policy"),
    )


def ablation(ledger: DataFrame, version: str = CURRENT) -> DataFrame:
    """One row per rule of the policy: documents that fail it, that fail it alone, and that stay without it."""
    names = POLICIES[version]
    everything = mask(names)
    # The ledger shrinks to one row per pattern of bits before anything else is counted.
    patterns = ledger.groupBy(F.col("failed_bits").bitwiseAND(F.lit(everything).cast("long")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n")
    )
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in names]))
    return (
        patterns.select("bits", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


#: DuckDB, for the rows of judge(measure(documents)).
ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: NOT regexp_full_match(l, '[\x20\x09-\x0D]*')) AS lines,
         row_number() OVER () AS rid
  FROM documents
), grams AS (
  SELECT rid, i, array_to_string(words[i:i+7], ' ') AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM t WHERE len(words) >= 9)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1
), hit AS (
  SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (
    SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM again) GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN hit USING (rid)
), b AS (
  SELECT *, CAST((CASE WHEN n_words < 20 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words) THEN 4 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 8 ELSE 0 END)
    + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 16 ELSE 0 END)
    + (CASE WHEN n_words > 100000 THEN 32 ELSE 0 END) AS BIGINT) AS failed_bits FROM m
)
SELECT *, (failed_bits & 3) <> 0 AS base_failed, (failed_bits & 31) = 0 AS kept, 'v1' AS policy FROM b
"""

#: DuckDB, for the rows of ablation(measure(documents), "v2").
ABLATION_SQL = f"""
WITH ledger AS ({ORACLE_SQL}), r AS (SELECT * FROM (VALUES {", ".join(f"('{r.name}', {1 << r.bit})" for r in RULES)}) AS t(rule, bit))
SELECT rule, count(*) FILTER (failed_bits & bit <> 0) AS n_failed, count(*) FILTER (failed_bits = bit) AS n_failed_alone,
       count(*) FILTER (failed_bits & ~bit = 0) AS n_kept_without
FROM ledger, r GROUP BY rule
"""
