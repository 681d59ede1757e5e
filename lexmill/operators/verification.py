"""Checks of drafted answers: citations, numbers without evidence, the hard gate, the judge's policy, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions.text import let

#: The brackets of a citation, the signs between groups of digits, and the words after a number that make
#: it one to be proven.
OPEN, CLOSE = ("[", "【"), ("]", "】")
DECIMAL, GROUP = (".", ","), (".", ",", " ", "\t", "\n", "\x0b", "\f", "\r")
UNITS = ("%", "triệu", "nghìn", "ngàn", "tỷ", "đồng", "vnđ", "vnd", "ngày", "tháng", "năm", "giờ", "tuổi")
UNIT = f"^(?:%|(?:{'|'.join(u for u in UNITS if u != '%')}|phần\\s+trăm)(?![\\p{{L}}\\p{{N}}_]))"
MAX_CHUNKS = 5


def _parts(text: Column) -> Column:
    """struct(t, gap): the runs of digits that are words of their own, and what stands before, between and behind them."""
    # The digit stands first in the pattern, so that most places are passed over without a look behind.
    alone = "[0-9](?<![\\p{L}\\p{N}_][0-9])[0-9]*+(?![\\p{L}\\p{N}_])"
    return F.struct(F.regexp_extract_all(text, F.lit(alone), F.lit(0)).alias("t"), F.split(text, alone).alias("gap"))


def _bracketed(parts: Column) -> Column:
    """Of each run of digits, whether it is the number of a citation: nothing but brackets beside it."""
    gap = lambda i: F.get(parts["gap"], i)
    return F.transform(parts["t"], lambda x, i: F.right(gap(i), F.lit(1)).isin(*OPEN) & F.left(gap(i + 1), F.lit(1)).isin(*CLOSE))


def cited(text: Column) -> Column:
    """Numbers of citations in order, each once."""
    found = let(_parts(text), lambda p: let(_bracketed(p), lambda mark: F.filter(p["t"], lambda x, i: F.get(mark, i))))
    return F.when(text.isNotNull(), F.array_distinct(F.transform(found, lambda n: n.try_cast("int"))))


def _without_citations(text: Column) -> Column:
    def rest(parts: Column, mark: Column) -> Column:
        at = lambda i: F.coalesce(F.get(mark, i), F.lit(False))
        left = lambda g, i: F.when(at(i - 1), F.substr(g, F.lit(2))).otherwise(g)
        bare = F.transform(parts["gap"], lambda g, i: let(left(g, i), lambda x: F.when(at(i), F.left(x, F.length(x) - 1)).otherwise(x)))
        return F.array_join(F.zip_with(bare, F.transform(parts["t"], lambda x, i: F.when(at(i), "").otherwise(x)), lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")

    return F.when(text.rlike("[\\[【]"), let(_parts(text), lambda p: let(_bracketed(p), lambda mark: rest(p, mark)))).otherwise(text)


def citations(answers: DataFrame, contexts: DataFrame, key: str) -> DataFrame:
    """(key, n, pos, chunk_id, valid): one row per cited number; chunk_id where the context has that rank."""
    rows = answers.select(key, F.posexplode(cited(F.col("text"))).alias("pos", "n"))
    return rows.join(contexts.select(key, F.col("rank").alias("n"), "chunk_id"), [key, "n"], "left").withColumn("valid", F.col("chunk_id").isNotNull())


def n_invalid(text: Column, ranks: Column) -> Column:
    """How many of a text's cited numbers are no rank of its context (array of ranks; null: none)."""
    known = F.coalesce(ranks, F.array().cast("array<int>"))
    return F.coalesce(F.size(F.filter(cited(text), lambda n: n.isNull() | ~F.array_contains(known, n))), F.lit(0))


def _scanned(parts: Column) -> Column:
    """array of struct(value, bare, at): the numbers of a text, without separators, and the place of their last digits.

    A number of three digits or fewer goes on over groups of exactly three digits, one sign between each; any other goes
    on behind a point or comma once.
    """
    number = lambda value, bare, at, more: F.struct(value.alias("value"), bare.alias("bare"), at.alias("at"), more.alias("more"))
    none = number(F.lit(""), F.lit(""), F.lit(-9), F.lit("no"))

    def step(s: Column, x: Column) -> Column:
        # more: what a number may still take; "any" after its first digits, "group" after a group, "no" after a fraction.
        last = s["last"]
        grouped = (F.length(x["t"]) == 3) & x["sign"].isin(*GROUP) & ((last["more"] == "group") | ((last["more"] == "any") & (F.length(last["bare"]) <= 3)))
        fraction = (last["more"] == "any") & x["sign"].isin(*DECIMAL)
        longer = lambda more: number(F.concat(last["value"], x["sign"], x["t"]), F.concat(last["bare"], x["t"]), x["at"], F.lit(more))
        done = lambda value: F.struct(value.alias("last"), s["found"].alias("found"))
        begun = F.struct(number(x["t"], x["t"], x["at"], F.lit("any")).alias("last"), F.when(last["at"] >= 0, F.concat(s["found"], F.array(last))).otherwise(s["found"]).alias("found"))
        return F.when(grouped, done(longer("group"))).when(fraction, done(longer("no"))).otherwise(begun)

    start = F.struct(none.alias("last"), F.filter(F.array(none), lambda x: F.lit(False)).alias("found"))
    close = lambda s: F.when(s["last"]["at"] >= 0, F.concat(s["found"], F.array(s["last"]))).otherwise(s["found"])
    marked = F.transform(parts["t"], lambda x, i: F.struct(x.alias("t"), i.alias("at"), F.when(i > 0, F.get(parts["gap"], i)).otherwise("").alias("sign")))
    # Most texts have no two runs of digits with one sign between, and need no fold.
    plain = F.transform(parts["t"], lambda x, i: number(x, x, i, F.lit("any")))
    return F.when(F.exists(parts["gap"], lambda g: g.isin(*GROUP)), F.aggregate(marked, start, step, close)).otherwise(plain)


def numbers(text: Column) -> Column:
    """Numbers of a text without their separators, each once."""
    return F.when(text.isNotNull(), F.array_distinct(F.transform(let(_parts(text), _scanned), lambda x: x["bare"])))


def unverified(answer: Column, evidence: Column) -> Column:
    """array of struct(value, sensitive): numbers of the answer that no evidence text has, first places only; one digit
    with a stop after it marks a list and is passed over unless a unit follows.

    evidence: array of texts, the question among them.
    """
    # One scan of all texts: no number goes on over the sign between them.
    known = numbers(F.array_join(F.coalesce(evidence, F.array().cast("array<string>")), "\u0001"))
    plain = _without_citations(answer)

    def judged(text: Column) -> Column:
        """The numbers with what stands behind them: a unit, blanks before it or none, or a stop."""

        def behind(parts: Column, x: Column) -> Column:
            rest = F.get(parts["gap"], x["at"] + 1)
            unit = F.lower(F.ltrim(rest, F.lit("".join(GROUP[2:])))).rlike(UNIT)
            return F.struct(x["bare"].alias("bare"), x["value"].alias("value"), unit.alias("sensitive"), rest.startswith(".").alias("stopped"))

        return let(_parts(text), lambda p: F.transform(_scanned(p), lambda x: behind(p, x)))

    fresh = let(known, lambda k: F.filter(let(plain, judged), lambda v: ~F.array_contains(k, v["bare"])))

    def first(found: Column) -> Column:
        return let(
            F.transform(found, lambda v: v["bare"]), lambda names: F.filter(found, lambda v, i: F.array_position(names, v["bare"]) == i + 1)
        )

    listed = lambda v: ~v["sensitive"] & (F.length(v["value"]) == 1) & v["stopped"]
    return F.transform(F.filter(let(fresh, first), lambda v: ~listed(v)), lambda v: F.struct(v["value"], v["sensitive"]))


def hard_issues(finish: Column, n_invalid: Column, loose: Column) -> Column:
    """Codes that stop an answer: cut off, citations out of range, numbers to be proven that are not."""
    sensitive = F.size(F.filter(loose, lambda v: v["sensitive"])) > 0
    return F.array_compact(
        F.array(
            F.when(finish == "length", F.lit("truncated")),
            F.when(n_invalid > 0, F.lit("invalid_citation")),
            F.when(sensitive, F.lit("unverified_sensitive_number")),
        )
    )


def judge_consistent(verdict: Column, n_issues: Column, evidence: Column, n_chunks: Column) -> Column:
    """Whether a verdict agrees with its issues, and names evidence that exists."""
    agrees = F.when(verdict == "pass", n_issues == 0).when(verdict.isin("repair", "insufficient_evidence"), n_issues > 0).otherwise(F.lit(False))
    return agrees & ~F.exists(F.coalesce(evidence, F.array().cast("array<int>")), lambda n: (n < 1) | (n > n_chunks))


def outcome(gate0: Column, judge0: Column, gate1: Column, judge1: Column) -> Column:
    """Where an answer ends up after at most one repair: gates are whether hard issues were found (null: no draft),
    judges are consistent verdicts (null: failed, which refuses)."""
    repair = gate0 | (judge0 == "repair")
    after = (
        F.when(gate1.isNull(), "error")
        .when(gate1, "unable_to_verify")
        .when(judge1.isNull(), "unable_to_verify")
        .when(judge1 == "pass", "answered")
        .when(judge1 == "insufficient_evidence", "insufficient_evidence")
        .otherwise("unable_to_verify")
    )
    return (
        F.when(gate0.isNull(), "error")
        .when(~gate0 & judge0.isNull(), "unable_to_verify")
        .when(~gate0 & (judge0 == "pass"), "answered")
        .when(~gate0 & (judge0 == "insufficient_evidence"), "insufficient_evidence")
        .when(repair, after)
        .otherwise("unable_to_verify")
    )


def context_text(chunks: DataFrame, key: str) -> DataFrame:
    """(key, context): chunks as [rank] breadcrumb and content, five of them in the order 1, 2, 5, 3, 4; more raise."""
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    order = F.when(n == MAX_CHUNKS, F.element_at(F.array(*[F.lit(k) for k in (1, 2, 4, 5, 3)]), F.col("rank"))).otherwise(F.col("rank"))
    order = F.when(n > MAX_CHUNKS, F.raise_error(F.lit("too many chunks")).cast("int")).otherwise(order)
    table = F.when(F.col("raw_table").isNotNull(), F.concat(F.lit("\nBảng gốc (markdown):\n"), "raw_table")).otherwise("")
    body = F.concat(F.lit("["), "rank", F.lit("] "), "breadcrumb", F.lit("\n"), "content", table)
    ordered = F.array_sort(F.collect_list(F.struct("o", "t")))
    return chunks.withColumn("o", order).withColumn("t", body).groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("context"))


def normalize_fragments(fragments: DataFrame, key: str) -> DataFrame:
    """Fragments (key, seq, text) with ASCII brackets and a blank before each that touches a word, over edges too."""
    ascii_ = F.translate("text", "【】", "[]")
    before = F.last(F.when(F.col("text") != "", F.right(ascii_, F.lit(1))), ignorenulls=True).over(W.partitionBy(key).orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    rows = fragments.withColumn("before", before).withColumn("t", ascii_)
    joined = F.when(F.col("t").startswith("[") & F.col("before").rlike("[^ \\n\\t\\[\\]]"), F.concat(F.lit(" "), "t")).otherwise(F.col("t"))
    return rows.select(key, "seq", F.regexp_replace(joined, "(?<=[^\\s\\[\\]])\\[", " [").alias("text"))


def strip_valid(text: Column, valid: Column) -> Column:
    """The text without citations of the given numbers; others stay."""
    return F.aggregate(valid, text, lambda t, n: F.regexp_replace(t, F.concat(F.lit("\\[0*"), n.cast("string"), F.lit("\\]")), F.lit("")))


#: Requests that are clearly no research, how such begin, and marks of a question.
NOT_RESEARCH = [
    "xin chào", "chào", "chào bạn", "hello", "hi", "cảm ơn", "tạm biệt", "bye", "viết code", "lập trình", "sáng tác",
    "kể chuyện", "dịch", "hãy dịch", "vui lòng dịch",
]
NOT_RESEARCH_BEGIN = [
    "viết code", "lập trình", "sáng tác", "viết thơ", "làm thơ", "kể chuyện", "viết truyện", "dịch câu ", "dịch đoạn ",
    "dịch văn bản ", "dịch sang ", "translate ",
]
CREATE_BEGIN = [
    "hãy viết code", "vui lòng viết code", "bạn có thể viết code", "hãy lập trình", "vui lòng lập trình",
    "bạn có thể lập trình", "hãy sáng tác", "vui lòng sáng tác", "bạn có thể sáng tác", "hãy dịch ", "vui lòng dịch ",
    "bạn có thể dịch ",
]
QUESTION_MARKS = [
    "?", "là gì", "là sao", "như thế nào", "ra sao", "bao nhiêu", "khi nào", "ở đâu", "tại sao", "vì sao", "có phải",
    "có được", "có cần", "được không", "hay không", " nào",
]


def clearly_not_research(query: Column) -> Column:
    low = F.trim(F.lower(query))
    bare = F.rtrim(low, F.lit("!?. "))
    begins = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: bare.startswith(w))
    asks = F.exists(F.array(*[F.lit(w) for w in QUESTION_MARKS]), lambda w: F.contains(low, w))
    return bare.isin(NOT_RESEARCH) | begins(CREATE_BEGIN) | (~asks & begins(NOT_RESEARCH_BEGIN))


def scope(verdict: Column, query: Column) -> Column:
    """The input verdict: a failed check allows, and out of scope stands only for what is clearly no research."""
    return F.when(verdict.isNull(), "allow").when((verdict == "out_of_scope") & ~clearly_not_research(query), "allow").otherwise(verdict)


def rate_limited(errors: Column) -> Column:
    """Whether any error of a chain (array of struct(status, retry_after)) is 429, and the first wait given."""
    hit = F.filter(errors, lambda e: e["status"] == 429)
    wait = F.get(F.filter(hit, lambda e: e["retry_after"].isNotNull()), F.lit(0))["retry_after"]
    return F.struct((F.size(hit) > 0).alias("limited"), wait.alias("retry_after"))
