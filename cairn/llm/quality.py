"""Quality rules as a short-circuit cascade, in built-in functions only.

Each rule names the steps (counts made from a row's text) that it needs and its verdict on them. On a bounded
sample every rule is timed, which gives its cost, and its share of rejected rows, which gives its selectivity.
The rules then apply in falling order of rejections per cost. In `keep_good` a step is made only for rows that
no earlier rule has rejected, so most rejected rows never reach the dear steps; `judge` gives all counts of
all rows, so there the order saves the later verdicts alone. The order changes the cost and no result: a row
is kept if no rule rejects it.

The sample is the first rows of a thinned run over the first partitions. One task reads them and stops, so
its cost doesn't grow with the table.

Defined cases: a null or blank text has no words and fails the base rule. Repeated rows are judged alike, texts
of any length whole. An empty table gives an empty result. Columns that a caller adds pass through; the columns
that `judge` makes replace columns of the same names, `keep_good` makes none.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, free_prefix, words

# Fixed values of the base rule.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Rows of the sample on which costs and selectivities are estimated, and the share of rows that it takes on its
#: way; the only bounded sample here.
SAMPLE_ROWS = 1000
SAMPLE_SHARE = 0.2
#: No cost is taken to be under LEAST_COST seconds.
LEAST_COST = 0.002

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Gives the column of a step, or of the text for "text".
Get = Callable[[str], Column]


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _of_marks(text: Column, marks: str) -> Column:
    """How often the characters of marks stand in text; a plain search for each is far faster than a translation."""
    out = F.length(text) * len(marks)
    for mark in marks:
        out = out - F.length(F.replace(text, F.lit(mark), F.lit("")))
    return out


def _window(c: Get, i: Column) -> Column:
    return F.xxhash64(F.get(c("words"), i), F.get(c("words"), i + 1), F.get(c("words"), i + 2))


def _places(c: Get) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size(c("words")) - 3, F.lit(0)))


def _repeated(c: Get) -> Column:
    """Ascending places of windows whose hash stands at another place too."""
    same = lambda x, i: F.coalesce(x["h"] == F.get(c("sorted"), i)["h"], F.lit(False))
    return F.when(c("sorted").isNotNull(), F.sort_array(F.transform(F.filter(c("sorted"), lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"])))


def _covered(c: Get) -> Column:
    """Words in windows at the places of "repeated", each counted once."""
    steps = F.transform(c("repeated"), lambda p, i: F.least(F.lit(3), F.coalesce(F.get(c("repeated"), i + 1) - p, F.lit(3))))
    return F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")), F.lit(0).cast("long"))


#: The steps in an order in which each stands behind those that it needs. A window of three words is held as a
#: 64-bit hash; places are looked for only in rows with equal hashes.
STEPS: dict[str, tuple[tuple[str, ...], Callable[[Get], Column]]] = {
    "words": ((), lambda c: words(c("text"))),
    "n_words": (("words",), lambda c: F.size(c("words")).cast("long")),
    "word_chars": (("words",), lambda c: F.length(F.array_join(c("words"), "")).cast("long")),
    "n_symbols": ((), lambda c: _of_marks(c("text"), SYMBOLS).cast("long")),
    "lines": ((), lambda c: F.filter(F.split(c("text"), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")),
    "n_dup_lines": (("lines",), lambda c: (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long")),
    "hashes": (("words",), lambda c: F.when(F.size(c("words")) > 3, F.transform(_places(c), lambda i: _window(c, i)))),
    "sorted": (("words", "hashes"), lambda c: F.when(F.size(F.array_distinct(c("hashes"))) < F.size(c("hashes")), F.sort_array(F.transform(c("hashes"), lambda h, i: F.struct(h.alias("h"), i.alias("p")))))),
    "repeated": (("sorted",), _repeated),
    "n_repeat_words": (("repeated",), _covered),
    "letters": ((), lambda c: _count(c("text"), r"\p{L}+")),
    "capitals": ((), lambda c: _count(c("text"), r"\p{Lu}+")),
}


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Get], Column]


BASE: tuple[Rule, ...] = (
    Rule("few_words", ("n_words",), lambda c: c("n_words") < MIN_WORDS),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda c: c("n_repeat_words") * 100 > c("n_words") * MAX_REPEAT_PERCENT),
)
RULES: tuple[Rule, ...] = (
    Rule("symbols", ("n_words", "n_symbols"), lambda c: c("n_symbols") * 10 > c("n_words")),
    Rule("word_length", ("n_words", "word_chars"), lambda c: (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 16 * c("n_words"))),
    Rule("repeated_lines", ("n_dup_lines",), lambda c: c("n_dup_lines") * 2 > _of_marks(c("text"), "\n") + 1),
    Rule("exclamations", ("n_words",), lambda c: _of_marks(c("text"), "!") * 5 > c("n_words")),
    Rule("capitals", ("letters", "capitals"), lambda c: c("capitals") * 2 > c("letters")),
    Rule("letters", ("letters", "word_chars"), lambda c: c("letters") * 2 < c("word_chars")),
)


def with_needs(names: Sequence[str]) -> list[str]:
    """The steps of names and all that they need, in the order of STEPS."""
    wanted = set(names)
    for name in reversed(STEPS):
        if name in wanted:
            wanted.update(STEPS[name][0])
    return [name for name in STEPS if name in wanted]


def _whole(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def _getter(text: str, prefix: str) -> Get:
    return lambda name: _whole(text) if name == "text" else F.col(prefix + name)


def _settled() -> Column:
    """True, but not for the optimizer: a filter over a column with it stays above, where the column is made once."""
    return F.spark_partition_id() >= 0


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the five counts of FEATURES."""
    prefix = free_prefix(docs)
    get = _getter(text, prefix)
    df = docs.drop(*[f for f in FEATURES if f != text])
    for name in with_needs(FEATURES):
        df = df.withColumn(prefix + name, STEPS[name][1](get))
    df = df.withColumns({name: F.when(_settled(), F.col(prefix + name)) for name in FEATURES})
    return df.drop(*[prefix + name for name in STEPS])


def base_failed() -> Column:
    get = F.col
    return BASE[0].rejects(get) | BASE[1].rejects(get)


def order_rules(docs: DataFrame, rules: Sequence[Rule] = (*BASE, *RULES), text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """The rules with cost (seconds on the sample) and rejection rate, in the order in which the cascade applies them.

    The time of reading and counting words is taken off, as it comes first in any order. One row for each
    rule comes to the driver.
    """
    with Scratch(docs.sparkSession) as tables:
        some = docs.select(_whole(text).alias("text")).sample(SAMPLE_SHARE, seed=7).coalesce(1).limit(sample_rows)
        # In one partition: a plan without exchange runs anew each time, so that a second run can be timed.
        some = tables.cut(some, "rule-sample").coalesce(1)
        get = _getter("text", "_")

        def made(names: Sequence[str], result: Column) -> DataFrame:
            df = some
            for name in with_needs(("n_words", *names)):
                df = df.withColumn(f"_{name}", STEPS[name][1](get))
            return df.agg(F.avg(result).alias("rate"), F.sum("_n_words"))

        # A first run compiles the plan and gives the rate, a second one is timed.
        tried = [made((), F.lit(0.0)), *[made(rule.needs, rule.rejects(get).cast("double")) for rule in rules]]
        rates = [df.collect()[0]["rate"] or 0.0 for df in tried]
        took = []
        for df in tried:
            began = time.perf_counter()
            df.collect()
            took.append(time.perf_counter() - began)
    found = [(rule, max(seconds - took[0], LEAST_COST), rate) for rule, seconds, rate in zip(rules, took[1:], rates[1:])]
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def _cascade(df: DataFrame, order: Sequence[Rule], get: Get, prefix: str, there: set[str], alive: Column) -> tuple[DataFrame, Column]:
    """df with the steps of rules that aren't there, each made for rows alone that are still alive, and what lives in the end."""
    for k, rule in enumerate(order):
        for name in with_needs(rule.needs):
            if name not in there:
                df = df.withColumn(prefix + name, F.when(alive, STEPS[name][1](get)))
                there.add(name)
        df = df.withColumn(f"{prefix}alive{k}", F.coalesce(F.when(alive, ~rule.rejects(get)), F.lit(False)))
        alive = F.col(f"{prefix}alive{k}")
    return df, alive


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", order: Sequence[Rule] | None = None) -> DataFrame:
    """docs with the features, base_failed and kept."""
    order = [x[0] for x in order_rules(docs, rules, text)] if order is None else order
    df = features(docs.drop(*[c for c in ("base_failed", "kept") if c != text]), text).withColumn("base_failed", base_failed())
    prefix = free_prefix(df)
    own = _getter(text, prefix)
    df, alive = _cascade(df, order, lambda name: F.col(name) if name in FEATURES else own(name), prefix, set(FEATURES), ~F.col("base_failed"))
    return df.withColumn("kept", alive).drop(*[c for c in df.columns if c.startswith(prefix)])


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, order: Sequence[Rule] | None = None) -> DataFrame:
    """The rows of docs that no rule rejects, with the columns of docs."""
    order = [x[0] for x in order_rules(docs, (*BASE, *rules), text)] if order is None else order
    prefix = free_prefix(docs)
    df, alive = _cascade(docs, order, _getter(text, prefix), prefix, set(), F.lit(True))
    return df.withColumn(f"{prefix}kept", alive & _settled()).where(F.col(f"{prefix}kept")).select(*[f"`{c}`" for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
tri AS (
  SELECT rid, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)),
twice AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS n FROM tri) WHERE n >= 2),
hit AS (SELECT rid, count(DISTINCT p + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
line AS (
  SELECT rid, count(*) - count(DISTINCT x) AS n
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
f AS (
  SELECT d.rid, doc_id, t, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(line.n, 0)::BIGINT AS n_dup_lines, coalesce(hit.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN line USING (rid) LEFT JOIN hit USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')) AS capitals,
         length(t) - length(regexp_replace(t, '\p{L}+', '', 'g')) AS letters FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words
            OR word_chars < 2 * n_words OR word_chars > 16 * n_words
            OR n_dup_lines * 2 > length(t) - length(replace(t, chr(10), '')) + 1
            OR (length(t) - length(replace(t, '!', ''))) * 5 > n_words
            OR capitals * 2 > letters OR letters * 2 < word_chars) AS kept
FROM b
"""
