"""Line dedup by distinct-site spread.

Each line (trimmed; blank ones apart) gets a HyperLogLog sketch of the sites it stands on. Sketches of a
line merge by aggregation, so a line on a third of all pages costs a shuffle row per task, not per
occurrence. Lines whose estimate is near the threshold get an exact count of distinct sites. A line on
min_sites sites or more is boilerplate: its first occurrence (least document, then least position) stays,
the others are cut from their documents. Passages of LONG_WORDS words and more don't recur by chance: their
threshold is long_sites, if that is given.

Defined cases: a null text stays null and an empty one empty; a null site is a site of its own. Documents
stay even when all their lines go (their text is then empty). Rows that repeat a doc_id are told apart by
their text; rows equal in both share one fate. Equal first occurrences all stay. Columns that a caller
adds pass through, whatever their names; n_lines and n_removed replace columns of those names, `cleaned` makes
none. An empty table stays empty. Texts and lines are read whole. A line's hash has 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, free_name, words

MIN_SITES = 10
#: Lines of so many words count as passages; op1 takes LONG_SITES as their threshold. The pipeline doesn't: it
#: would cut most of the text from copies of whole documents before near-duplicates are looked for.
LONG_WORDS = 50
LONG_SITES = 3
#: 2^LG_K registers; estimates within NEAR of the threshold, as a share of it, are counted exactly.
LG_K = 10
NEAR = 0.2


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))


def line_rows(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """A row per line that isn't blank: doc, mark (the text's hash), pos, line (a hash), long, site (a hash)."""
    base = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("mark"), F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit("null"))).alias("site"), F.posexplode(_lines(F.col(text))).alias("pos", "x"))
    # A line of LONG_WORDS words has twice their number of characters, less one: shorter ones aren't split.
    long = (F.length("x") >= 2 * LONG_WORDS - 1) & (F.size(words(F.col("x"))) >= LONG_WORDS)
    return base.where("x <> ''").select("doc", "mark", "pos", F.xxhash64("x").alias("line"), long.alias("long"), "site")


def spread_lines(rows: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR, long_sites: int | None = None) -> DataFrame:
    """The lines on at least min_sites sites (long_sites for long ones): line, first (the place that stays)."""
    place = F.struct("doc", "mark", "pos")
    needed = F.when(F.col("long"), F.lit(min_sites if long_sites is None else long_sites)).otherwise(F.lit(min_sites))
    sketches = rows.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(place).alias("first"), F.max("long").alias("long"))
    judged = sketches.select("line", "first", needed.alias("needed"), F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= F.col("needed") * (1 - near))
    judged = cut(judged, "line-spread")
    sure = F.col("sites") > F.col("needed") * (1 + near)
    unsure = judged.where(~sure)
    exact = rows.join(unsure.select("line", "needed"), "line").groupBy("line", "needed").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= F.col("needed")).select("line")
    return judged.where(sure).select("line", "first").unionByName(unsure.select("line", "first").join(exact, "line", "left_semi"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, long_sites: int | None = LONG_SITES) -> DataFrame:
    """docs with boilerplate lines cut from text, and n_lines and n_removed (of lines that aren't blank)."""
    return _cut_lines(docs, doc_id, text, site, min_sites, long_sites, "n_lines", "n_removed")


def _cut_lines(docs: DataFrame, doc_id: str, text: str, site: str, min_sites: int, long_sites: int | None, lines_name: str, removed_name: str) -> DataFrame:
    rows = cut(line_rows(docs, doc_id, text, site), "lines")
    common = cut(spread_lines(rows, min_sites, long_sites=long_sites), "boilerplate")
    here = F.struct("doc", "mark", "pos")
    hits = rows.join(common, "line").where(here != F.col("first")).select("doc", "mark", "pos").distinct()
    hits = hits.groupBy("doc", "mark").agg(F.collect_list("pos").alias("gone"))
    names = {n: free_name(docs, n) for n in ("_doc", "_mark", "_gone", "_lines")}
    hits = hits.select(F.col("doc").alias(names["_doc"]), F.col("mark").alias(names["_mark"]), F.col("gone").alias(names["_gone"]))
    joined = docs.join(hits, F.col(doc_id).eqNullSafe(F.col(names["_doc"])) & (F.xxhash64(text) == F.col(names["_mark"])), "left")
    gone = F.col(names["_gone"])
    lines = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col(names["_lines"]), i)), "\n")
    joined = joined.withColumn(names["_lines"], F.when(gone.isNotNull(), lines))
    n_lines = F.size(F.filter(_lines(F.coalesce(F.col(text), F.lit(""))), lambda x: x != ""))
    out = {text: F.when(gone.isNull(), F.col(text)).otherwise(kept), lines_name: n_lines.cast("long"), removed_name: F.coalesce(F.size(gone), F.lit(0)).cast("long")}
    return joined.withColumns(out).drop(*names.values())


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, long_sites: int | None = None, length: str | None = None) -> DataFrame:
    """docs with the columns they have and boilerplate cut from text; length names a column of text lengths."""
    removed = free_name(docs, "_n_removed")
    out = _cut_lines(docs, doc_id, text, site, min_sites, long_sites, free_name(docs, "_n_lines"), removed)
    if length in docs.columns:
        out = out.withColumn(length, F.when(F.col(removed) > 0, F.length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return out.select(*[f"`{c}`" for c in docs.columns])


def oracle(min_sites: int = MIN_SITES, long_sites: int | None = LONG_SITES) -> str:
    """The same as SQL."""
    return ORACLE.format(min_sites=min_sites, long_sites=min_sites if long_sites is None else long_sites, long_words=LONG_WORDS)


ORACLE = r"""
WITH l AS (
  SELECT doc_id, text, source, pos, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line, x
  FROM (SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)),
b AS (
  SELECT line, min(doc_id) AS d FROM l WHERE line <> '' GROUP BY line
  HAVING count(DISTINCT coalesce('=' || source, 'null')) >= CASE WHEN len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {long_words} THEN {long_sites} ELSE {min_sites} END),
f AS (SELECT l.line, b.d, min(pos) AS p FROM l JOIN b ON l.line = b.line AND l.doc_id = b.d GROUP BY l.line, b.d),
m AS (SELECT l.*, f.line IS NOT NULL AND NOT (l.doc_id = f.d AND l.pos = f.p) AS gone FROM l LEFT JOIN f ON l.line = f.line)
SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
       count(*) FILTER (line <> '')::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed
FROM m GROUP BY doc_id
"""
