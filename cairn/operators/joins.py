"""Joins and lookups over node, edge and entity relations.

All take DataFrames and return DataFrames. Theta joins (suffix, prefix) explode the possible keys of one
side, so that they run as equality joins; nearest joins are windows over both sides in one order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import routes
from cairn.functions.coerce import relation_kind


def sorted_set(c: Column) -> Column:
    return F.array_sort(F.collect_set(c))


def dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Import and reference edges with their target looked up; external if it isn't a node."""
    kind = relation_kind(F.col("relation"))
    e = edges.withColumn("kind", kind).where(F.col("kind").isNotNull())
    n = nodes.select(F.col("id").alias("_n"), F.col("label").alias("_label"))
    out = e.join(n, F.col("target_id") == F.col("_n"), "left")
    return out.select(
        F.concat(F.lit("dep::"), "id").alias("id"), "source_id", F.col("_n").alias("target_id"), F.coalesce("_label", "target_id").alias("target_name"), "kind", F.col("_n").isNull().alias("external")
    )


def connected_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    n = nodes.select(F.col("id").alias("_n")).distinct()
    return edges.join(n, F.col("source_id") == F.col("_n"), "left_semi").join(n, F.col("target_id") == F.col("_n"), "left_semi")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select(F.col("id").alias("_n")).distinct()
    no_source = edges.join(n, F.col("source_id") == F.col("_n"), "left_anti")
    no_target = edges.join(n, F.col("target_id") == F.col("_n"), "left_anti").join(n, F.col("source_id") == F.col("_n"), "left_semi")
    return no_source.unionByName(no_target)


def keep_valid(owners: DataFrame, key: str, ids: str, valid: DataFrame, drop_self: bool = False) -> DataFrame:
    """owners with the array ids cut to members of valid (one column), sorted and distinct; never null."""
    v = valid.select(F.col(valid.columns[0]).alias("_m")).distinct()
    members = owners.select(key, F.explode(ids).alias("_m")).join(v, "_m", "left_semi")
    if drop_self:
        members = members.where(F.col("_m") != F.col(key))
    kept = members.groupBy(key).agg(sorted_set(F.col("_m")).alias("_kept"))
    return owners.join(kept, key, "left").withColumn(ids, F.coalesce("_kept", F.array().cast("array<string>"))).drop("_kept")


def keep_foreign(owners: DataFrame, column: str, valid: DataFrame) -> DataFrame:
    """owners with column set to null where it isn't in valid."""
    v = valid.select(F.col(valid.columns[0]).alias("_m")).distinct()
    return owners.join(v, F.col(column) == F.col("_m"), "left").withColumn(column, F.col("_m")).drop("_m")


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, left_id: str, right_id: str) -> DataFrame:
    """For each row of left the row of right with equal keys whose at is nearest; the least (at, id) wins ties.

    Both sides stand in one order of time per key, and each row of left takes the last row of right before it
    and the first behind it: a busy key is sorted, never paired with itself. Returns left_id, right_id and
    distance; rows without a partner are absent.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    named = lambda df: df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[c for c in ("_at", "_right", "_left") if c in df.columns])
    r = named(right.select("*", F.col(at).alias("_at"), F.col(right_id).alias("_right"))).where("_at IS NOT NULL").groupBy(*names, "_at").agg(F.min("_right").alias("_right"))
    l = named(left.select("*", F.col(at).alias("_at"), F.col(left_id).alias("_left"))).where("_at IS NOT NULL")  # noqa: E741
    both = r.withColumns({"_left": F.lit(None).cast(left.schema[left_id].dataType), "_side": F.lit(0)}).unionByName(l.withColumns({"_right": F.lit(None).cast(right.schema[right_id].dataType), "_side": F.lit(1)}))
    place = F.when(F.col("_side") == 0, F.struct(F.col("_at").alias("t"), F.col("_right").alias("r")))
    so_far = lambda order: F.last(place, ignorenulls=True).over(Window.partitionBy(*names).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumns({"_before": so_far(F.asc("_at")), "_behind": so_far(F.desc("_at"))}).where("_side = 1")
    far = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.t") - F.col("_at")).alias("d"), F.col(f"{c}.t").alias("t"), F.col(f"{c}.r").alias("r")))
    best = found.select(F.col("_left"), F.least(far("_before"), far("_behind")).alias("b")).where("b IS NOT NULL").groupBy("_left").agg(F.min("b").alias("b"))
    return best.select(F.col("_left").alias(left_id), F.col("b.r").alias(right_id if right_id != left_id else f"{right_id}_right"), F.col("b.d").alias("distance"))


def match_definitions(symbols: DataFrame, definitions: DataFrame) -> DataFrame:
    """(symbol id, ord of its definition): symbols have id, source_file, name, start_line; definitions ord, source_file, name, start_line.

    One definition of the name in the file is it. Of several, the nearest start wins, the earliest on ties;
    a symbol without a line then has none. Without any of the name, the first that starts on the very line.
    """
    d = definitions.select(F.col("source_file").alias("_f"), F.col("name").alias("_n"), F.col("start_line").alias("_l"), F.col("ord").alias("_o"))
    s = symbols.select("id", "source_file", "name", "start_line")
    named = s.join(d, (F.col("source_file") == F.col("_f")) & (F.col("name") == F.col("_n")))
    found = named.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct(F.abs(F.col("_l") - F.col("start_line")).alias("d"), F.col("_o").alias("o"))).alias("best"))
    by_name = found.where((F.col("n") == 1) | F.col("best.d").isNotNull()).select("id", F.col("best.o").alias("ord"))
    rest = s.join(found.select("id"), "id", "left_anti")
    by_line = rest.join(d, (F.col("source_file") == F.col("_f")) & (F.col("start_line") == F.col("_l"))).groupBy("id").agg(F.min("_o").alias("ord"))
    return by_name.unionByName(by_line)


def next_greater(rows: DataFrame, group: str, at: str, name: str = "next") -> DataFrame:
    """rows with the smallest value of at in the group that is strictly greater; null at the end."""
    w = Window.partitionBy(group).orderBy(at).rangeBetween(1, Window.unboundedFollowing)
    return rows.withColumn(name, F.min(at).over(w))


def suffix_join(paths: DataFrame, tails: DataFrame, path: str, tail: str) -> DataFrame:
    """Pairs of a path and its longest tails of whole segments (all columns of both, and length)."""
    open_ = paths.withColumn("_tail", F.explode(routes.suffixes(F.col(path))))
    both = open_.join(tails, F.col("_tail") == F.col(tail)).withColumn("length", F.size(routes.segments(F.col(tail))))
    best = Window.partitionBy(path)
    return both.withColumn("_most", F.max("length").over(best)).where("length = _most").drop("_most", "_tail")


def prefix_join(names: DataFrame, short: DataFrame, name: str, prefix: str) -> DataFrame:
    """Pairs of a name and a shorter name that it continues with an underscore."""
    return names.withColumn("_p", F.explode(routes.name_prefixes(F.col(name)))).join(short, F.col("_p") == F.col(prefix)).drop("_p")


def unique_match(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) where exactly one distinct value stands beside the key."""
    return pairs.groupBy(key).agg(F.count_distinct(value).alias("n"), F.min(value).alias(value)).where("n = 1").select(key, value)


def best_affinity(pairs: DataFrame, key: str, value: str, wanted: str, tokens: str) -> DataFrame:
    """(key, value) with the single largest overlap of the arrays wanted and tokens, if above none."""
    scored = pairs.select(key, value, F.size(F.array_intersect(wanted, tokens)).alias("score")).distinct().where("score > 0")
    top = Window.partitionBy(key)
    best = scored.withColumn("_top", F.max("score").over(top)).where("score = _top")
    return best.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias(value), F.max("score").alias("score")).where("n = 1").select(key, value, "score")


def module_adjacency(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(module, related): modules joined by an edge of their symbols, both ways; membership has id and module."""
    m = membership.select("id", "module")
    a = m.withColumnsRenamed({"id": "source_id", "module": "_a"})
    b = m.withColumnsRenamed({"id": "target_id", "module": "_b"})
    pairs = edges.select("source_id", "target_id").join(a, "source_id").join(b, "target_id").where("_a <> _b").select("_a", "_b").distinct()
    both = pairs.select(F.col("_a").alias("module"), F.col("_b").alias("related")).unionByName(pairs.select(F.col("_b").alias("module"), F.col("_a").alias("related")))
    return both.distinct()


def first_member_module(components: DataFrame, membership: DataFrame, key: str, members: str) -> DataFrame:
    """(key, module): the module of the first member, in array order, that has one."""
    rows = components.select(key, F.posexplode(members).alias("_pos", "_m")).join(membership.select(F.col("id").alias("_m"), "module"), "_m")
    return rows.groupBy(key).agg(F.min_by("module", F.struct("_pos", "module")).alias("module"))


def resolve_names(owners: DataFrame, key: str, ids: str, names: DataFrame) -> DataFrame:
    """(key, names): the sorted distinct names of an array of ids; names has id and name."""
    rows = owners.select(key, F.explode(ids).alias("_m")).join(names.select(F.col("id").alias("_m"), "name"), "_m")
    return rows.groupBy(key).agg(sorted_set(F.col("name")).alias("names"))


def attach_to_modules(modules: DataFrame, owners: DataFrame, key: str, members: str, membership: DataFrame, into: str) -> DataFrame:
    """modules with the keys of owners added to the array into, wherever a member is of the module."""
    rows = owners.select(F.col(key).alias("_k"), F.explode(members).alias("_m")).join(membership.select(F.col("id").alias("_m"), "module"), "_m")
    more = rows.groupBy(F.col("module").alias("id")).agg(F.collect_set("_k").alias("_more"))
    none = F.array().cast("array<string>")
    return modules.join(more, "id", "left").withColumn(into, F.array_sort(F.array_union(F.coalesce(into, none), F.coalesce("_more", none)))).drop("_more")


def attach_indexes(tables: DataFrame, indexes: DataFrame) -> DataFrame:
    """tables with the standalone indexes of their file and name (any case) behind their own."""
    i = indexes.groupBy(F.col("source_file").alias("_f"), F.lower("table").alias("_t")).agg(F.array_sort(F.collect_list(F.struct("ord", "index"))).alias("_i"))
    on = (F.col("source_file") == F.col("_f")) & (F.lower("name") == F.col("_t"))
    more = F.coalesce(F.transform("_i", lambda x: x["index"]), F.slice("indexes", 1, 0))
    return tables.join(i, on, "left").withColumn("indexes", F.concat("indexes", more)).drop("_f", "_t", "_i")


def module_files(modules: DataFrame, files: DataFrame, dotted: str = "module") -> DataFrame:
    """(dotted, path): a/b.py, else a/b/__init__.py, of the files (path) that exist."""
    m = modules.select(dotted).distinct().withColumn("_p", F.replace(dotted, F.lit("."), F.lit("/")))
    spelled = m.select(dotted, F.explode(F.array(F.struct(F.lit(0).alias("o"), F.concat("_p", F.lit(".py")).alias("path")), F.struct(F.lit(1).alias("o"), F.concat("_p", F.lit("/__init__.py")).alias("path")))).alias("s")).select(dotted, "s.o", "s.path")
    return spelled.join(files.select("path"), "path").groupBy(dotted).agg(F.min_by("path", "o").alias("path"))


def last_owner(owners: DataFrame, key: str, members: str, order: str) -> DataFrame:
    """(id, key): for each member the last owner by order."""
    return owners.select(key, order, F.explode(members).alias("id")).groupBy("id").agg(F.max_by(key, order).alias(key))


def base_classes(edges: DataFrame, order: str = "ord") -> DataFrame:
    """(id, bases): the targets of inherits edges in edge order."""
    e = edges.where("relation = 'inherits'").groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(order, "target_id"))).alias("_b"))
    return e.select("id", F.transform("_b", lambda b: b["target_id"]).alias("bases"))


def without(rows: DataFrame, key: str, others: DataFrame) -> DataFrame:
    """rows whose key isn't in others (one column)."""
    o = others.select(F.col(others.columns[0]).alias("_m")).distinct()
    return rows.join(o, F.col(key) == F.col("_m"), "left_anti")
