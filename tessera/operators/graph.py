"""Call graphs: resolution of calls, degrees, classes of nodes and the order to work in. Generic over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.scratch import Scratch


#: What of a reading (extract's only) the resolution of calls needs, and what a function's context does.
CALLS = ("functions.unique_fqn", "functions.fqn", "functions.name", "functions.call_details")
CONTEXT = (*CALLS, "functions.pos", "functions.signature", "functions.body", "types.pos", "types.fqn", "types.name", "types.kind", "types.source_code")


def normalized(name, display):
    """What a call is looked up by: the display if it is qualified, else the name."""
    return F.when(F.contains(display, F.lit("::")), display).otherwise(name)


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """file_id, src, display, dst: a row per candidate, dst null where the call is external.

    calls has file_id, src, name, display; functions file_id, unique_fqn, fqn, name. A call is matched against unique
    ids, then qualified names, then bare names; the first of these that knows the target decides, even if all it knows
    is the caller itself. One equi-join on (file, key) serves all three, and the lowest tier of each call is kept.
    """
    ids = functions.select("file_id", F.col("unique_fqn").alias("dst"), "fqn", "name").distinct()
    keys = ids.select("file_id", "dst", F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.col(c).alias("key")) for t, c in enumerate(("dst", "fqn", "name"))])).alias("k")).select("file_id", "dst", "k.tier", "k.key")
    asked = calls.select("file_id", "src", "display", normalized(F.col("name"), F.col("display")).alias("key")).distinct()
    found = asked.join(keys, ["file_id", "key"], "left")
    first = F.min("tier").over(Window.partitionBy("file_id", "src", "display", "key"))
    return found.withColumn("first", first).where(F.col("tier").eqNullSafe(F.col("first"))).select("file_id", "src", "display", "dst").distinct()


def _tagged(parsed: DataFrame) -> DataFrame:
    """file_id, key, known (tier, dst) or asked (src, display): what each function is looked up by, and what it looks up, of
    the nested functions of parsed rows. Both come of one pass, so no text is read twice."""
    f = parsed.select("file_id", F.explode("functions").alias("f")).select("file_id", F.col("f.unique_fqn").alias("id"), "f.fqn", "f.name", F.col("f.call_details").alias("calls"))
    known, asked = "struct<tier: int, dst: string>", "struct<src: string, display: string>"
    keys = [F.struct(F.col(c).alias("key"), F.struct(F.lit(t).alias("tier"), F.col("id").alias("dst")).alias("known"), F.lit(None).cast(asked).alias("asked")) for t, c in enumerate(("id", "fqn", "name"))]
    calls = F.transform("calls", lambda c: F.struct(normalized(c["name"], c["display"]).alias("key"), F.lit(None).cast(known).alias("known"), F.struct(F.col("id").alias("src"), c["display"].alias("display")).alias("asked")))
    return f.select("file_id", F.explode(F.concat(F.array(*keys), calls)).alias("x")).select("file_id", "x.*")


def _met(parsed: DataFrame) -> DataFrame:
    """file_id, known, first (the targets of the lowest tier), asked, a row for each key of a file."""
    g = _tagged(parsed).groupBy("file_id", "key").agg(F.collect_set("known").alias("known"), F.collect_set("asked").alias("asked"))
    least = F.array_min(F.transform("known", lambda x: x.tier))
    return g.select("file_id", "known", F.transform(F.filter("known", lambda x: x.tier == least), lambda x: x.dst).alias("first"), "asked")


def resolved_calls(parsed: DataFrame) -> DataFrame:
    """As resolve_calls, of parsed rows with their nested functions, which are read once."""
    return _met(parsed).select("file_id", F.explode("asked").alias("a"), "first").select("file_id", "a.src", "a.display", F.explode_outer("first").alias("dst")).distinct()


def call_degrees(parsed: DataFrame) -> DataFrame:
    """As degrees of the functions and edges of parsed rows, which are read once."""
    pairs = F.flatten(F.transform("asked", lambda a: F.transform(F.filter("first", lambda d: d != a.src), lambda d: F.struct(a.src.alias("src"), d.alias("dst")))))
    # A function by itself is a row without a source.
    alone = F.transform(F.filter("known", lambda x: x.tier == 0), lambda x: F.struct(F.lit(None).cast("string").alias("src"), x.dst.alias("dst")))
    rows = _met(parsed).select("file_id", F.explode(F.concat(pairs, alone)).alias("x")).select("file_id", "x.src", "x.dst").distinct()
    one = lambda i, o, c: F.struct(F.col(c).alias("id"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    ends = rows.select("file_id", F.explode(F.when(F.col("src").isNull(), F.array(one(0, 0, "dst"))).otherwise(F.array(one(0, 1, "src"), one(1, 0, "dst")))).alias("x")).select("file_id", "x.*")
    return _classes(ends.groupBy("file_id", "id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out")))


def edges(resolved: DataFrame) -> DataFrame:
    return resolved.where("dst is not null and dst <> src").select("file_id", "src", "dst").distinct()


def external_calls(resolved: DataFrame) -> DataFrame:
    return resolved.where("dst is null").select("file_id", "src", "display").distinct()


def degrees(nodes: DataFrame, edge_list: DataFrame, key: str = "file_id") -> DataFrame:
    """key, id, n_in, n_out, is_leaf, is_root, node_class of each node (key, id): distinct callers and callees."""
    ends = edge_list.select(key, F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edge_list.select(key, F.col("dst").alias("id"), F.lit(0), F.lit(1)))
    d = nodes.select(key, "id").distinct().join(ends.groupBy(key, "id").agg(F.sum("i").alias("i"), F.sum("o").alias("o")), [key, "id"], "left")
    return _classes(d.select(key, "id", F.coalesce("i", F.lit(0)).alias("n_in"), F.coalesce("o", F.lit(0)).alias("n_out")))


def _classes(d: DataFrame) -> DataFrame:
    leaf, root = F.col("n_out") == 0, (F.col("n_in") >= 2) & (F.col("n_out") <= 1)
    return d.select("*", leaf.alias("is_leaf"), root.alias("is_root"), F.when(leaf, "leaf").when(root, "root").otherwise("middle").alias("node_class"))


def priority_order(d: DataFrame, key: str = "file_id") -> DataFrame:
    """With `position` from 1: leaves by (in, id), middles by (out, in descending, id), roots by (in descending, out, id)."""
    c, i, o = F.col("node_class"), F.col("n_in"), F.col("n_out")
    rank = F.when(c == "leaf", 0).when(c == "middle", 1).otherwise(2)
    one, two = F.when(c == "leaf", i).when(c == "middle", o).otherwise(-i), F.when(c == "leaf", F.lit(0)).when(c == "middle", -i).otherwise(o)
    return d.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(rank, one, two, "id")))


def last_records(functions: DataFrame) -> DataFrame:
    """Of equal ids the last record counts, at the place of the first; id_collision tells that there were several."""
    w = Window.partitionBy("file_id", "unique_fqn")
    return functions.withColumn("_last", F.row_number().over(w.orderBy(F.col("pos").desc()))).withColumn("first_pos", F.min("pos").over(w)).withColumn("id_collision", F.count("*").over(w) > 1).where("_last = 1").drop("_last")


def first_types(types: DataFrame) -> DataFrame:
    """The first definition of each name."""
    return types.withColumn("_n", F.row_number().over(Window.partitionBy("file_id", "fqn").orderBy("pos", "kind"))).where("_n = 1").drop("_n")


def function_map(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Function records with what the graph adds: internal_calls, external_calls, degrees, is_leaf, is_root."""
    r = resolve_calls(calls, functions)
    e = edges(r)
    inner = e.groupBy("file_id", F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("internal_calls"))
    outer = external_calls(r).groupBy("file_id", F.col("src").alias("id")).agg(F.array_sort(F.collect_set("display")).alias("external_calls"))
    d = degrees(functions.select("file_id", F.col("unique_fqn").alias("id")), e)
    none = F.array().cast("array<string>")
    out = last_records(functions).withColumnRenamed("unique_fqn", "id").join(d, ["file_id", "id"]).join(inner, ["file_id", "id"], "left").join(outer, ["file_id", "id"], "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("internal_calls", "external_calls")}).withColumnsRenamed({"id": "unique_fqn", "n_in": "incoming_calls_count", "n_out": "outgoing_calls_count"})


def function_context(functions: DataFrame, calls: DataFrame, types: DataFrame) -> DataFrame:
    """file_id, id, body, callee_signatures, type_sources: what a reader of one function needs. Types are those whose
    names are words of the body; the candidates are the words themselves, so this is an equi-join."""
    f = last_records(functions)
    e = edges(resolve_calls(calls, functions))
    sig = e.join(f.select("file_id", F.col("unique_fqn").alias("dst"), "signature"), ["file_id", "dst"]).groupBy("file_id", F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("dst", "signature"))).alias("callee_signatures"))
    words = f.select("file_id", F.col("unique_fqn").alias("id"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\w+"), F.lit(0)))).alias("name"))
    src = words.join(first_types(types).select("file_id", "name", "source_code"), ["file_id", "name"]).groupBy("file_id", "id").agg(F.array_sort(F.collect_set(F.struct("name", "source_code"))).alias("type_sources"))
    return f.select("file_id", F.col("unique_fqn").alias("id"), "body").join(sig, ["file_id", "id"], "left").join(src, ["file_id", "id"], "left")


def lookup_functions(functions: DataFrame, asked: DataFrame) -> DataFrame:
    """file_id, name, n, unique_fqn of each asked (file_id, name): an exact id, else a qualified name. n tells how many
    have it, and unique_fqn is null unless that is one."""
    f = last_records(functions).select("file_id", "unique_fqn", "fqn")
    keys = f.select("file_id", "unique_fqn", F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.col(c).alias("name")) for t, c in enumerate(("unique_fqn", "fqn"))])).alias("k")).select("file_id", "unique_fqn", "k.*")
    per = keys.join(asked.select("file_id", "name").distinct(), ["file_id", "name"], "left_semi").groupBy("file_id", "name", "tier").agg(F.count("*").alias("n"), F.min("unique_fqn").alias("unique_fqn"))
    first = per.groupBy("file_id", "name").agg(F.min_by(F.struct("n", "unique_fqn"), "tier").alias("x"))
    out = asked.select("file_id", "name").join(first, ["file_id", "name"], "left")
    n = F.coalesce("x.n", F.lit(0))
    return out.select("file_id", "name", n.alias("n"), F.when(n == 1, F.col("x.unique_fqn")).alias("unique_fqn"))


def lookup_function(functions: DataFrame, file_id: int, name: str) -> DataFrame:
    """The record of an exact id, else of a qualified name; a qualified name that several share is an error."""
    own = functions.where(F.col("file_id") == file_id)
    found = lookup_functions(own, own.sparkSession.createDataFrame([(file_id, name)], "file_id long, name string"))
    sure = F.when(F.col("n") > 1, F.raise_error(F.lit(f"{name} is ambiguous"))).otherwise(F.col("unique_fqn"))
    return last_records(own).join(found.select("file_id", sure.alias("unique_fqn")), ["file_id", "unique_fqn"], "left_semi")


def call_closure(edge_list: DataFrame) -> DataFrame:
    """Extension: file_id, src, dst of all transitive calls. Paths double in each round, so a chain of n calls takes
    log2(n) rounds; a round works on the pairs that the one before added, and ends when there are none."""
    scratch = Scratch(edge_list.sparkSession, "closure")
    new = known = scratch.write(edge_list.select("file_id", "src", "dst").distinct(), "0")
    k = 0
    while not new.isEmpty():
        k += 1
        ahead, behind = new.withColumnsRenamed({"src": "mid"}), new.withColumnsRenamed({"dst": "mid"})
        longer = behind.join(known.withColumnsRenamed({"src": "mid"}), ["file_id", "mid"]).union(ahead.join(known.withColumnsRenamed({"dst": "mid"}), ["file_id", "mid"]).select("file_id", "mid", "src", "dst"))
        step = longer.select("file_id", "src", "dst").distinct().join(known, ["file_id", "src", "dst"], "left_anti")
        new = scratch.write(step, str(k))
        known = known.unionByName(new)
    return known
