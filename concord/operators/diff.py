"""Document differences: two sides meet on the document key, and what isn't equal is compared by type.

Both sides are first made into documents: key (canonical text), canonical text with fields as they stand and
in order of their names, size, and the row or VARIANT itself or its fields (name, ordered and sorted canonical value, type). Each side may be filtered before; a document that
only one side's filter lets through is missing on the other.

Only key, two hashes and the size of each document are shuffled, once, for both sides together: an aggregation
counts equal documents of a key against each other, which also settles keys that repeat. What
it leaves over differs; the documents themselves are fetched for these keys alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions import canonical, filters, keys
from concord.functions.ordering import let
from concord.model import DST, MISMATCH, MISSING, SRC, Method

ORDER_ONLY = f"{MISMATCH} : only field order differs"


#: Column that holds a table's row: with nulls as values, or as fields that aren't there; and one that holds a document without a schema.
ROW, PRESENT, VARIANT = "row", "present", "variant"


def documents(df: DataFrame, key: Sequence[str], *, missing_if_null: bool = False, filter: str | dict | Column | None = None) -> DataFrame:
    """Documents of a table's rows. Keys may repeat."""
    if filter is not None:
        df = df.where(filters.condition(filter, df.schema))
    text = lambda by_name: canonical.row_text(df.schema, by_name, missing_if_null)
    made = df.select(keys.key_text(df, key).alias("key"), text(False).alias("ordered"), text(True).alias("sorted"), F.struct("*").alias(PRESENT if missing_if_null else ROW))
    return made.withColumn("size", F.octet_length("ordered"))


def sized(docs: DataFrame) -> DataFrame:
    """Documents of key and fields."""
    made = docs.select("key", canonical.ordered_text(F.col("fields")).alias("ordered"), canonical.sorted_text(F.col("fields")).alias("sorted"), "fields")
    return made.withColumn("size", F.octet_length("ordered"))


def variant_documents(df: DataFrame, key: Sequence[str], document: str, *, filter: str | dict | Column | None = None) -> DataFrame:
    """Documents without a schema: a VARIANT column holds each whole, with the fields and types it happens to have. key: paths within the document.

    A field that is null is there; one that is missing isn't. A VARIANT keeps no order of fields, so two that differ in it only are equal by every method.
    """
    if filter is not None:
        df = df.where(filters.condition(filter, df.schema))
    doc = F.col(f"`{document}`")
    text = F.concat(*(canonical.sorted_(F.try_variant_get(doc, f"$.{k}", "variant"), T.VariantType()) for k in key))
    made = df.select(text.alias("key"), canonical.variant_text(doc, False).alias("ordered"), canonical.variant_text(doc, True).alias("sorted"), doc.alias(VARIANT))
    return made.withColumn("size", F.octet_length("ordered"))


def occurring(df: DataFrame, document: str) -> DataFrame:
    """field, type, documents: which fields the documents of a VARIANT column have, by type."""
    each = df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(document).outer()))
    return each.groupBy(F.col("key").alias("field"), canonical.type_of(F.col("value"), T.VariantType()).alias("type")).agg(F.count(F.lit(1)).alias("documents"))


def _fields(docs: DataFrame) -> Column:
    for name in (ROW, PRESENT):
        if name in docs.columns:
            return canonical.fields_of(docs.schema[name].dataType, name == PRESENT, source=name)
    return canonical.fields_of_variant(F.col(VARIANT)) if VARIANT in docs.columns else F.col("fields")


def _again(docs: DataFrame, by_name: bool) -> Column:
    """Either text of a document, made anew of the document itself."""
    for name in (ROW, PRESENT):
        if name in docs.columns:
            return canonical.row_text(docs.schema[name].dataType, by_name, name == PRESENT, source=name)
    if VARIANT in docs.columns:
        return canonical.variant_text(F.col(VARIANT), by_name)
    return (canonical.sorted_text if by_name else canonical.ordered_text)(F.col("fields"))


def by_fields(docs: DataFrame) -> DataFrame:
    """The same documents by their fields: a union of tables with different schemas keeps each one's order and types only so."""
    return sized(docs.select("key", _fields(docs).alias("fields")))


def restricted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose key is in ids (column key): what a recheck reads."""
    return docs.join(ids.select("key").distinct(), "key", "left_semi")


def restricted_rows(df: DataFrame, ids: DataFrame, key: Sequence[str]) -> DataFrame | None:
    """The rows of a table whose key is in ids (column key: key texts), found by their plain key columns before anything is encoded.

    The least and greatest values asked for reach the scan, so files without them aren't read. None if the key's types don't allow it.
    """
    read = keys.raw(F.col("key"), df.schema, key)
    if read is None:
        return None
    values, fits = read
    names = [f"_raw{i}" for i in range(len(key))]
    wanted = ids.where(fits).select(*(v.alias(n) for v, n in zip(values, names, strict=True))).distinct()
    # A text that its value doesn't give again can't be looked for by the value.
    again = F.concat(*(canonical.sorted_(v, path_kind) for v, path_kind in zip(values, (keys.path(df.schema, k)[1] for k in key), strict=True)))
    exact = ids.where(fits).agg(F.count_if(~again.eqNullSafe(F.col("key"))).alias("n")).first()["n"] == 0
    if not exact:
        return None
    ends = wanted.agg(*(f(n).alias(f"{w}{n}") for n in names for w, f in (("lo", F.min), ("hi", F.max))), *(F.count_if(F.col(n).isNull()).alias(f"z{n}") for n in names)).first()
    for k, n in zip(key, names, strict=True):
        c, lo, hi = F.col(f"`{k}`"), ends[f"lo{n}"], ends[f"hi{n}"]
        inside = F.lit(False) if lo is None else c.between(F.lit(lo), F.lit(hi))
        df = df.where(inside | c.isNull() if ends[f"z{n}"] else inside)
    met = F.lit(True)
    for k, n in zip(key, names, strict=True):
        met = met & F.col(f"`{k}`").eqNullSafe(F.col(n))
    return df.join(wanted, met, "left_semi")


def _text_of(method: Method) -> Column:
    """What the method holds equal. Either text of a document has the same length."""
    return F.col("sorted" if method is Method.IGNORE_ORDER else "ordered")


def _digest(method: Method) -> tuple[Column, Column]:
    """Two hashes of what the method holds equal."""
    return F.xxhash64(_text_of(method)).alias("a"), F.xxhash64(F.lit("second"), _text_of(method)).alias("b")


#: A key with more copies left over than this, on both sides together, is dealt to tasks by parts of its digests and blocks of its line; both ways give the same rows.
DEALT = 1 << 16
#: Leading bits of a digest that a part shares, and of a place in line that are its block.
PART_BITS, BLOCK_BITS = 12, 16


def left_over(src: DataFrame, dst: DataFrame, method: Method, seen: Observation | None = None) -> DataFrame:
    """key, a, b, size, n: documents of a key that one side has n times more often than the other (less than 0: the destination)."""
    slim = lambda df, n: df.select("key", *_digest(method), F.octet_length(_text_of(method)).alias("size"), F.lit(n).cast("long").alias("n"))
    own = slim(src, 1)
    if seen is not None:
        own = own.observe(seen, F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return own.unionByName(slim(dst, -1)).groupBy("key", "a", "b", "size").agg(F.sum("n").alias("n")).where("n != 0")


def _stretches(placed: DataFrame, by: Sequence[str]) -> DataFrame:
    """key, s, d, n: n places in line at which the same two documents meet. placed: documents (x) of a side that stand at the places from at up to upto."""
    nothing = F.lit(None).cast(placed.schema["x"].dataType)
    marks = placed.select(*by, "from_src", F.explode(F.array(F.struct("at", "x"), F.struct(F.col("upto").alias("at"), nothing.alias("x")))).alias("m")).select(*by, "from_src", "m.at", "m.x")
    own = lambda side, value: F.max(F.when(F.col("from_src") == side, value))
    met = marks.groupBy(*by, "at").agg(own(True, F.col("x")).alias("sx"), own(True, F.lit(True)).alias("sm"), own(False, F.col("x")).alias("dx"), own(False, F.lit(True)).alias("dm"))
    line = Window.partitionBy(*by).orderBy("at")
    held = lambda mark, value: F.last(F.when(F.col(mark), F.struct(F.col(value).alias("v"))), ignorenulls=True).over(line)["v"]
    return met.select("key", held("sm", "sx").alias("s"), held("dm", "dx").alias("d"), (F.lead("at").over(line) - F.col("at")).alias("n")).where("n > 0")


def _dealt(runs: DataFrame) -> DataFrame:
    """The stretches of keys with any number of copies: no task has a whole line.

    Digests are hashes, so their leading bits cut a line into parts of like size. What stands before a part is summed over one row a part;
    then the line is cut at fixed places, and each block's documents meet by themselves.
    """
    part = ["key", "from_src", "part"]
    cut = runs.withColumn("part", F.shiftright("x.a", 64 - PART_BITS))
    ends = cut.groupBy(*part).agg(F.sum("n").alias("m"))
    ends = ends.select(*part, (F.sum("m").over(Window.partitionBy("key", "from_src").orderBy("part")) - F.col("m")).alias("zero"))
    upto = F.sum("n").over(Window.partitionBy(*part).orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = cut.withColumn("upto", upto).join(ends, part).withColumn("upto", F.col("upto") + F.col("zero")).withColumn("at", F.col("upto") - F.col("n"))
    block = F.explode(F.sequence(F.shiftright("at", BLOCK_BITS), F.shiftright(F.col("upto") - 1, BLOCK_BITS)))
    pieces = placed.select("key", "from_src", "x", "at", "upto", block.alias("block"))
    first = F.shiftleft("block", BLOCK_BITS)
    return _stretches(pieces.withColumns({"at": F.greatest("at", first), "upto": F.least("upto", first + (1 << BLOCK_BITS))}), ["key", "block"])


def _hot(left: DataFrame, dealt: int) -> DataFrame:
    """The keys with more copies left over than that."""
    return left.groupBy("key").agg(F.sum(F.abs("n")).alias("m")).where(F.col("m") > dealt).select("key")


def _looked_at(left: DataFrame, settle: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, int | None]:
    """What is left over, written, and DEALT if any key has more copies than that. Their number in all is counted as they are written; only if it is greater are keys looked at."""
    total = Observation()
    kept = settle(left.observe(total, F.coalesce(F.sum(F.abs("n")), F.lit(0)).alias("n")), "left-over")
    try:
        few = total.get.get("n", DEALT + 1) <= DEALT
    except Py4JError:  # an execution that found no rows at all may leave none behind
        few = False
    return kept, None if few or _hot(kept, DEALT).isEmpty() else DEALT


def paired(left: DataFrame, natural: bool, dealt: int | None = DEALT) -> DataFrame:
    """key, s, d: digests (a, b, size) of documents that have no equal on the other side; one of the two may be null. left: what left_over() gives. dealt: None says that no key has many copies.

    Several of one key stand in line on either side, in the order of their digests whatever order they came in, and those at one place meet. Equal copies are one
    stretch of the line, whatever their number: rows of a key are as many as its different documents, until the last step tells copies out, a block of them at most.
    """
    runs = left.select("key", (F.col("n") > 0).alias("from_src"), F.struct("a", "b", "size").alias("x"), F.abs("n").alias("n"))
    hot = None if dealt is None else _hot(left, dealt)
    few = (runs if hot is None else runs.join(hot, "key", "left_anti")).repartition("key")  # all that follows is by key, and needs no other exchange
    upto = F.sum("n").over(Window.partitionBy("key", "from_src").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    stretches = _stretches(few.withColumn("upto", upto).withColumn("at", F.col("upto") - F.col("n")), ["key"])
    if hot is not None:
        stretches = stretches.unionByName(_dealt(runs.join(hot, "key", "left_semi")))
    found = stretches.where("s is not null" if natural else "s is not null or d is not null")
    return found.select("key", "s", "d", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("_copy")).drop("_copy")


def _by_name(fields: Column) -> Column:
    """Name to sorted value and type; of fields that share a name the last counts. Fields are put in the order of name and place, so that each looks at its neighbour only."""
    placed = F.sort_array(F.transform(fields, lambda f, i: F.struct(f["name"].alias("name"), i.alias("i"), f["sorted"].alias("sorted"), f["type"].alias("type"))))
    last = let(placed, lambda p: F.filter(p, lambda f, i: ~F.coalesce(F.get(p, i + 1)["name"] == f["name"], F.lit(False))))
    return F.map_from_entries(F.transform(last, lambda f: F.struct(f["name"], F.struct(f["sorted"], f["type"]))))


def _row(field: Column, details: Column, cluster: str) -> Column:
    return F.struct(field.alias("field"), details.alias("details"), F.lit(cluster).alias("cluster"))


def _rows_of_pair(method: Method) -> Column:
    """The mismatch rows of a document that is on both sides (columns sv, dv: fields by name): an array of (field, details, cluster)."""
    sv, dv = F.col("sv"), F.col("dv")
    s, d = F.map_keys(sv), F.map_keys(dv)
    no_src = F.transform(F.array_except(d, s), lambda n: _row(n, F.lit(MISSING), SRC))
    no_dst = F.transform(F.array_except(s, d), lambda n: _row(n, F.lit(MISSING), DST))
    both = F.filter(F.array_intersect(s, d), lambda n: sv[n]["sorted"] != dv[n]["sorted"])
    differs = F.transform(
        both,
        lambda n: _row(n, F.when(sv[n]["type"] != dv[n]["type"], F.concat(F.lit(f"{MISMATCH} : type mismatch: src="), sv[n]["type"], F.lit(", dst="), dv[n]["type"])).otherwise(F.lit(MISMATCH)), DST),
    )
    return F.concat(no_src, no_dst, differs)


def compare(
    src: DataFrame, dst: DataFrame, method: str | Method = Method.IGNORE_ORDER, *, natural: bool = False, ids: DataFrame | None = None, settle: Callable[[DataFrame, str], DataFrame] | None = None,
    seen: Observation | None = None, hot: int | None = None,
) -> DataFrame:
    """id, field, details, cluster, data_size: a row for each top-level field that differs, or for a document that one side lacks.

    src, dst: documents. natural: documents only the destination has are not looked for. ids: only these keys.
    settle: writes a small table of what differs under a name and gives it back, so that it is found once only; keys with very many copies are then looked for, and dealt to tasks. hot: deals keys with more copies than that without looking first. seen: gets documents and bytes of the source on the way.
    """
    method = Method.of(method)
    if ids is not None:
        src, dst = restricted(src, ids), restricted(dst, ids)
    left, dealt = left_over(src, dst, method, seen), hot
    if settle is not None:
        left, dealt = _looked_at(left, settle)
    found = paired(left, natural, dealt)
    if settle is not None:
        found = settle(found, "differing")
    size = F.greatest(F.coalesce("s.size", F.lit(0)), F.coalesce("d.size", F.lit(0))).alias("data_size")
    one = found.where("s is null or d is null").select(
        F.col("key").alias("id"), F.lit("").alias("field"), F.lit(MISSING).alias("details"), F.when(F.col("s").isNull(), SRC).otherwise(DST).alias("cluster"), size
    )
    pair = found.where("s is not null and d is not null").select("key", "s", "d", size)
    if method is Method.HASH:
        told = pair.select("key", "data_size", _row(F.lit(""), F.lit(MISMATCH), DST).alias("r"))
    else:
        tables = _table_of(src), _table_of(dst)
        whole = [F.col(PRESENT if t[1] else ROW) if None not in tables else _fields(x) for x, t in zip((src, dst), tables, strict=True)]
        few = pair.select("key").distinct()
        both = _with_fields(_with_fields(pair, src, few, "s", method, whole[0]), dst, few, "d", method, whole[1])
        if None in tables:
            named = both.select("key", "data_size", _by_name(F.col("s_fields")).alias("sv"), _by_name(F.col("d_fields")).alias("dv")).select("key", "data_size", _rows_of_pair(method).alias("rows"))
        else:
            named = both.select("key", "data_size", _rows_of_tables(*tables).alias("rows"))
        order = F.array(_row(F.lit(""), F.lit(ORDER_ONLY), DST))
        rows = F.when(F.size("rows") == 0, order).otherwise(F.col("rows")) if method is Method.BINARY else F.col("rows")
        # explode() would have rows made twice more, by filters for empty ones that go down below what rows are made of.
        told = named.select("key", "data_size", F.explode_outer(rows).alias("r")).where("r is not null")
    return one.unionByName(told.select(F.col("key").alias("id"), "r.field", "r.details", "r.cluster", "data_size"))


def _table_of(docs: DataFrame) -> tuple[T.StructType, bool] | None:
    """The schema of a table's documents and whether nulls are fields that aren't there; None for documents that are known by fields only."""
    found = [(docs.schema[name].dataType, name == PRESENT) for name in (ROW, PRESENT) if name in docs.columns]
    return found[0] if found else None


def _rows_of_tables(s_kind: tuple[T.StructType, bool], d_kind: tuple[T.StructType, bool]) -> Column:
    """_rows_of_pair() for documents of two tables (columns s_fields, d_fields: their rows): columns are compared in generated code."""
    s, d = F.col("s_fields"), F.col("d_fields")
    rows = []
    for name in dict.fromkeys([*s_kind[0].fieldNames(), *d_kind[0].fieldNames()]):
        sides = []
        for column, (kind, absent) in ((s, s_kind), (d, d_kind)):
            if name in kind.fieldNames():
                value, type_ = column.getField(name), kind[name].dataType
                sides.append((value, type_, value.isNotNull() if absent else F.lit(True)))
            else:
                sides.append((None, None, F.lit(False)))
        (sv, st, sp), (dv, dt, dp) = sides
        if sv is None or dv is None:
            rows.append(F.when(sp, _row(F.lit(name), F.lit(MISSING), DST)) if dv is None else F.when(dp, _row(F.lit(name), F.lit(MISSING), SRC)))
            continue
        plain = st == dt and isinstance(st, T.IntegralType | T.StringType | T.BooleanType | T.DecimalType | T.BinaryType)
        differs = ~sv.eqNullSafe(dv) if plain else canonical.sorted_(sv, st) != canonical.sorted_(dv, dt)
        types = canonical.type_of(sv, st), canonical.type_of(dv, dt)
        told = F.when(types[0] != types[1], F.concat(F.lit(f"{MISMATCH} : type mismatch: src="), types[0], F.lit(", dst="), types[1])).otherwise(F.lit(MISMATCH))
        rows.append(F.when(~sp & dp, _row(F.lit(name), F.lit(MISSING), SRC)).when(sp & ~dp, _row(F.lit(name), F.lit(MISSING), DST)).when(sp & dp & differs, _row(F.lit(name), told, DST)))
    return F.array_compact(F.array(*rows))


def _with_fields(pair: DataFrame, docs: DataFrame, few: DataFrame, side: str, method: Method, whole: Column) -> DataFrame:
    """Adds the fields of the document that a digest is of (whole), as s_fields or d_fields. Documents of one digest are alike. few: the keys of pair, which itself may have been joined by now, and would be again.

    Keys alone are made of all documents; texts are made anew of those that are left.
    """
    by_name = method is Method.IGNORE_ORDER
    left = docs.select("key", *(c for c in (ROW, PRESENT, VARIANT, "fields") if c in docs.columns)).join(few, "key", "left_semi")
    wanted = left.select("key", whole.alias("fields"), _again(docs, by_name).alias("sorted" if by_name else "ordered")).select("key", "fields", *_digest(method))
    once = wanted.groupBy("key", "a", "b").agg(F.first("fields").alias(f"{side}_fields")).withColumnsRenamed({"key": "_key", "a": "_a", "b": "_b"})
    return pair.join(once, (F.col("key") == F.col("_key")) & (F.col(f"{side}.a") == F.col("_a")) & (F.col(f"{side}.b") == F.col("_b"))).drop("_key", "_a", "_b")


def compare_columns(src: DataFrame, dst: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, *, natural: bool = False, filter: str | dict | Column | None = None, unique: bool = False) -> DataFrame:
    """The same rows for two tables of one schema, without canonical texts: key columns, field, details, cluster.

    Only the compared columns are read. Equal rows leave the plan right after the join, before anything is exploded. Null keys meet each other.
    A key that repeats on a side is an error (compare() pairs such documents); unique says that none does, which saves looking.
    """
    columns = [c for c in (columns or src.columns) if c not in key]
    if filter is not None:
        src, dst = src.where(filters.condition(filter, src.schema)), dst.where(filters.condition(filter, dst.schema))
    # A key field is joined as its value, null made the type's zero, and whether it was null: the window that looks for repeats
    # and the join then share one exchange and one sort.
    zero = {k: F.lit("" if src.schema[k].dataType.typeName() == "string" else 0 if "timestamp" not in (t := src.schema[k].dataType.simpleString()) and t != "date" else "1970-01-01").cast(src.schema[k].dataType) for k in key}
    names = [n for i in range(len(key)) for n in (f"_k{i}", f"_n{i}")]

    def side(df: DataFrame, name: str) -> DataFrame:
        own = [c for i, k in enumerate(key) for c in (F.coalesce(F.col(k), zero[k]).alias(f"_k{i}"), F.col(k).isNull().alias(f"_n{i}"))]
        made = df.select(*own, F.struct(*columns).alias(name))
        if unique:
            return made
        n = F.count(F.lit(1)).over(Window.partitionBy(*names))
        return made.withColumn(name, F.when(n == 1, F.col(name)).otherwise(F.raise_error(F.lit(f"a key ({', '.join(key)}) repeats")).cast(made.schema[name].dataType)))

    met = side(src, "_s").join(side(dst, "_d"), names, "left_outer" if natural else "full_outer")
    differs = lambda c: ~F.col("_s").getField(c).eqNullSafe(F.col("_d").getField(c))
    some = F.col("_s").isNull() | F.col("_d").isNull()
    for c in columns:
        some = some | differs(c)
    row = lambda field, details, cluster: F.struct(F.lit(field).alias("field"), F.lit(details).alias("details"), F.lit(cluster).alias("cluster"))
    rows = F.when(F.col("_s").isNull(), F.array(row("", MISSING, SRC))).when(F.col("_d").isNull(), F.array(row("", MISSING, DST)))
    rows = rows.otherwise(F.array_compact(F.array(*(F.when(differs(c), row(c, MISMATCH, DST)) for c in columns))))
    back = [F.when(~F.col(f"_n{i}"), F.col(f"_k{i}")).alias(k) for i, k in enumerate(key)]
    return met.where(some).select(*names, F.explode(rows).alias("_r")).select(*back, "_r.*")


def aged(rows: DataFrame, now: Column, prior: DataFrame | None = None) -> DataFrame:
    """Adds first_ts and duration_ms. prior: id, first_mismatch_time of the documents that were already known to differ."""
    if prior is None:
        return rows.withColumns({"first_ts": now, "duration_ms": F.lit(0).cast("long")})
    known = prior.select(F.col("id"), F.col("first_mismatch_time").alias("_first")).groupBy("id").agg(F.min("_first").alias("_first"))
    first = F.coalesce("_first", now)
    return rows.join(known, "id", "left").withColumns({"first_ts": first, "duration_ms": F.unix_millis(now) - F.unix_millis(first)}).drop("_first")


def latest(time: Column) -> Column:
    """The greatest logical timestamp (struct of t and i) of an aggregation."""
    return F.max(time)


def first_of_each(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group, in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def ends_of_each(df: DataFrame, by: Sequence[str], value: Column, order: Sequence[Column], n: int, name: str) -> DataFrame:
    """by, name: an array of the values of each group's first n rows, in an order that leaves no ties. However large a group is, a task hands on n of its rows."""
    rows = df.select(*by, value.alias(name), F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("_n")).where(F.col("_n") <= n)
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", name))), lambda x: x[name]).alias(name))
