"""Benchmark decontamination by a distributed positional inverted index, by DataFrame functions only.

Words are runs of 0-9, a-z (A-Z lower-cased) and all code points over 0x7F. Each item's
windows are its WINDOW consecutive words, or all of its words if it has fewer.

1. The corpus frequency of each benchmark term is counted.
2. Every window gets its rarest term as anchor. A window that holds an anchor also holds
   the REACH words before it or the REACH words after it; the rarest term on either side is the anchor's partner.
3. The postings of anchors and partners (term, document, position) are stored.
4. An anchor's postings, moved by the anchor's place in the item, are intersected with each partner's, moved by
   the partner's; what stays is an alignment of an item with a document.
5. An exact check of alignments against the document's words gives the matched run around the anchor.
   Runs that hold a whole window are its occurrences; every window is found by its own anchor.

Common passages make postings in proportion to their occurrences, and windows of one item that share an anchor share an alignment. Windows
that are equal have one anchor together, so an item that repeats p words over and over has p anchors at most, and a document has p alignments at most for each of its words.

The same postings tell which items have their rarest terms near each other in a document (near(), proximity()).

Null and empty texts have no words and aren't contaminated. Rows of one doc_id are told apart by their
texts; equal rows have equal results, and all stay. Items with equal ids are one item if their texts are equal and count
once in items_sha256 otherwise. Items without words, and null items, match nothing. Other columns are ignored.
No documents give no rows; no items leave every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, text_or_empty, unused, written

WINDOW, SHARE = 13, 20
TERMS, DISTANCE = 3, 10
CELLS = 1 << 20
NO_ID = -(1 << 63)


def words(text: Column) -> Column:
    """The words of a text, in order."""
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(ascii_lower(text))
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_or_empty().alias("text"))


def items(benchmark: DataFrame) -> DataFrame:
    """item (a number of its own), item_id, terms, size."""
    own = benchmark.select("item_id", words(text_or_empty()).alias("terms")).where(F.size("terms") > 0).distinct()
    return own.select(F.xxhash64(F.col("item_id"), "terms").alias("item"), F.col("item_id").cast("string").alias("item_id"), "terms", F.size("terms").alias("size"))


def occurrences(rows: DataFrame) -> DataFrame:
    """id, key (of the text), term, pos of every word."""
    return rows.select("id", F.xxhash64(F.lit(3), "text").alias("key"), F.posexplode(words(F.col("text"))).alias("pos", "term"))


def frequencies(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """term and n of each benchmark term in the corpus."""
    seen = occurrences(rows).select("term").join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(seen, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchors(bench: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, place, term and its partners: side, partner, shift (the partner's place less the anchor's); a null partner asks for nothing."""
    place = bench.select("item", "size", "terms", F.posexplode("terms").alias("place", "term")).join(counts, "term")
    rank = F.struct(F.col("n"), F.col("place"))
    ahead = Window.partitionBy("item").orderBy("place")
    # The rarest place of the window that starts here.
    rarest = place.withColumn("least", F.min(rank).over(ahead.rowsBetween(0, window - 1))).where((F.col("place") + window <= F.col("size")) | ((F.col("place") == 0) & (F.col("size") < window)))
    # Windows of an item that are equal occur at the same places of a document: one of them says it for all, so repeated words have few anchors.
    once = rarest.groupBy("item", F.slice("terms", F.col("place") + 1, window).alias("words")).agg(F.min_by("least", "place").alias("least"))
    chosen = once.select("item", F.col("least.place").alias("place")).distinct()
    reach = window // 2
    other = F.struct(F.col("n"), F.col("place"), F.col("term"))
    sides = place.select(
        "item", "size", "place", "term", F.min(other).over(ahead.rowsBetween(-reach, -1)).alias("left"), F.min(other).over(ahead.rowsBetween(1, reach)).alias("right")
    ).join(chosen, ["item", "place"])
    # A short item's one window holds all its words: any neighbour will do.
    short = F.col("size") < window
    any_side = F.coalesce(F.least("left", "right"), F.col("left"), F.col("right"))
    both = F.when(short, F.array(any_side)).otherwise(F.array_compact(F.array("left", "right")))
    both = F.when(F.size(both) == 0, F.array(F.lit(None).cast(sides.schema["left"].dataType))).otherwise(both)
    told = sides.select("item", "size", "place", "term", F.explode(both).alias("o"))
    return told.select("item", "size", "place", "term", F.col("o.term").alias("partner"), (F.col("o.place") - F.col("place")).alias("shift"))


def postings(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored positional index of these terms: term, id, key, pos."""
    return written(occurrences(rows).join(terms, "term").select("term", "id", "key", "pos"), "postings")


def alignments(index: DataFrame, anchor: DataFrame) -> DataFrame:
    """id, key, item, place, pos: where an anchor and one of its partners stand as in the item."""
    met = index.join(anchor, "term").select("id", "key", "item", "place", "pos", "partner", (F.col("pos") + F.col("shift")).alias("at"))
    alone = met.where("partner is null")
    partner = index.select("id", "key", F.col("pos").alias("at"), F.col("term").alias("partner"))
    found = met.where("partner is not null").join(partner, ["id", "key", "at", "partner"], "left_semi")
    return found.unionByName(alone).select("id", "key", "item", "place", "pos").distinct()


def _run(flags: Column) -> Column:
    """How many of the flags, from the first, hold before one doesn't."""
    at = F.array_position(flags, F.lit(False))
    return F.when(at == 0, F.size(flags).cast("long")).otherwise(at - 1)


def hits(rows: DataFrame, found: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, key, item_id, first, last: document words (from 0) inside occurrences of an item's windows."""
    keyed = rows.select("id", F.xxhash64(F.lit(3), "text").alias("key"), "text")
    # Texts are only shuffled if their hash falls where an alignment's does: at most CELLS numbers are broadcast, whatever the corpus.
    cell = F.pmod(F.xxhash64("key", "id"), F.lit(CELLS)).cast("int")
    near = keyed.withColumn("cell", cell).join(F.broadcast(found.select(cell.alias("cell")).distinct()), "cell", "left_semi").drop("cell")
    texts = near.join(found.select("id", "key").distinct(), ["id", "key"], "left_semi").distinct()
    read = texts.select("id", "key", words(F.col("text")).alias("own"))
    met = found.join(read, ["id", "key"]).join(bench, "item")
    reach = window - 1
    # The words before the anchor are compared from the anchor on, backwards.
    part = lambda array, start, length: F.slice(array, (start + 1).cast("int"), length.cast("int"))
    back = F.least(F.lit(reach), "place", "pos")
    ahead = F.least(F.lit(reach), F.col("size") - 1 - F.col("place"), F.size("own") - 1 - F.col("pos"))
    same = lambda a, b: F.zip_with(a, b, lambda x, y: x == y)
    left = _run(F.reverse(same(part(F.col("own"), F.col("pos") - back, back), part(F.col("terms"), F.col("place") - back, back))))
    right = _run(same(part(F.col("own"), F.col("pos") + 1, ahead), part(F.col("terms"), F.col("place") + 1, ahead)))
    runs = met.where(F.get("own", F.col("pos")) == F.get("terms", F.col("place"))).select("id", "key", "item_id", "size", "pos", left.alias("left"), right.alias("right"))
    held = runs.where(F.col("left") + F.col("right") + 1 >= F.least(F.lit(window), "size"))
    return held.select("id", "key", "item_id", (F.col("pos") - F.col("left")).alias("first"), (F.col("pos") + F.col("right")).alias("last"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, terms: int = TERMS, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs (with their other columns) and n_words, n_hit, n_items, items_sha256, contaminated: share * n_hit >= n_words > 0 hit; n_near: items with a proximity match."""
    rows, bench = _documents(docs), items(benchmark)
    counts = written(frequencies(rows, bench.select(F.explode("terms").alias("term")).distinct()), "term-counts")
    anchor, rare = written(anchors(bench, counts, window), "anchors"), written(rarest(bench, counts, terms), "proximity-terms")
    asked = anchor.select("term").union(anchor.select("partner").where("partner is not null")).union(rare.select("term")).distinct()
    index = postings(rows, asked)
    found = written(alignments(index, anchor), "alignments")
    hit = written(hits(rows, found, bench, window), "hits")
    spans = hit.select("id", "key", F.explode(F.sequence("first", "last")).alias("pos")).distinct().groupBy("id", "key").agg(F.count(F.lit(1)).alias("n_hit"))
    which = hit.select("id", "key", "item_id").distinct().groupBy("id", "key").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    close = near(index, rare, terms, distance).where("first is not null").select("id", "key", "item").distinct().groupBy("id", "key").agg(F.count(F.lit(1)).alias("n_near"))
    kept = [c for c in docs.columns if c not in RESULT]
    own, text, id_, key, hit_id, hit_key = unused(docs.columns, "n_words", "own_text", "own_id", "own_key", "hit_id", "hit_key")
    per = spans.join(which, ["id", "key"]).join(close, ["id", "key"], "full").withColumnsRenamed({"id": hit_id, "key": hit_key})
    keyed = docs.select(*(F.col(f"`{c}`") for c in kept), text_or_empty().alias(text)).withColumns(
        {id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), key: F.xxhash64(F.lit(3), text), own: F.size(words(F.col(text))).cast("long")}
    ).drop(text)
    told = keyed.join(per, (F.col(id_) == F.col(hit_id)) & (F.col(key) == F.col(hit_key)), "left")
    none = F.lit(0).cast("long")
    n_hit = F.coalesce("n_hit", none)
    return told.select(
        *(F.col(f"`{c}`") for c in kept),
        F.col(own).alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col(own))).alias("contaminated"),
        F.coalesce("n_near", none).alias("n_near"),
    )


RESULT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def rarest(bench: DataFrame, counts: DataFrame, terms: int = TERMS) -> DataFrame:
    """item, term, rank (from 1), need: each item's rarest distinct terms, so many or all it has."""
    own = bench.select("item", F.explode(F.array_distinct("terms")).alias("term")).join(counts, "term")
    by_item = Window.partitionBy("item")
    ranked = own.withColumn("rank", F.row_number().over(by_item.orderBy("n", "term"))).where(F.col("rank") <= terms)
    return ranked.withColumn("need", F.count(F.lit(1)).over(by_item)).select("item", "term", "rank", "need")


def near(index: DataFrame, asked: DataFrame, terms: int = TERMS, distance: int = DISTANCE) -> DataFrame:
    """id, key, item, rank, pos, first, last: for each place of an asked term, the shortest stretch of at most distance words around
    it that holds all asked terms of the item, the first of several; null where there is none.

    An item's postings in one document are read in order, and each looks at no more than the distance before and after it.
    """
    met = index.join(asked, "term").select("id", "key", "item", "rank", "need", "pos")
    order = Window.partitionBy("id", "key", "item").orderBy("pos")
    ends = [F.min(F.when(F.col("rank") == r, F.col("pos"))).over(order.rangeBetween(0, distance)) for r in range(1, terms + 1)]
    starts = met.withColumn("ends", F.array_compact(F.array(*ends)))
    whole = F.when(F.size("ends") == F.col("need"), F.struct(F.col("pos").alias("first"), F.array_max("ends").alias("last")))
    around = starts.withColumn("around", F.collect_list(whole).over(order.rangeBetween(-distance, 0)))
    reached = F.transform("around", lambda w: F.struct((F.greatest(w["last"], F.col("pos")) - w["first"]).alias("span"), w["first"].alias("first"), F.greatest(w["last"], F.col("pos")).alias("last")))
    best = F.array_min(F.filter(reached, lambda w: w["span"] <= distance))
    return around.select("id", "key", "item", "rank", "pos", best.alias("best")).select("id", "key", "item", "rank", "pos", "best.first", "best.last")


def proximity(docs: DataFrame, benchmark: DataFrame, terms: int = TERMS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, item_id, first, last: where an item's rarest distinct terms (so many) all stand within so many words, in any order: for each place of the rarest, the shortest such stretch around it, the first of several."""
    rows, bench = _documents(docs), items(benchmark)
    counts = written(frequencies(rows, bench.select(F.explode("terms").alias("term")).distinct()), "term-counts")
    asked = written(rarest(bench, counts, terms), "proximity-terms")
    spans = near(postings(rows, asked.select("term").distinct()), asked, terms, distance).where("rank = 1 and first is not null")
    return spans.join(bench.select("item", "item_id"), "item").select(F.nullif(F.col("id"), F.lit(NO_ID)).alias("doc_id"), "item_id", "first", "last").distinct()


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, bench).select("doc_id", *RESULT)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS gram
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, i, s.n, array_to_string(list_slice(w, i, i + s.n - 1), ' ') AS gram
  FROM d, (SELECT DISTINCT n FROM bw) AS s, unnest(range(1, len(w) - s.n + 2)) AS u(i) WHERE len(w) >= s.n
), m AS (
  SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.n = bw.n
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id
), bt AS (
  SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(w) AS t FROM b)
), f AS (
  SELECT t, count(*) AS n FROM (SELECT unnest(w) AS t FROM d) GROUP BY t
), rare AS (
  SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(n, 0), t) AS k FROM bt LEFT JOIN f USING (t) QUALIFY k <= 3
), o AS (
  SELECT DISTINCT p.doc_id, rare.item_id, rare.k, p.i FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d) AS p JOIN rare ON p.t = rare.t
), close AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (
    SELECT a.doc_id, a.item_id FROM o AS a JOIN o AS z ON z.doc_id = a.doc_id AND z.item_id = a.item_id AND z.i BETWEEN a.i AND a.i + 10
    GROUP BY a.doc_id, a.item_id, a.i HAVING count(DISTINCT z.k) = (SELECT count(*) FROM rare AS r WHERE r.item_id = a.item_id)
  ) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS sha FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       coalesce(t.sha, sha256('')) AS items_sha256, (coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w)) AS contaminated, coalesce(close.n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN close USING (doc_id)
"""
