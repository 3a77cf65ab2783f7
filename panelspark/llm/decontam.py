"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

The postings of every benchmark term are stored as (term, document, position). A window is a run of consecutive item
words. Its postings are intersected from the rarest term on, each list shifted by the term's offset in the window;
what survives is an occurrence of the phrase, and is confirmed on the document's own words. Nothing is dealt by term,
so a term or passage that fills a third of the rows doesn't meet in one task.

Defined cases: a null or empty text has no words and no hits; very long texts are searched whole; an item without words
has no windows, one with fewer words than `width` is one window; items of equal words are each counted; of equally rare
terms of a window the first is taken first, which changes no result; rows that repeat a doc_id are told apart by their
text, and equal rows get equal results; a null doc_id is a document of its own text; columns other than doc_id, text,
item_id are ignored, whatever their names; an empty table of documents gives no rows, one of items no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, small_batches, stored

#: Runs of ASCII that end a word once A-Z are lower case: all but 0-9 and a-z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 13
#: Words, terms and candidate rows that may be broadcast (some 20 MB); beyond it Spark joins by shuffle.
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in order."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(window, item_id, terms): every run of `width` words of each item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    last = F.greatest(F.size("words") - width, F.lit(0))
    runs = items.withColumn("at", F.explode(F.sequence(F.lit(0), last))).select("item_id", F.slice("words", F.col("at") + 1, F.lit(width)).alias("terms"))
    runs = runs.distinct()
    return runs.withColumn("window", F.xxhash64("item_id", "terms"))


def postings(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """(doc_id, tie, term, pos) of every occurrence of the terms, and for each row of docs term 0 at its word count."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), words(F.col("text")).alias("words"))
    # The empty word stands after the last one: its position is the number of words.
    each = rows.select("doc_id", "tie", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "word"))
    return each.join(broadcast_if_small(terms, n_terms, BROADCAST_ROWS), "word").select("doc_id", "tie", "term", "pos")


def _shifted(index: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """Occurrences (doc_id, tie, window, start) whose term of the given rank lies at its offset."""
    return index.join(broadcast_if_small(found, n, BROADCAST_ROWS), "term").select("doc_id", "tie", "window", (F.col("pos") - F.col("offset")).alias("start")).filter("start >= 0")


def inverted_index(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored postings of all benchmark words, and the number of postings of each term that has any."""
    terms = benchmark.select(F.explode(words(F.col("text"))).alias("word")).distinct().withColumn("term", F.xxhash64("word"))
    terms = terms.unionByName(terms.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(0).cast("long").alias("term")))
    terms = stored(terms, "terms")
    index = stored(postings(docs, terms, terms.count()), "postings")
    return index, stored(index.filter("term != 0").groupBy("term").agg(F.count("*").alias("df")), "frequency")


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, lists: int = 3, index: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The occurrences (doc_id, tie, item_id, start, length) of all windows, and each row's word count.

    lists is how many posting lists are intersected before the words themselves are compared.
    """
    index, frequency = index or inverted_index(docs, benchmark)
    runs = stored(windows(benchmark, width), "windows")
    n_runs = runs.count()
    counts = index.filter("term = 0").select("doc_id", "tie", F.col("pos").cast("long").alias("n_words"))
    # Rank the terms of each window by their number of postings; a term without postings ends the window.
    offsets = runs.select("window", F.size("terms").alias("k"), F.posexplode("terms").alias("offset", "word")).withColumn("term", F.xxhash64("word"))
    ranked = offsets.join(frequency, "term", "left")
    rank = F.row_number().over(Window.partitionBy("window").orderBy(F.col("df").asc_nulls_first(), "offset"))
    ranked = ranked.withColumn("rank", rank).withColumn("least", F.min(F.coalesce("df", F.lit(0))).over(Window.partitionBy("window")))
    ranked = stored(ranked.filter((F.col("least") > 0) & (F.col("rank") <= lists)).select("window", "term", "offset", "rank"), "ranked")
    key = ["doc_id", "tie", "window", "start"]
    null_safe = lambda a, b: (a["doc_id"].eqNullSafe(b["doc_id"])) & (a["tie"] == b["tie"])
    candidates = stored(_shifted(index, ranked.filter("rank = 1"), n_runs).distinct(), "rarest")
    for r in range(2, lists + 1):
        # A window of fewer words keeps its candidates; the other terms are compared below.
        longer = ranked.filter(F.col("rank") == r)
        next_list = _shifted(index, longer, n_runs)
        short = candidates.join(broadcast_if_small(longer.select("window"), n_runs, BROADCAST_ROWS), "window", "left_anti")
        both = candidates.alias("c").join(next_list.alias("n"), (F.col("c.doc_id").eqNullSafe(F.col("n.doc_id"))) & (F.col("c.tie") == F.col("n.tie")) & (F.col("c.window") == F.col("n.window")) & (F.col("c.start") == F.col("n.start")), "left_semi")
        candidates = stored(both.select(*key).unionByName(short.select(*key)), f"list{r}")
    wanted = stored(candidates.select("doc_id", "tie").distinct(), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    held = broadcast_if_small(wanted, wanted.count(), BROADCAST_ROWS)
    own = texts.join(held, null_safe(texts, held), "left_semi").dropDuplicates(["doc_id", "tie"]).select("doc_id", "tie", words(F.col("text")).alias("words"))
    own = stored(own, "words")
    near = candidates.join(broadcast_if_small(runs, n_runs * width, BROADCAST_ROWS), "window")
    joined = near.join(own, null_safe(near, own)).drop(own["doc_id"]).drop(own["tie"])
    exact = joined.filter(F.slice("words", F.col("start") + 1, F.size("terms")) == F.col("terms"))
    return stored(exact.select("doc_id", "tie", "item_id", "start", F.size("terms").alias("length")), "matches"), counts


def proximity(docs: DataFrame, benchmark: DataFrame, slack: int = 8, lists: int = 3, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(doc_id, item_id, first, last): places that hold all distinct words of an item within its length plus slack.

    The same postings serve it. Postings of an item's rarest term stay where the next rarer terms, `lists` in all, lie
    within reach. For these, the postings of the item's other terms within reach are taken in order of position; where
    each one ends a window, the latest place of every other term so far gives the shortest window, so no window is lost.
    Every place between first and last that ends such a window has its own row.
    """
    return _spans(docs, benchmark, slack, lists, index).select("doc_id", "item_id", "first", "last").distinct()


def _spans(docs: DataFrame, benchmark: DataFrame, slack: int, lists: int, index: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    index, frequency = index or inverted_index(docs, benchmark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = items.select("item_id", (F.size("words") + slack).alias("reach"), F.array_distinct("words").alias("terms")).distinct()
    items = stored(items.select(F.monotonically_increasing_id().alias("item"), "*"), "items")
    each = items.select("item", "item_id", "reach", F.size("terms").alias("k"), F.explode("terms").alias("word")).withColumn("term", F.xxhash64("word"))
    w = Window.partitionBy("item")
    each = each.join(frequency, "term", "left").withColumn("rank", F.row_number().over(w.orderBy(F.col("df").asc_nulls_first(), "term"))).withColumn("least", F.min(F.coalesce("df", F.lit(0))).over(w))
    each = stored(each.filter("least > 0"), "ranked")  # an item with a word that no document has is nowhere
    n_each = each.count()
    held = broadcast_if_small(each.select("item", "item_id", "reach", "k", "term", "rank"), n_each, BROADCAST_ROWS)

    def same(a: str, b: str, *columns: str) -> Column:
        out = F.lit(True)
        for c in columns:
            out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
        return out

    # Rows of one doc_id are told apart by their text; equal rows have the same places.
    anchors = stored(index.join(held.filter("rank = 1"), "term").select("doc_id", "tie", "item", "reach", "k", F.col("pos").alias("anchor")).distinct(), "anchors1")
    for r in range(2, lists + 1):
        a, o = anchors.alias("a"), index.join(held.filter(F.col("rank") == r), "term").select("doc_id", "tie", "item", "pos").alias("o")
        near = same("a", "o", "doc_id", "tie", "item") & (F.abs(F.col("o.pos") - F.col("a.anchor")) < F.col("a.reach"))
        anchors = stored(a.filter(F.col("k") >= r).join(o, near, "left_semi").unionByName(anchors.filter(F.col("k") < r)), f"anchors{r}")
    # Postings of candidates only: first of their rows, then of those rows' items, whose terms they must be.
    able = stored(anchors.select("doc_id", "tie", "item").distinct(), "candidates")
    n_able = able.count()
    rows = broadcast_if_small(able.select("doc_id", "tie").distinct(), n_able, BROADCAST_ROWS).alias("r")
    pairs = broadcast_if_small(able, n_able, BROADCAST_ROWS).alias("p")
    own = index.alias("i").join(rows, same("i", "r", "doc_id", "tie"), "left_semi").join(held, "term").select("doc_id", "tie", "item", "item_id", "k", "term", "pos")
    a, o = anchors.alias("a"), own.alias("q").join(pairs, same("q", "p", "doc_id", "tie", "item"), "left_semi").alias("o")
    near = same("a", "o", "doc_id", "tie", "item") & (F.abs(F.col("o.pos") - F.col("a.anchor")) < F.col("a.reach"))
    close = o.join(a, near).select("o.doc_id", "o.tie", "o.item", "o.item_id", "o.k", "o.term", "o.pos", "a.anchor", "a.reach")
    close = stored(close.distinct(), "close")  # equal rows have equal postings
    # For each end of a window at or after the anchor: the latest place of each term up to it.
    anchor = ["doc_id", "tie", "item", "item_id", "k", "reach", "anchor"]
    ends = close.filter("pos >= anchor").select(*anchor, F.col("pos").alias("last"))
    so_far = ends.alias("e").join(close.alias("c"), same("e", "c", "doc_id", "tie", "item", "anchor") & (F.col("c.pos") <= F.col("e.last")) & (F.col("c.pos") > F.col("e.last") - F.col("e.reach")))
    latest = so_far.groupBy(*(F.col(f"e.{c}").alias(c) for c in anchor), F.col("e.last").alias("last"), F.col("c.term").alias("term")).agg(F.max("c.pos").alias("pos"))
    spans = latest.groupBy(*anchor, "last").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return spans.filter((F.col("n") == F.col("k")) & (F.col("last") - F.col("first") < F.col("reach")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, one_in: int = 20, slack: int | None = 8) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near for every row; tie tells repeated ids apart.

    n_near is the number of items that have a proximity match; slack None leaves proximity out (n_near is null).
    """
    small_batches(docs.sparkSession)
    index = inverted_index(docs, benchmark)
    found, counts = matches(docs, benchmark, width, index=index)
    hit = found.select("doc_id", "tie", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos"))
    hit = hit.distinct().groupBy("doc_id", "tie").agg(F.count("*").alias("n_hit"))
    items = found.select("doc_id", "tie", "item_id").distinct().groupBy("doc_id", "tie").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    judged = stored(hit.join(items, (hit["doc_id"].eqNullSafe(items["doc_id"])) & (hit["tie"] == items["tie"])).drop(items["doc_id"]).drop(items["tie"]), "judged")
    rows = counts.join(judged, (counts["doc_id"].eqNullSafe(judged["doc_id"])) & (counts["tie"] == judged["tie"]), "left").drop(judged["doc_id"]).drop(judged["tie"])
    if slack is None:
        rows = rows.withColumn("n_near", F.lit(None).cast("long"))
    else:
        near = stored(_spans(docs, benchmark, slack, 3, index).select("doc_id", "tie", "item_id").distinct().groupBy("doc_id", "tie").agg(F.count("*").alias("n_near")), "near")
        rows = rows.join(near, rows["doc_id"].eqNullSafe(near["doc_id"]) & (rows["tie"] == near["tie"]), "left").drop(near["doc_id"]).drop(near["tie"]).withColumn("n_near", F.coalesce("n_near", F.lit(0)))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"),
        "n_near",
        "tie",
    )
