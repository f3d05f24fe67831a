"""Fingerprints of documents: a Merkle tree over sections of paragraphs of sentences, in DataFrame functions only.

A paragraph is a line, a section a run of ``fan`` paragraphs. The leaves are the SHA-256 of the sentences, with their marks and white
space; a paragraph's node is that of its sentences' nodes, a section's that of its paragraphs' nodes, the root (the fingerprint) that of
the sections' nodes. Equal roots mean equal texts; where roots differ, differing sections and then differing paragraphs of these locate
the edit. Likeness is Dice's coefficient of all nodes of two trees, repeats counted: one edited sentence takes its paragraph, its
section and the root with it, and leaves the others. It is 1 for equal texts only, as another order has other paragraphs, sections or
roots.

Cases: a null text is empty, and an empty text has one empty paragraph. Rows with a null doc_id come first; rows that share a doc_id
follow each other by length and hash. Rows equal in doc_id and text follow each other, so that all but the last of them have their own
text as the next one. Very long texts are hashed in whole. An empty table gives an empty result. Other columns of the input aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlens.llm.common import pinned

_node = lambda children: F.sha2(F.concat_ws(",", children), 256)


def section_nodes(paragraphs: Column, fan: int = 8) -> Column:
    """Array of the hashes of runs of ``fan`` paragraph nodes."""
    last = F.floor((F.size(paragraphs) - 1) / fan).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: _node(F.slice(paragraphs, k * fan + 1, fan)))


def root(sections: Column) -> Column:
    return _node(sections)


def changed_paragraphs(a: Column, b: Column, fan: int = 8) -> Column:
    """Numbers (from 0) of the paragraphs in which two arrays of paragraph nodes differ, found section by section."""
    unlike = F.zip_with(section_nodes(a, fan), section_nodes(b, fan), lambda x, y: ~x.eqNullSafe(y))
    differing = F.filter(F.transform(unlike, lambda d, k: F.when(d, k)), lambda k: k.isNotNull())
    within = F.flatten(F.transform(differing, lambda k: F.sequence(k * fan, k * fan + fan - 1)))
    return F.filter(within, lambda p: ~F.try_element_at(a, p + 1).eqNullSafe(F.try_element_at(b, p + 1)))


#: A sentence with the marks and white space after it; end to end they are the paragraph.
WHOLE_SENTENCE = r"[^.!?|]*[.!?|]+[ \t]*|[^.!?|]+"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often it is read."""
    return F.transform(F.array(value), use)[0]


def sentence_nodes(text: Column) -> Column:
    """For each line of the text the array of the hashes of its sentences."""
    return F.transform(F.split(text, "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(WHOLE_SENTENCE), F.lit(0)), lambda s: F.sha2(s, 256)))


def paragraph_nodes(sentences: Column) -> Column:
    """Array of the paragraphs' nodes, of their sentences' ones."""
    return F.transform(sentences, lambda p: _node(p))


def tree_nodes(sentences: Column, paragraphs: Column, fan: int = 8) -> Column:
    """Every node of a tree, sentences to root, as a long."""
    every = lambda sections: F.concat(F.flatten(sentences), paragraphs, sections, F.array(root(sections)))
    return F.transform(_once(section_nodes(paragraphs, fan), every), lambda h: F.xxhash64(h))


def _shared(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common, repeats counted, by a fold over both in order."""
    sides = F.array_sort(F.concat(F.transform(a, lambda h: F.struct(h.alias("h"), F.lit(1).alias("s"))), F.transform(b, lambda h: F.struct(h.alias("h"), F.lit(-1).alias("s")))))
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("d"), F.lit(0).alias("sum"))
    step = lambda acc, x: F.struct(
        x["h"].alias("h"), F.when(acc["h"] == x["h"], acc["d"] + x["s"]).otherwise(x["s"]).alias("d"), F.when(acc["h"] == x["h"], acc["sum"]).otherwise(acc["sum"] + F.abs(acc["d"])).alias("sum")
    )
    unlike = F.aggregate(sides, start, step, lambda acc: acc["sum"] + F.abs(acc["d"]))
    return ((F.size(a) + F.size(b) - unlike) / 2).cast("int")


def repeats(nodes: Column) -> Column:
    """What an array of nodes has beyond one of each: an element of k occurrences k - 1 times. Most trees repeat nothing."""
    ordered = lambda s: F.filter(s, lambda h, i: (i > 0) & (h == F.get(s, i - 1)))
    return F.when(F.size(F.array_distinct(nodes)) < F.size(nodes), _once(F.sort_array(nodes), ordered)).otherwise(F.array().cast("array<bigint>"))


def tree_likeness(a: Column, b: Column, a_repeats: Column, b_repeats: Column) -> Column:
    """Dice's coefficient of two arrays of nodes, repeats counted: what one has more often than the other lowers it.

    One of each node that both have, by a set; and of what ``repeats`` says of the two, which is little, all that both have.
    """
    more = F.when((F.size(a_repeats) > 0) & (F.size(b_repeats) > 0), _shared(a_repeats, b_repeats)).otherwise(F.lit(0))
    return (2 * (F.size(F.array_intersect(a, b)) + more)).cast("double") / (F.size(a) + F.size(b)).cast("double")


def successors(rows: DataFrame, tasks: int) -> DataFrame:
    """(key, to_key, take) for ``rows`` (key): the row before in the order of key, the last for the first.

    take: how many code points the row before asks for, a quarter of its own. Rows are range-sorted into blocks; the links across
    blocks come from a row for each block.
    """
    blocks = pinned(rows.select("key").repartitionByRange(tasks, "key").withColumn("block", F.spark_partition_id()), "blocks")
    edges = blocks.groupBy("block").agg(F.max("key").alias("last"))
    w = Window.orderBy("block")  # a row for each block
    edges = edges.select("block", F.coalesce(F.lag("last").over(w), F.max("last").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    inside = blocks.withColumn("prev", F.lag("key").over(Window.partitionBy("block").orderBy("key")))
    linked = inside.join(edges, "block", "left").withColumn("prev", F.coalesce("prev", "before"))
    return linked.select("key", F.col("prev").alias("to_key"), F.floor(F.col("prev.n") / 4).cast("int").alias("take"))


def _with_next(docs: DataFrame, rows_per_task: int, carried: Callable[[Column], Column]) -> DataFrame:
    """key, times, text, n_chars, edited and next of all rows: the edited text, and what ``carried`` makes of the next row's text.

    The edited text has the last quarter of the code points replaced by the beginning of the next row's text. Equal rows are one, with
    the number of ``times`` that it stands for. Texts are shuffled once, by doc_id, length and hash; to the row before goes only the
    quarter that it asks for, and what is carried.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.struct(F.col("doc_id").alias("doc_id"), F.char_length(text).alias("n"), F.xxhash64(text).alias("h")).alias("key"), text.alias("text"))
    counts = pinned(base.groupBy("key").agg(F.count("*").alias("c")), "counts")
    rows, most = counts.agg(F.count("*"), F.max("c")).first()
    if (most or 0) > 1:
        base = base.groupBy("key").agg(F.first("text").alias("text"))
    links = successors(counts, max(1, -(-rows // rows_per_task))).withColumn("times", F.lit(1).cast("long"))
    again = counts.filter("c > 1").select("key", F.col("key").alias("to_key"), F.floor(F.col("key.n") / 4).cast("int").alias("take"), (F.col("c") - 1).alias("times"))
    links = pinned(links.unionByName(again), "successors")
    # Small links would be sent to the texts, and all hashing be done where few files put these.
    giving = base.join(links.hint("merge"), "key").select(F.col("to_key").alias("key"), "times", F.substring("text", F.lit(1), F.col("take")).alias("begin"), carried(F.col("text")).alias("next"))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    return base.join(giving.hint("merge"), "key").select("key", "times", "text", "next", n.alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - quarter), "begin").alias("edited"))


def edit_study(docs: DataFrame, fan: int = 8, rows_per_task: int = 100_000) -> DataFrame:
    """Every row's fingerprint and that of its edited text, the numbers of the paragraphs in which the two trees differ (changed), found
    section by section, and the likeness of its tree to that of the edited text and to that of the next row.
    """
    carried = lambda t: _once(sentence_nodes(t), lambda s: _once(paragraph_nodes(s), lambda p: tree_nodes(s, p, fan)))
    trees = _with_next(docs, rows_per_task, carried)
    trees = trees.select("key", "times", "n_chars", "next", F.sha2("edited", 256).alias("edited_sha256"), sentence_nodes(F.col("text")).alias("s"), sentence_nodes(F.col("edited")).alias("es"))
    trees = trees.select("*", paragraph_nodes(F.col("s")).alias("p"), paragraph_nodes(F.col("es")).alias("ep"))
    trees = trees.select("*", tree_nodes(F.col("s"), F.col("p"), fan).alias("nodes"), tree_nodes(F.col("es"), F.col("ep"), fan).alias("edited_nodes"))
    trees = trees.select("*", *[repeats(F.col(c)).alias(f"{c}_again") for c in ("nodes", "edited_nodes", "next")])
    like = lambda other: tree_likeness(F.col("nodes"), F.col(other), F.col("nodes_again"), F.col(f"{other}_again"))
    found = trees.select(
        F.col("key.doc_id").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
        root(section_nodes(F.col("p"), fan)).alias("fingerprint"), root(section_nodes(F.col("ep"), fan)).alias("edited_fingerprint"),
        like("edited_nodes").alias("near_edited"), like("next").alias("near_next"),
        changed_paragraphs(F.col("p"), F.col("ep"), fan).alias("changed"), "times",
    )
    return found.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")


def difference_study(docs: DataFrame, fan: int = 8, rows_per_task: int = 100_000) -> DataFrame:
    """Of ``edit_study`` the trees alone."""
    return edit_study(docs, fan, rows_per_task).select("doc_id", "fingerprint", "edited_fingerprint", "changed", "near_edited", "near_next")
