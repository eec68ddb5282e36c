"""Outlines from their pointers: each entry names its first child and its next sibling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import Tables
from .annotations import OUTLINE_DEPTH, OUTLINE_NODES

AT = ["doc_id", "node"]
#: Siblings whose sizes one task adds up.
BLOCK = 4_096


def _heads(pointers: DataFrame) -> DataFrame:
    return pointers.where("child is not null").select("doc_id", F.col("node").alias("parent"), F.col("child").alias("node"))


def sibling_lists(pointers: DataFrame, heads: DataFrame, tables: Tables, root: int = 0) -> DataFrame:
    """``(doc_id, node, child, next)``, a row an entry, and the lists' first entries ``(doc_id, parent, node)`` -> the stored table
    ``(doc_id, node, p, leads)``: ``p`` has the parent in whose list an entry stands and its ``pos`` there, null if in none;
    ``leads`` says if it has a child, null if it is no entry of the table.

    Pointer doubling: a round of jumps twice as long as the last doubles what is known of every list, so rounds grow
    with the logarithm of the longest list and a list, however long, is no single task. An entry keeps one list in each round, the
    root's or else that of the smallest parent, so lists that share their ends cost no more rows than others. A list that runs back
    into itself ends there. Entries from which no jump of a round's length leads on leave the rounds. A pointer to an
    entry that is not in the table ends a list. Rounds end with the first that places no entry anew.
    """
    p = lambda pos, fresh, of="p.": F.struct(F.col(f"{of}outer"), F.col(f"{of}parent"), pos.alias("pos"), F.lit(fresh).alias("fresh"))
    jump = tables.put(pointers.where("next is not null").select(*AT, F.col("next").alias("to")))
    first = heads.withColumn("outer", F.col("parent") != root).groupBy(*AT).agg(F.min(p(F.lit(0).cast("bigint"), 1, "")).alias("p"))
    live, reach = tables.put(first), 1
    held = [live]
    del first
    while True:
        both = F.array(F.struct("node", p(F.col("p.pos"), 0).alias("p")), F.struct(F.col("to").alias("node"), p(F.col("p.pos") + reach, 1).alias("p")))
        grown = live.join(jump, AT).select("doc_id", F.inline(both)).groupBy(*AT).agg(F.min("p").alias("p"))
        live = tables.put(grown)
        held.append(live)
        del grown
        tables.tidy()
        reach *= 2
        if live.where("p.fresh = 1").isEmpty():
            break
        then = jump.select("doc_id", F.col("node").alias("to"), F.col("to").alias("then"))
        longer = tables.put(jump.join(then, ["doc_id", "to"]).select(*AT, F.col("then").alias("to")))
        tables.drop(jump)
        jump = longer
        del then, longer
        tables.tidy()
    placed = reduce(DataFrame.unionByName, [t.where("p.fresh = 1") for t in held]).withColumn("leads", F.lit(None).cast("boolean"))
    known = pointers.select(*AT, F.lit(None).cast(live.schema["p"].dataType).alias("p"), F.col("child").isNotNull().alias("leads"))
    out = tables.put(placed.unionByName(known).groupBy(*AT).agg(F.min("p").alias("p"), F.max("leads").alias("leads")))
    tables.drop(jump, *held)
    del jump, live, held, placed, known
    tables.tidy()
    return out


def outline_tree(once: DataFrame, tables: Tables, root: int = 0) -> DataFrame:
    """``(doc_id, node, child, next)`` -> the stored table ``(doc_id, node, top, pos)``: each entry in one list.

    A parent that stands in no list itself has no say where others could: documents with such parents are placed again without them.
    What still hangs from an entry without a place becomes its own parent, a ring of one.
    """
    place = lambda t: t.where("p is not null and leads is not null").where(F.col("node") != root).select(*AT, F.col("p.parent").alias("top"), F.col("p.pos").alias("pos"))
    lists = sibling_lists(once, _heads(once), tables, root)
    stray = lists.where("leads and p is null").where(F.col("node") != root)
    if stray.isEmpty():
        tree = tables.put(place(lists))
    else:
        docs = tables.put(stray.select("doc_id").distinct())
        again = once.join(docs, "doc_id", "left_semi")
        inside = lists.where("p is not null").select(*AT)
        led = again.where(F.col("node") == root).unionByName(again.where(F.col("node") != root).join(inside, AT, "left_semi"))
        second = sibling_lists(again, _heads(led), tables, root)
        tops = place(second).select("doc_id", F.col("node").alias("top"), F.lit(True).alias("_known"))
        loose = place(second).join(tops, ["doc_id", "top"], "left")
        own = F.when((F.col("top") == root) | F.col("_known"), F.col("top")).otherwise(F.col("node"))
        tree = tables.put(place(lists.join(docs, "doc_id", "left_anti")).unionByName(loose.select(*AT, own.alias("top"), "pos")))
        tables.drop(docs, second)
        del docs, again, inside, led, second, tops, loose
    tables.drop(lists)
    del lists, stray
    tables.tidy()
    return tree


def subtree_sizes(tree: DataFrame, tables: Tables, root: int = 0) -> DataFrame:
    """``(doc_id, node, top, pos)`` -> the stored table with ``size``, the entries of each one's tree with itself, and ``far``: the last
    ``k`` for which entries lie 2^k levels below it, or null.

    In a round, each entry gives the size of its known tree, of 2^k levels, to the ancestor 2^k levels above it. Entries without
    one leave the rounds; these end when nobody leaves, for only rings of entries that are their own ancestors are left then.
    """
    live, gives, stored = tree.where(F.col("top") != root).select(*AT, "top", F.lit(1).cast("bigint").alias("size")), [], None
    count = live.count()
    while count:
        give = tables.put(live.groupBy("doc_id", F.col("top").alias("node")).agg(F.sum("size").alias("more")))
        above = live.select("doc_id", F.col("node").alias("top"), F.col("top").alias("further"))
        far = live.join(above, ["doc_id", "top"]).select(*AT, F.col("further").alias("top"), "size")
        longer = tables.put(far.join(give, AT, "left").select(*AT, "top", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        gives.append(give)
        if stored is not None:
            tables.drop(stored)
        live = stored = longer
        left = live.count()
        del give, above, far, longer
        tables.tidy()
        if left == count:
            break
        count = left
    sized = tree.withColumns({"size": F.lit(1).cast("bigint"), "far": F.lit(None).cast("int")})
    if gives:
        all_ = reduce(DataFrame.unionByName, [g.withColumn("far", F.lit(k)) for k, g in enumerate(gives)])
        sums = all_.groupBy(*AT).agg(F.sum("more").alias("more"), F.max("far").alias("far"))
        sized = tree.join(sums, AT, "left").select(*tree.columns, (F.coalesce("more", F.lit(0)) + 1).alias("size"), "far")
    out = tables.put(sized)
    tables.drop(*gives, *([stored] if stored is not None else []))
    del live, stored, gives, sized
    tables.tidy()
    return out


def entries_before(sized: DataFrame) -> DataFrame:
    """Adds ``off``: the entries of the trees of earlier siblings, added up by blocks of a list."""
    of = ["doc_id", "top", "block"]
    blocks = sized.withColumn("block", F.floor(F.col("pos") / BLOCK))
    inner = blocks.withColumn("off", F.sum("size").over(W.partitionBy(*of).orderBy("pos")) - F.col("size"))
    sums = blocks.groupBy(*of).agg(F.sum("size").alias("all"))
    starts = sums.withColumn("start", F.sum("all").over(W.partitionBy("doc_id", "top").orderBy("block")) - F.col("all")).where("block > 0").select(*of, "start")
    return inner.join(starts, of, "left").select(*sized.columns, (F.col("off") + F.coalesce("start", F.lit(0))).alias("off"))


def whole_outline(pointers: DataFrame, root: int = 0) -> DataFrame:
    """``(doc_id, node, child, next, title, page_no)``, the row ``root`` standing for the document itself -> all its entries
    ``(doc_id, ord, depth, node, title, page_no)`` in reading order, however many and however deep.

    An entry's place is the sum, over itself and its ancestors, of the entries before each among its siblings, and of the
    ancestors themselves. These sums double like lists, so rounds grow with the logarithm of the deepest entry, rows do not, and neither a
    list nor a document is a single task. Entries that nothing leads to from the root are left out. In damaged outlines an entry that
    several lists hold stands once, in the root's list or else in that of the smallest parent that itself stands in a list; a ring of entries that
    are their own ancestors has no way from the root and is left out. Null titles are empty; of repeated rows of an
    entry the smallest counts. An empty table gives an empty outline.
    """
    tables = Tables(pointers.sparkSession)
    once = tables.put(pointers.where("doc_id is not null and node is not null").groupBy(*AT).agg(F.min(F.struct("child", "next", "title", "page_no")).alias("e")).select(*AT, "e.*"))
    tables.tidy()
    tree = outline_tree(once, tables, root)
    sized = subtree_sizes(tree, tables, root)
    tables.drop(tree)
    below = (F.col("top") != root).cast("int")
    # ``off`` sums over the ``n`` entries from this one up, ``top`` stands above them.
    sums = tables.put(entries_before(sized).select(*AT, "top", (F.col("off") + below).alias("off"), F.lit(1).alias("n"), "far"))
    tables.drop(sized)
    del tree, sized
    tables.tidy()
    done, held, k = [sums.where(F.col("top") == root)], [sums], 0
    live = sums.where(F.col("top") != root)
    while not live.isEmpty():
        # Only entries with others 2^k levels below are asked for.
        above = reduce(DataFrame.unionByName, done, live).where(F.col("far") >= k).select("doc_id", F.col("node").alias("top"), F.col("top").alias("further"), F.col("off").alias("more"), F.col("n").alias("m"))
        grown = tables.put(live.join(above, ["doc_id", "top"]).select(*AT, F.col("further").alias("top"), (F.col("off") + F.col("more")).alias("off"), (F.col("n") + F.col("m")).alias("n"), "far"))
        held.append(grown)
        came = grown.where(F.col("top") == root)
        live, k = grown.where(F.col("top") != root), k + 1
        del above, grown
        tables.tidy()
        if came.isEmpty():
            break
        done.append(came)
    placed = tables.put(reduce(DataFrame.unionByName, done).select(*AT, F.col("off").cast("int").alias("ord"), (F.col("n") - 1).alias("depth")))
    tables.drop(*held)
    del done, held, live, sums
    tables.tidy()
    return placed.join(once.select(*AT, "title", "page_no"), AT).select("doc_id", "ord", "depth", "node", F.coalesce("title", F.lit("")).alias("title"), "page_no")


def read_outline(pointers: DataFrame, root: int = 0) -> DataFrame:
    """What a reader with a budget shows of ``whole_outline``: 32 levels, and of these the first 8,000 entries of a document."""
    near = whole_outline(pointers, root).where(F.col("depth") < OUTLINE_DEPTH)
    shown = near.withColumn("ord", F.row_number().over(W.partitionBy("doc_id").orderBy("ord")) - 1)
    return shown.where(F.col("ord") < OUTLINE_NODES)
