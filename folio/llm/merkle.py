"""Operator 13: a Merkle manifest of a dataset, with a proof for each row, by higher-order functions.

A leaf is the digest H (lowercase hex sha256 of the concatenated inputs) of a row's fields, each ``-`` if
null, else its UTF-8 byte count, ``:`` and its value. The leaves of a source stand in the order of
doc_id (nulls first, equal ones by leaf); each run of ``FAN`` nodes becomes the H of them until one is
left, the source's subroot. The subroots, in the order of source (null first, bytewise), give the root
the same way.

1. Places: leaves are dealt by ranges of (source, doc_id, leaf), so a hot source or a repeated doc_id fills
   many partitions; a row's place in its source is its place in the partition plus one sum for each
   partition.
2. A block is an array of up to ``BLOCK`` = 3^6 ordered nodes, collapsed six levels inside one row by
   sequence, transform, slice and aggregate. Block roots are the nodes of the next round: some log_729(n)
   rounds, of which each is a staged table of 729 times fewer nodes.
3. On the way down each block meets the path above it, so each leaf gets its siblings up to the root.
   Texts are read once and never shuffled.

A proof is checked by folding a leaf with its siblings; ``tampered`` gives rows another leaf first.

Nulls: a null source is a source of its own, a null doc_id a value like others (it is never tampered
with here). Repeated rows are leaves each. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.shared import stage

FAN = 3
LEVELS = 6
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _digest(value: Column) -> Column:
    return F.sha2(value, 256)


def _leaf(fields: dict[str, Column]) -> Column:
    value = lambda c: fields[c].cast("string")
    return _digest(F.concat(*[F.coalesce(F.concat(F.octet_length(value(c)).cast("string"), F.lit(":"), value(c)), F.lit("-")) for c in FIELDS]))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, node (the leaf) and tampered: the leaf of the row without line feeds in its text
    where 2 divides the crc32 of the decimal doc_id and that changes it, else null."""
    fields = {c: F.col(c) for c in FIELDS}
    cut = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(F.col("text"), F.lit("\n"))
    return docs.select("doc_id", "source", _leaf(fields).alias("node"), F.when(touched, _leaf(fields | {"text": cut})).alias("tampered"))


def placed(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with place (from 0) and total within ``tree`` (nulls are one tree) by ``order``; staged."""
    keys = [tree, *order, "_at"]
    dealt = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = stage(dealt.drop("_at").withColumn("_seat", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_seat", 33)  # the partition; seats rise within it
    marks = dealt.groupBy(F.col(tree).alias("_tree"), part.alias("_part")).agg(F.min("_seat").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy("_tree")
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = marks.select("_tree", "_part", "_first", before.alias("_before"), F.sum("_n").over(own).alias("total"))
    joined = dealt.join(marks, F.col(tree).eqNullSafe(F.col("_tree")) & (part == F.col("_part")))
    return joined.withColumn("place", F.col("_before") + F.col("_seat") - F.col("_first")).drop("_seat", "_tree", "_part", "_first", "_before")


def _depth(total: Column) -> Column:
    """Levels a block is collapsed by: as many as lead a tree of one block to its root, else all."""
    found = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        found = F.when(total <= FAN**k, F.lit(k)).otherwise(found)
    return found


def _steps(total: Column) -> Column:
    return F.slice(F.array(*[F.lit(k) for k in range(LEVELS)]), F.lit(1), _depth(total))


def _levels(nodes: Column, total: Column) -> Column:
    """The levels of a block from its nodes to its root."""

    def above(level: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int"))
        return F.transform(runs, lambda i: _digest(F.array_join(F.slice(level, i * FAN + 1, FAN), "")))

    return F.aggregate(_steps(total), F.array(nodes), lambda levels, _: F.concat(levels, F.array(above(F.element_at(levels, -1)))))


def _path(levels: Column, place: Column, total: Column) -> Column:
    """For each level of a block the siblings to the left and to the right of a node or what covers it."""

    def siblings(k: Column) -> Column:
        own = F.floor(place / F.pow(F.lit(float(FAN)), k)).cast("int")
        level, turn = F.get(levels, k), own % FAN
        left = F.array_join(F.slice(level, own - turn + 1, turn), "")
        return F.struct(left.alias("left"), F.array_join(F.slice(level, own + 2, FAN - 1 - turn), "").alias("right"))

    return F.transform(_steps(total), siblings)


def _blocks(nodes: DataFrame) -> DataFrame:
    """(tree, block, total, members, levels) of (tree, place, total, node, row): ordered members of each block."""
    block = F.floor(F.col("place") / BLOCK)
    members = F.array_sort(F.collect_list(F.struct("place", "node", "row")))  # at most BLOCK, each in a block of its own
    return nodes.groupBy("tree", block.alias("block")).agg(F.first("total").alias("total"), members.alias("members"))


def _with_levels(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("levels", _levels(F.transform("members", lambda m: m["node"]), F.col("total")))


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """Staged blocks of each round, in the last of which every tree is one block."""
    rounds, most = [stage(_blocks(nodes), "blocks")], nodes.agg(F.max("total")).first()[0] or 0
    while most > BLOCK:
        most = -(-most // BLOCK)
        rounds.append(stage(_blocks(_roots(rounds[-1])), "blocks"))
    return rounds


def _roots(blocks: DataFrame) -> DataFrame:
    """The roots of blocks as nodes of the next round."""
    root = F.get(F.element_at("levels", -1), F.lit(0))
    total = F.ceil(F.col("total") / BLOCK)
    return _with_levels(blocks).select("tree", F.col("block").alias("place"), total.alias("total"), root.alias("node"), F.lit(None).cast("string").alias("row"))


def _climb(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, node, row, path, subroot, root) of the nodes of the first round, given (tree, subroot, root, path) of the trees."""
    above = above.withColumn("place", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        above = above.select(F.col("tree").alias("_tree"), F.col("place").alias("_place"), "subroot", "root", F.col("path").alias("_above"))
        met = _with_levels(blocks).join(above, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_place")))
        member = F.col("member")
        path = F.concat(_path(F.col("levels"), member["place"] % BLOCK, F.col("total")), F.col("_above"))
        met = met.select("tree", "total", "levels", "subroot", "root", "_above", F.explode("members").alias("member"))
        above = met.select("tree", member["place"].alias("place"), member["node"].alias("node"), member["row"].alias("row"), "subroot", "root", path.alias("path"))
    return above


def manifest(rows: DataFrame) -> DataFrame:
    """(tree, node, row, subroot, root, path) of rows (tree, node, row, place, total).

    ``path`` holds for each level up to the root the digests left and right of the own one.
    """
    rounds = _rounds(rows)
    subroots = _roots(rounds[-1]).select(F.col("tree").alias("row"), "node", F.lit(0).alias("tree"))
    top = _rounds(placed(subroots, "tree", "row"))
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    roots = _roots(top[-1]).select("tree", F.col("node").alias("subroot"), F.col("node").alias("root"), nothing.alias("path"))
    return _climb(rounds, _climb(top, roots).select(F.col("row").alias("tree"), F.col("node").alias("subroot"), "root", "path"))


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (H of all siblings), folded_root and verified.

    ``folded_root`` is the root that the row's present leaf, which was tampered with for some rows,
    gives with the recorded siblings.
    """
    rows = placed(stage(leaves(docs), "leaves"), "source", "doc_id", "node")
    rows = rows.select(F.col("source").alias("tree"), "place", "total", "node", F.struct("doc_id", "tampered").alias("row"))
    found = manifest(rows)
    proof = _digest(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""))
    folded = F.aggregate("path", F.coalesce("row.tampered", "node"), lambda own, p: _digest(F.concat(p["left"], own, p["right"])))
    found = found.select("row.doc_id", F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
