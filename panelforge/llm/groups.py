"""Connected groups of records that share buckets, without emitting all pairs of a large bucket."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.shared import components, drop, free_shuffles, materialize

#: Buckets of up to so many members have all their pairs verified at once.
SMALL = 8
#: Members that all of a bucket are held against first, and how often what is left is held against others, twice as many each time.
PIVOTS, TURNS = 2, 1


def linked_groups(
    members: DataFrame,
    bucket: str,
    node: str,
    verify: Callable[[DataFrame], DataFrame],
    may_link: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    carry: list[str],
    small: int = SMALL,
    release: DataFrame | None = None,
    first_shared: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    look: Callable[[DataFrame], DataFrame] | None = None,
    near: Callable[[str, str], str] | None = None,
) -> DataFrame:
    """(node, component) of the graph of all verified pairs that share a bucket.

    members: distinct (bucket, node) rows with the columns of `carry`; verify takes
    distinct pairs (a, b), a < b, and returns those that link; may_link is a cheap
    necessary condition on two rows of a bucket. first_shared is a stricter one that
    every linking pair meets in one bucket at least; without it, may_link is taken.
    prepare gets the nodes that share a bucket with others, and returns them with
    columns that may_link may take besides. look and near go together: look gets
    nodes and returns them with more columns, near is the SQL of a condition on two
    aliases with those columns that every linking pair meets. In large buckets, what
    is left after the first pivots is held against it within the join, so that rows
    come out for pairs near each other only, and not for all of a group whose
    members share a passage and don't link; look is asked for the members that
    may_link leaves anything for.

    The result is that of verifying every pair of every bucket, with fewer pairs:
    a small bucket gives all of them. In a large one each member is first held
    against a few pivots, the same ones in all buckets of a group of copies; then,
    in some turns, the members outside the bucket's largest component against a
    few of that component and a few of the others, chosen by bucket; and what is
    still outside then against all that are not in their own component. A pair within a component can't change the
    components. release: a table of materialize() that only members reads, and
    that then goes. Tables in between go as soon as the next one is written.
    """
    across = W.partitionBy(bucket)
    ranked = members.select(
        bucket, node, *carry,
        F.row_number().over(across.orderBy(F.xxhash64(node), node)).alias("_r"),
        F.count("*").over(across).cast("long").alias("_m"),
    ).where("_m > 1")
    ranked = materialize(ranked, "buckets")
    if release is not None:
        drop(release)
    free_shuffles(ranked.sparkSession)

    if prepare is not None:
        plain = ranked
        ranked = materialize(ranked.join(prepare(ranked.select(node).distinct()), node), "buckets")
        drop(plain)

    def within(condition: str, link: Callable) -> Column:
        return F.expr(condition) & link(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"))

    def pairs(left: DataFrame, right: DataFrame, held: Column) -> DataFrame:
        both = left.alias("a").join(right.alias("b"), F.col(f"a.{bucket}") == F.col(f"b.{bucket}"), "inner").where(held)
        return both.select(F.least(f"a.{node}", f"b.{node}").alias("a"), F.greatest(f"a.{node}", f"b.{node}").alias("b"))

    passing: list[DataFrame] = []

    def near_pairs(left: DataFrame, right: DataFrame, condition: str, link: Callable) -> DataFrame:
        """pairs() that near leaves. Semi joins tell first which rows have any; they give no row twice."""
        if look is None:
            return pairs(left, right, within(condition, link)).distinct()
        on = (F.col(f"a.{bucket}") == F.col(f"b.{bucket}")) & within(condition, link)
        own = materialize(left.alias("a").join(right.alias("b"), on, "left_semi"), "own")
        others = materialize(right.alias("b").join(own.alias("a"), on, "left_semi"), "others")
        nodes = materialize(own.select(node).union(others.select(node)).distinct(), "nodes")
        faces = materialize(look(nodes), "faces")
        passing.extend([own, others, nodes, faces])
        # near costs the most, and is looked at last
        return pairs(own.join(faces, node), others.join(faces, node), F.when(within(condition, link), F.expr(near("a", "b"))).otherwise(False)).distinct()

    strict = first_shared or may_link
    few, many = ranked.where(F.col("_m") <= small), ranked.where(F.col("_m") > small)
    pivots = many.where(F.col("_r") <= PIVOTS)
    # the pivots take the looser condition: each pair that they link spares many of the later passes
    tried = [materialize(pairs(few, few, within("a._r < b._r", strict)).union(pairs(pivots, many, within(f"a.{node} <> b.{node}", may_link))).distinct(), "pairs")]
    free_shuffles(ranked.sparkSession)
    edges = materialize(verify(tried[0]), "links")
    found = components(edges)

    def split(hot: DataFrame) -> DataFrame:
        """The members of buckets with more than one component, and the largest of them."""
        sizes = hot.groupBy(bucket, "component").agg(F.count("*").alias("n"))
        main = sizes.groupBy(bucket).agg(F.max_by("component", F.struct("n", "component")).alias("_main"), F.count("*").alias("_parts")).where("_parts > 1")
        return hot.join(main.drop("_parts"), bucket)

    def with_components(df: DataFrame) -> DataFrame:
        return df.join(found.withColumnRenamed("node", node), node, "left").withColumn("component", F.coalesce("component", node))

    hot = materialize(split(with_components(many)), "hot")
    drop(ranked)
    for turn in range(TURNS + 1):
        last = turn == TURNS
        outside = hot.where("component <> _main")
        if last:
            both = near_pairs(outside, hot, f"a.component <> b.component and (b.component = b._main or a.{node} < b.{node})", strict)
        else:
            side = (F.col("component") == F.col("_main")).alias("_side")
            order = W.partitionBy(bucket, side).orderBy(F.xxhash64(F.lit(turn), bucket, node), node)
            some = hot.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= PIVOTS << turn).drop("_k")
            both = near_pairs(outside, some, "a.component <> b.component", may_link)
        tried.append(materialize(both.join(reduce(DataFrame.union, tried), ["a", "b"], "left_anti"), "pairs"))
        while passing:
            drop(passing.pop())
        more = materialize(verify(tried[-1]), "links")
        if not more.isEmpty():
            edges = edges.union(more)
            found = components(edges)
            if not last:
                old, hot = hot, materialize(split(with_components(hot.drop("component", "_main"))), "hot")
                drop(old)
    drop(hot)
    for t in tried:
        drop(t)
    return found
