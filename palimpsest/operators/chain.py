"""Walks up the parents of rounds, and where in a chain a fault began."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.scratch import scratch_path


def walk_chain(targets: DataFrame, rounds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(target, depth, round_file, missing): each target (depth 0), its parent, and so on.

    A chain ends at the root, at a round that is not stored (missing), before a
    round that it has already, or at max_depth links (None or 0: no such limit).
    A round is stored once, so it has one parent.
    """
    return _walk_some(targets, rounds, max_depth) if max_depth else _walk_trees(targets, rounds)


def _walk_some(targets: DataFrame, rounds: DataFrame, max_depth: int) -> DataFrame:
    """Joins follow the links, so all chains advance together; a step is one equi-join on the parent's key."""
    spark = targets.sparkSession
    links = rounds.select("round_file", F.col("parentId").alias("_parent"))
    start = targets.select("target", F.col("target").alias("round_file"), F.lit(0).alias("depth"), F.array(F.col("target")).alias("_path"))
    view = "_" + __import__("uuid").uuid4().hex
    start.createOrReplaceTempView(view + "s")
    links.createOrReplaceTempView(view + "l")
    return spark.sql(f"""
        with recursive walk max recursion level {max_depth + 1} as (
            select s.target, s.round_file, s.depth, s._path, l._parent, l.round_file is null as missing
            from {view}s s left join {view}l l on s.round_file = l.round_file
            union all
            select w.target, w._parent, w.depth + 1, concat(w._path, array(w._parent)), l._parent, l.round_file is null
            from walk w left join {view}l l on w._parent = l.round_file
            where w._parent is not null and w._parent <> '' and not array_contains(w._path, w._parent) and w.depth + 1 < {max_depth}
        )
        select target, depth, round_file, missing from walk""")


PAIRS, BUCKET = 500_000, 20_000  # links that a group gives at most, where a tree can be split by its targets; rounds of a group


def _links(rounds: pa.Table) -> pa.Table:
    """The chains of the wanted rounds of whole trees (round_file, up, gone, wanted)."""
    names = rounds.column("round_file").combine_chunks()
    number = {r: i for i, r in enumerate(names.to_pylist())}
    up = np.array([number.get(p, -1) for p in rounds.column("up").to_pylist()], np.int64)
    gone = rounds.column("gone").to_numpy()
    own = np.flatnonzero(rounds.column("wanted").to_numpy())
    at, depth, out = own, 0, []
    while len(own):
        out.append((own, np.full(len(own), depth), at, np.zeros(len(own), bool)))
        lost = gone[at]
        if lost.any():
            out.append((own[lost], np.full(lost.sum(), depth + 1), at[lost], np.ones(lost.sum(), bool)))
        on = up[at] >= 0
        own, at, depth = own[on], up[at[on]], depth + 1
    own, depths, at, missing = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
    found = names.take(pa.array(at, pa.int64()))
    if missing.any():  # the parent that isn't stored
        found = pc.if_else(pa.array(missing), rounds.column("up").combine_chunks().take(pa.array(at)), found)
    return pa.table({"target": names.take(pa.array(own, pa.int64())), "depth": pa.array(depths, pa.int32()), "round_file": found, "missing": pa.array(missing.astype(bool))})


def _walk_trees(targets: DataFrame, rounds: DataFrame) -> DataFrame:
    """Rounds find the root of their tree in steps that double; then a tree's rounds come together, and links are made in place.

    So what moves are rounds, log2 of the longest chain times and once more, and
    never links. A tree with very many links is split by its targets, each part with
    all its rounds. Targets whose parents run in a circle, which have no root after
    log2 n steps, and rounds that are stored with several parents, are walked by joins.
    """
    known = rounds.select(F.col("round_file").alias("_known")).distinct()
    own = rounds.select("round_file", F.nullif("parentId", F.lit("")).alias("up")).distinct()
    own = own.join(known, F.col("up") == F.col("_known"), "left").select("round_file", "up", (F.col("up").isNotNull() & F.col("_known").isNull()).alias("gone"))
    at = _kept(own.select("round_file", F.when(F.col("up").isNull() | F.col("gone"), F.col("round_file")).otherwise(F.col("up")).alias("to"), F.when(F.col("up").isNull() | F.col("gone"), 0).otherwise(1).cast("long").alias("depth"), (F.col("up").isNull() | F.col("gone")).alias("ended")))
    n, distinct, going = at[0].agg(F.count(F.lit(1)), F.count_distinct("round_file"), F.count_if(~F.col("ended"))).first()
    if n != distinct:
        _drop(at)
        return _walk_to_root(targets, rounds)
    steps = 0
    while going and 1 << steps <= 2 * n:
        far = at[0].select(F.col("round_file").alias("to"), F.col("to").alias("_to"), F.col("depth").alias("_d"), F.col("ended").alias("_e"))
        further = at[0].where("not ended").join(far, "to").select("round_file", F.col("_to").alias("to"), (F.col("depth") + F.col("_d")).alias("depth"), F.col("_e").alias("ended"))
        more = _kept(further.unionByName(at[0].where("ended")))
        _drop(at)
        at, steps, going = more, steps + 1, more[0].where("not ended").count()
    asked = targets.select("target").distinct()
    x = at[0].where("ended").select("round_file", F.col("to").alias("root"), "depth").join(own, "round_file").join(asked.withColumn("wanted", F.lit(True)), F.col("round_file") == F.col("target"), "left")
    x = _kept(x.select("root", "round_file", "up", "gone", "depth", F.coalesce("wanted", F.lit(False)).alias("wanted")))
    sizes = x[0].groupBy("root").agg(F.sum(F.when(F.col("wanted"), F.col("depth") + 1).otherwise(0)).alias("_links")).where("_links > 0")
    sizes = sizes.select("root", F.greatest(F.lit(1), F.ceil(F.col("_links") / PAIRS)).cast("int").alias("_parts"))
    dealt = x[0].join(sizes, "root").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    mine = F.col("wanted") & (F.pmod(F.xxhash64("round_file"), F.col("_parts")) == F.col("_part"))
    bucket = F.when(F.col("_parts") > 1, F.xxhash64("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(max(1, n // BUCKET))))
    dealt = dealt.select(bucket.alias("_bucket"), "_part", "round_file", "up", "gone", mine.alias("wanted"))
    name = rounds.schema["round_file"].dataType.simpleString()
    links = dealt.groupBy("_bucket", "_part").applyInArrow(_links, f"target {name}, depth int, round_file {name}, missing boolean")
    lost = asked.join(known, F.col("target") == F.col("_known"), "left_anti")
    out = links.unionByName(lost.select("target", F.lit(0).alias("depth"), F.col("target").alias("round_file"), F.lit(True).alias("missing")))
    if going:
        round_trips = asked.join(at[0].where("not ended"), F.col("target") == F.col("round_file"), "left_semi")
        return out.unionByName(_walk_to_root(round_trips, rounds))
    _drop(at)
    return out


def _walk_to_root(targets: DataFrame, rounds: DataFrame) -> DataFrame:
    """Steps that double: the links known so far, and from each of them the ancestor as many links further up.

    So a chain of n links takes log2(n) joins, and a cycle adds nothing once it
    is round. Each step is a table in scratch space; the last one stays, as the
    result reads it.
    """
    stored = rounds.select("round_file").distinct()
    known = stored.select(F.col("round_file").alias("_up"), F.lit(False).alias("_gone"))
    ups = rounds.select("round_file", F.col("parentId").alias("_up")).where("_up <> ''").distinct()
    ups = _kept(ups.join(known, "_up", "left").select("round_file", "_up", F.coalesce("_gone", F.lit(True)).alias("_gone")))
    have = targets.select("target", F.col("target").alias("round_file")).distinct().join(known.withColumnRenamed("_up", "round_file"), "round_file", "left")
    have = _kept(have.select("target", F.lit(0).alias("depth"), "round_file", F.coalesce("_gone", F.lit(True)).alias("missing")))
    step, n = 1, have[0].count()
    while True:
        new = have[0].join(ups[0], "round_file").select("target", (F.col("depth") + step).alias("depth"), F.col("_up").alias("round_file"), F.col("_gone").alias("missing"))
        more = _kept(have[0].union(new).groupBy("target", "round_file").agg(F.min("depth").alias("depth"), F.max("missing").alias("missing")).select(*have[0].columns))
        before, n = n, more[0].count()
        _drop(have)
        have = more
        if n == before:
            _drop(ups)
            return have[0]
        far = ups[0].select(F.col("round_file").alias("_up"), F.col("_up").alias("_far"), F.col("_gone").alias("_far_gone"))
        further = _kept(ups[0].join(far, "_up").select("round_file", F.col("_far").alias("_up"), F.col("_far_gone").alias("_gone")))
        _drop(ups)
        ups, step = further, 2 * step


def _kept(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_path(spark, "chain")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _drop(table: tuple[DataFrame, str]) -> None:
    spark = table[0].sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table[1])
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def origin_posterior(scores: Column) -> Column:
    """For fault scores of a chain, oldest first: the chance that each link is the origin, then that none is."""
    step = lambda a, f: F.struct(F.concat(a["p"], F.array(f * a["clean"])).alias("p"), (a["clean"] * (1 - f)).alias("clean"))
    zero = F.struct(F.array().cast("array<double>").alias("p"), F.lit(1.0).alias("clean"))
    return F.aggregate(scores, zero, step, lambda a: F.concat(a["p"], F.array(a["clean"])))


def entropy(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log(x)).otherwise(0.0))


def origin_profile(chains: DataFrame) -> DataFrame:
    """(target, p_origin, p_outside, entropy, top) of chains (target, depth, round_file, fault in 0..1)."""
    by = chains.groupBy("target").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "round_file", "fault"))).alias("c"))
    p = origin_posterior(F.transform("c", lambda x: x["fault"]))
    x = by.withColumn("_p", p).withColumn("p_origin", F.slice("_p", F.lit(1), F.size("c"))).withColumn("p_outside", F.element_at("_p", -1))
    best = F.array_position("p_origin", F.array_max("p_origin"))
    top = F.when(F.col("p_outside") > F.array_max("p_origin"), "outside_chain").otherwise(F.element_at("c", best.cast("int"))["round_file"])
    return x.select("target", "p_origin", "p_outside", entropy(F.col("_p")).alias("entropy"), top.alias("top"))


def _over(clean: Column, s: Column, mass: Column) -> Column:
    """The sum of p ln p of a stretch whose chances all shrink by `clean`, as older links may be the origin before it."""
    return clean * s + F.when(clean > 0, clean * F.log(clean)).otherwise(0.0) * mass


def origin_profiles(targets: DataFrame, rounds: DataFrame) -> DataFrame:
    """(target, length, p_outside, entropy, top, p_last) of each target's chain: what origin_profile tells of it, without the chains.

    targets (target), rounds (round_file, parentId, fault in 0..1; null counts as 0).
    What a stretch of a chain tells can be combined with that of the stretch above
    it, as a link's share depends on older links alone. So each round has a row with
    the sums of its stretch and the round above it, and a step doubles all
    stretches: about n log n rows for n rounds, whatever the chains' lengths. Of
    equal chances the oldest link is the top. Targets that aren't stored have no row.
    Where parents run in a circle no stretch ends; the targets that lead there, which
    are found after log2 n steps, walk their chains link by link.
    """
    fault = F.coalesce("fault", F.lit(0.0))
    known = rounds.select(F.col("round_file").alias("_known")).distinct()
    start = rounds.join(known, F.col("parentId") == F.col("_known"), "left").select(
        "round_file", F.col("_known").alias("up"), F.lit(1).cast("long").alias("length"), (1 - fault).alias("clean"), fault.alias("mass"),
        F.when(fault > 0, fault * F.log(fault)).otherwise(0.0).alias("s"), fault.alias("most"), F.col("round_file").alias("best"), fault.alias("last"),
    )
    at = _kept(start)
    n, steps, going = at[0].count(), 0, at[0].where("up is not null").count()
    while going and 1 << steps <= 2 * n:
        old = at[0].select(*[F.col(c).alias("o_" + c) for c in at[0].columns])
        both = at[0].where("up is not null").join(old, F.col("up") == F.col("o_round_file"))
        c, older = F.col("o_clean"), F.col("o_most") >= F.col("o_clean") * F.col("most")
        doubled = both.select(
            "round_file", F.col("o_up").alias("up"), (F.col("length") + F.col("o_length")).alias("length"), (c * F.col("clean")).alias("clean"), (F.col("o_mass") + c * F.col("mass")).alias("mass"),
            (F.col("o_s") + _over(c, F.col("s"), F.col("mass"))).alias("s"), F.greatest("o_most", c * F.col("most")).alias("most"), F.when(older, F.col("o_best")).otherwise(F.col("best")).alias("best"),
            (c * F.col("last")).alias("last"),
        )
        more = _kept(doubled.unionByName(at[0].where("up is null")))
        _drop(at)
        at, steps, going = more, steps + 1, more[0].where("up is not null").count()
    found = targets.select("target").distinct().join(at[0], F.col("target") == F.col("round_file"))
    outside = F.when(F.col("clean") > 0, F.col("clean") * F.log("clean")).otherwise(0.0)
    top = F.when(F.col("clean") > F.col("most"), "outside_chain").otherwise(F.col("best"))
    out = found.where("up is null").select("target", "length", F.col("clean").alias("p_outside"), (-(F.col("s") + outside)).alias("entropy"), top.alias("top"), F.col("last").alias("p_last"))
    if not going:
        return out
    links = walk_chain(found.where("up is not null").select("target"), rounds).join(rounds.select("round_file", fault.alias("fault")), "round_file")
    p = origin_profile(links)
    round_trips = p.select("target", F.size("p_origin").cast("long").alias("length"), "p_outside", "entropy", "top", F.element_at("p_origin", -1).alias("p_last"))
    return out.unionByName(round_trips)


def flag(frustration: Column, correction: Column, frustrated: float = 3.0, corrected: float = 0.7) -> Column:
    """Rounds to examine: the user is frustrated, or corrects a failed recall."""
    return (F.coalesce(frustration, F.lit(0.0)) >= frustrated) | (F.coalesce(correction, F.lit(0.0)) >= corrected)


def best_type(probabilities: Column) -> Column:
    """Key of a map's largest value; ties to the first entry."""
    entries = F.map_entries(probabilities)
    values = F.transform(entries, lambda e: e["value"])
    return F.element_at(entries, F.array_position(values, F.array_max(values)).cast("int"))["key"]


def verdict_bin(revised: Column, verdict: Column, fault_type: Column) -> Column:
    """The bin of a judged round: a revised type wins; else the verdict's, a fault that was seen by its type."""
    seen = F.when(verdict == "fault_observed", F.coalesce(F.nullif(fault_type, F.lit("")), F.lit("ambiguous")))
    plain = F.when(verdict == "no_fault_within_round", "no-fault-within-round").when(verdict == "external", "external")
    return F.coalesce(F.nullif(revised, F.lit("")), plain, seen, F.lit("ambiguous"))
