"""P3: splits that keep related records together.

1. Records are reduced to a bipartite graph of recordings and speaker codes; equal edges are one.
2. Components come from Boruvka rounds. Every component selects its least incident edge under one
   total order of the edges, so the selected edges of a round hold no cycle but mutual choices;
   they join the spanning forest, which is kept as tables in the shared folder. The components
   they tie are found by pointer jumping and contracted: edges are relabelled, inner and parallel
   edges dropped. Each round at least halves the components that still have edges.
3. Roots are stratified by size band (the power of two of their number of records) and dealt to
   the splits systematically within each band.

Every step is a join or an aggregation keyed by component; no group is collected. A hub with very
many neighbours is pre-aggregated before each shuffle (min of struct), and each round contracts it.

Defined results: a record without id takes no part; an id without the separator is its own
recording; records delivered twice count once; codes are compared as ``speaker_code`` gives them.
An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.storage import stored

CODE, RECORDING = "c:", "r:"


def speaker_code(speaker: Column) -> Column:
    """The code without outer blanks, in upper case, without a leading SPK and its mark; NULL if it is missing."""
    bare = F.upper(F.regexp_replace(speaker, r"^\s+|\s+$", ""))
    code = F.regexp_replace(bare, "^SPK[-_:]", "")
    return F.when((code != "") & (code != "UNKNOWN"), code)


def record_ties(rows: DataFrame) -> DataFrame:
    """(utt_id, recording, codes): one row per record."""
    own = F.when(F.col("dataset") == "l2arctic", speaker_code(F.get(F.split("utt_id", "_", -1), F.lit(1))))
    return (
        rows.filter(F.col("utt_id").isNotNull())
        .select("utt_id", F.regexp_replace("utt_id", "_[^_]*$", "").alias("recording"), speaker_code(F.col("speaker")).alias("said"), own.alias("own"))
        .groupBy("utt_id", "recording")
        .agg(F.array_compact(F.array_union(F.collect_set("said"), F.collect_set("own"))).alias("codes"))
    )


def _roots(parent: DataFrame, round_: int) -> DataFrame:
    """(v, up) with every pointer at a root. A job doubles the pointers' reach twice; all are at
    roots once the last doubling moves none."""
    step = 0
    while True:
        step += 1
        for _ in range(2):
            a, b = parent.alias("a"), parent.alias("b")
            parent = a.join(b, F.col("a.up") == F.col("b.v"), "left").select("a.v", F.coalesce("b.up", "a.up").alias("up"), F.col("a.up").alias("was"))
        parent = stored(parent, f"roots-{round_}-{step}")
        if parent.filter("up <> was").isEmpty():
            return parent.drop("was")
        parent = parent.drop("was")


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(v, root) for every vertex with an edge, and the forest (u, v) of selected edges.

    ``edges`` has string columns u and v. Vertices get 64-bit ids once; names come back with the result.
    """
    spark = edges.sparkSession
    edges = edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = stored(edges, "edges")
    names = edges.select(F.explode(F.array("u", "v")).alias("name")).distinct()
    # ids in a hashed order: selected edges then form shallow trees with high probability
    names = stored(names.repartition(F.xxhash64("name")).sortWithinPartitions(F.xxhash64("name")).withColumn("id", F.monotonically_increasing_id()), "vertices")
    end = lambda c, to: names.select(F.col("name").alias(c), F.col("id").alias(to))
    # a, b: components; i, j: the edge's own ends
    live = edges.join(end("u", "i"), "u").join(end("v", "j"), "v").select(F.col("i").alias("a"), F.col("j").alias("b"), "i", "j")
    live = stored(live, "live-0")
    tops: list[DataFrame] = []
    forest: DataFrame | None = None
    round_ = 0
    while not live.isEmpty():
        round_ += 1
        # total order of the contracted edges: their ends; parallel edges were reduced to one
        both = live.select(F.col("a").alias("c"), F.col("b").alias("to"), "i", "j").union(live.select("b", "a", "i", "j"))
        key = F.struct(F.least("c", "to").alias("lo"), F.greatest("c", "to").alias("hi"), "to", "i", "j")
        chosen = stored(both.groupBy("c").agg(F.min(key).alias("m")).select("c", "m.to", "m.i", "m.j"), f"chosen-{round_}")
        picked = chosen.select("i", "j").distinct()
        forest = picked if forest is None else forest.unionByName(picked)
        # mutual choices: the smaller label is the root
        x, y = chosen.alias("x"), chosen.alias("y")
        mutual = (F.col("y.to") == F.col("x.c")) & (F.col("x.c") < F.col("x.to"))
        parent = x.join(y, F.col("x.to") == F.col("y.c")).select(F.col("x.c").alias("v"), F.when(mutual, F.col("x.c")).otherwise(F.col("x.to")).alias("up"))
        top = _roots(parent, round_)
        tops.append(top)
        of = lambda c: top.select(F.col("v").alias(c), F.col("up").alias(f"r{c}"))
        live = (
            live.join(of("a"), "a").join(of("b"), "b").filter("ra <> rb")
            .groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .agg(F.min(F.struct("i", "j")).alias("e"))
            .select("a", "b", "e.i", "e.j")
        )
        live = stored(live, f"live-{round_}")
    if not tops:
        return spark.createDataFrame([], "v string, root long"), edges
    label = tops[0].select(F.col("v").alias("id"), F.col("up").alias("root"))
    for k, top in enumerate(tops[1:], 2):
        label = label.join(top.select(F.col("v").alias("root"), F.col("up").alias("above")), "root", "left").select("id", F.coalesce("above", "root").alias("root"))
        if k % 4 == 0:  # keep the plan short
            label = stored(label, f"label-{k}")
    back = lambda c, to: names.select(F.col("id").alias(c), F.col("name").alias(to))
    return names.join(label, "id").select(F.col("name").alias("v"), "root"), forest.join(back("i", "u"), "i").join(back("j", "v"), "j").select("u", "v")


def related_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(utt_id, group_key) for every record, and the spanning forest, whose rounds are stored."""
    ties = stored(record_ties(rows), "ties")
    edges = ties.select(F.concat(F.lit(RECORDING), "recording").alias("u"), F.explode("codes").alias("code")).select("u", F.concat(F.lit(CODE), "code").alias("v"))
    label, forest = spanning_forest(edges)
    # vertices' names carry their kind; 'c:' < 'r:', so the least name is a code if there is one
    keys = label.groupBy("root").agg(F.min("v").alias("key"))
    of = label.filter(F.col("v").startswith(RECORDING)).join(keys, "root").select(F.substring("v", 3, 1 << 30).alias("recording"), F.substring("key", 3, 1 << 30).alias("group_key"))
    return ties.select("utt_id", "recording").join(of, "recording", "left").select("utt_id", F.coalesce("group_key", "recording").alias("group_key")), forest


def deal(groups: DataFrame, shares: dict[str, float], big: float = 0.02, per_bucket: int = 10_000) -> DataFrame:
    """(group_key, size, split) for groups (group_key, size).

    Groups over the share ``big`` of all records (at most 1 / big of them) go one by one to the
    split with the most room. All others are dealt within their size band, in hashed order, by
    systematic sampling with what room is left: the split of a band's groups differs from its share by a few
    groups a bucket, so the shares come out exact up to a few groups of each band and the large ones. A
    large band is dealt in buckets, each from a start of its own, so that no task ranks a whole band.
    """
    band = F.floor(F.log2("size"))
    bands = groups.groupBy(band.alias("band")).agg(F.count("*").alias("c"), F.sum("size").alias("n")).collect()  # one row per power of two
    total = sum(b.n for b in bands)
    names = list(shares)
    room = {s: shares[s] * total for s in names}
    over = max(1.0, big * total)
    large = groups.filter(F.col("size") > over).orderBy(F.desc("size"), "group_key").collect() if any(b.n > over for b in bands) else []
    fixed: dict[str, str] = {}
    for g in large:
        to = max(names, key=lambda s: (room[s], -names.index(s)))
        fixed[g.group_key] = to
        room[to] -= g.size
    left = {s: max(0.0, room[s]) for s in names}
    whole = sum(left.values()) or 1.0
    bounds, at = [], 0.0
    for s in names:
        at += left[s] / whole
        bounds.append(at)
    rest = groups.filter(F.col("size") <= over).withColumn("band", band)
    buckets = F.coalesce(F.create_map(*[x for b in bands for x in (F.lit(b.band), F.lit(math.ceil(b.c / per_bucket)))])[F.col("band")], F.lit(1)) if bands else F.lit(1)
    rest = rest.withColumn("h", F.xxhash64("group_key")).withColumn("bucket", F.pmod("h", buckets))
    rank = F.row_number().over(Window.partitionBy("band", "bucket").orderBy("h", "group_key"))
    # low-discrepancy deal: rank * golden ratio mod 1 is spread evenly over the splits' intervals
    start = F.pmod(F.col("bucket") * 0.7548776662466927 + F.col("band") * 0.5698402909980532, F.lit(1.0))
    place = F.pmod(rank * 0.6180339887498949 + start, F.lit(1.0))
    split = F.when(place < bounds[0], names[0])
    for s, b in zip(names[1:], bounds[1:]):
        split = split.when(place < b, s)
    rest = rest.select("group_key", "size", split.otherwise(names[-1]).alias("split"))
    if not fixed:
        return rest
    to = F.create_map(*[F.lit(x) for pair in fixed.items() for x in pair])
    return rest.unionByName(groups.filter(F.col("group_key").isin(list(fixed))).select("group_key", "size", to[F.col("group_key")].alias("split")))


def assign_splits(rows: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """(utt_id, group_key, split): every record, all of a group in one split."""
    of = stored(related_groups(rows)[0], "groups")
    dealt = deal(stored(of.groupBy("group_key").agg(F.count("*").alias("size")), "group-sizes"), shares or {"train": 0.8, "validation": 0.1, "test": 0.1})
    return of.join(dealt.select("group_key", "split"), "group_key").select("utt_id", "group_key", "split")
