"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow network
routes each pattern's token capacity to the sources' quotas; the r-th pass over a pattern costs more
than the one before (convex repetition cost), so fresh text is always used before repeats. Only
pattern totals reach the driver, at most `max_patterns`. With more, a source that no overlap touches is planned on the
executors, as its one pattern meets its one quota, and only overlapping ones reach the driver. The documents
that make up each pattern's flow are then picked in seeded hash order on the executors: in buckets of hashes up to the one
in which the flow ends, and one by one within that. Equal hashes (repeated rows) count as one group there, however many
they are. Documents of all other buckets are decided where they stand, without a shuffle.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import few_rows, save, unpacked, word_count

Source = str | None
_END = object()  # None is a source


def fair_targets(sizes: Mapping[Source, int], weights: Mapping[Source, float], cap: float = 3.0) -> dict[Source, float]:
    """Share the sum of sizes by weight; a target stops at cap x its source's size and the excess is shared again."""
    left, free, out = float(sum(sizes.values())), list(sizes), {}
    while free:
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / total for s in free}
        out |= {s: float(cap * sizes[s]) for s in over}
        left -= sum(cap * sizes[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def cycling_weights(sources: Iterable[Source], cycle: tuple[int, ...] = (1, 2, 3)) -> dict[Source, int]:
    """Sources by code point, null last, weigh 1, 2, 3 and so on in turn."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def route(capacity: Mapping[tuple[Source, ...], int], quotas: Mapping[Source, int], max_repeats: int) -> dict[tuple[Source, ...], dict[Source, int]]:
    """Min-cost flow pattern -> source -> sink.

    Arc start -> pattern has one lane per repetition, each of the pattern's capacity, at a cost rising
    with the repetition. A path to the sink uses exactly one such lane and nothing else costs
    anything, so successive shortest paths are: open the lanes of one repetition at a time and
    push all the flow that fits (blocking flows over shortest augmenting paths) before the next.
    """
    flow: dict[tuple[Source, ...], dict[Source, int]] = {p: dict.fromkeys((s for s in p if s in quotas), 0) for p in capacity}
    members: dict[Source, list[tuple[Source, ...]]] = {}
    for p, to in flow.items():
        for s in to:
            members.setdefault(s, []).append(p)
    room = dict(quotas)
    for _ in range(max_repeats):
        lane = {p: c for p, c in capacity.items() if c > 0 and flow[p]}
        while True:
            # Distance from the start: patterns with a free lane, then sources, then patterns whose flow can be taken back.
            level: dict = {("p", p): 0 for p, c in lane.items() if c > 0}
            queue, ends = deque(level), False
            while queue:
                kind, x = queue.popleft()
                for nxt in [("s", s) for s in flow[x]] if kind == "p" else [("p", p) for p in members[x] if flow[p][x] > 0]:
                    if nxt not in level:
                        level[nxt] = level[kind, x] + 1
                        queue.append(nxt)
                ends |= kind == "s" and room[x] > 0
            if not ends:
                break
            arcs = {v: iter(list(flow[v[1]]) if v[0] == "p" else members[v[1]]) for v in level}
            for p in [p for p, c in lane.items() if c > 0]:
                path = [("p", p)]
                while path:
                    kind, x = path[-1]
                    if kind == "s" and room[x] > 0:
                        push = min(lane[p], room[x], *(flow[path[i + 1][1]][path[i][1]] for i in range(1, len(path) - 1, 2)))
                        for i in range(0, len(path) - 1, 2):
                            flow[path[i][1]][path[i + 1][1]] += push
                        for i in range(1, len(path) - 1, 2):
                            flow[path[i + 1][1]][path[i][1]] -= push
                        lane[p] -= push
                        room[x] -= push
                        if lane[p] == 0:
                            break
                        path = [("p", p)]
                        continue
                    nxt = next(arcs[kind, x], _END)
                    if nxt is _END:
                        path.pop()
                        continue
                    step = ("s", nxt) if kind == "p" else ("p", nxt)
                    if level.get(step) == level[kind, x] + 1 and (kind == "p" or flow[nxt][x] > 0):
                        path.append(step)
    return flow


def _pattern(sources: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string"))))))


def _bits(rows: int, per_bucket: int) -> int:
    """How many bits of the hash tell the buckets of so many rows apart."""
    return min(20, max(0, (rows // per_bucket).bit_length()))


_PLAN = "pattern string, n long, passes long, rest long, bits int, source_size long, target double"


def _plan_few(rows: list[Row], size_of: Mapping[Source, int], targets: Mapping[Source, float], max_repeats: int, per_bucket: int) -> list[tuple]:
    """Rows of _PLAN for patterns whose flow is solved together, on the driver."""
    sources = {r.pattern: tuple(json.loads(r.pattern)) for r in rows}
    flow = route({sources[r.pattern]: r["size"] for r in rows}, {s: round(t) for s, t in targets.items()}, max_repeats)
    out = []
    for r in rows:
        members = sources[r.pattern]
        words = sum(flow[members].values())
        passes, rest = divmod(words, r["size"]) if r["size"] else (0, 0)
        first = members[0] if members else None
        out.append((r.pattern, r["n"], passes, rest, _bits(r["n"], per_bucket), size_of.get(first, 0), targets.get(first, 0.0)))
    return out


def _numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df, written, with i: each row's place in order from 0, without passing all rows through one task."""
    rows = save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("r", F.monotonically_increasing_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = rows.groupBy(F.shiftright("r", 33).alias("part")).agg(F.count("*").alias("m")).withColumn("start", F.coalesce(F.sum("m").over(before), F.lit(0)))
    met = rows.withColumn("part", F.shiftright("r", 33)).join(F.broadcast(starts), "part")
    return met.select(*df.columns, (F.col("r") % 2**33 + F.col("start")).alias("i"))


def _fair_table(sizes: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """fair_targets() over cycling_weights() for a table (source, size) of any length: adds target. A round is one aggregate."""
    order = F.col("source").isNull(), F.col("source")
    own = save(_numbered(sizes, *order).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int"))))
    most = F.col("size") * F.lit(float(cap))
    everything = own.agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    left, total, held = float(everything["size"] or 0), everything["weight"] or 0, 0
    while total:
        over = most < F.lit(left) * F.col("weight") / F.lit(total)
        r = own.agg(F.count_if(over).alias("n"), F.sum(F.when(over, most)).alias("size"), F.sum(F.when(over, F.col("weight"))).alias("weight")).first()
        if r["n"] == held:
            break
        left, total, held = everything["size"] - r["size"], everything["weight"] - r["weight"], r["n"]
    fair = F.lit(left) * F.col("weight") / F.lit(total) if total else most
    return own.select("source", "size", F.least(most, fair).alias("target"))


def _plan_many(patterns: DataFrame, quotas: Mapping[Source, int] | None, weights: tuple[int, ...], max_repeats: int, max_patterns: int, per_bucket: int) -> DataFrame:
    """The plan for more patterns than the driver takes. A source that no overlap touches has a flow of its own: its one pattern meets its one quota."""
    spark = patterns.sparkSession
    own = patterns.withColumn("members", F.from_json("pattern", "array<string>"))
    size_of = own.select(F.explode("members").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("size"))
    if quotas is None:
        sources = save(_fair_table(size_of, weights, max_repeats))
    else:
        given = few_rows(spark, [(s, float(q)) for s, q in quotas.items()], "source string, target double")
        sources = save(size_of.join(given, size_of.source.eqNullSafe(given.source), "left").select(size_of.source, "size", F.coalesce("target", F.lit(0.0)).alias("target")))
    tied = save(own.where(F.size("members") > 1).select(F.explode("members").alias("tied")).distinct())
    sources = sources.join(tied, sources.source.eqNullSafe(tied.tied), "left").select("source", F.col("size").alias("source_size"), "target", F.col("tied").isNotNull().alias("known"))
    null_tied = not tied.where("tied is null").isEmpty()  # a null source is tied by a row that holds null
    sources = save(sources.withColumn("known", F.when(F.col("source").isNull(), F.lit(null_tied)).otherwise(F.col("known"))))
    first = F.when(F.size("members") > 0, F.get("members", F.lit(0)))
    met = own.withColumn("first", first).join(sources, F.col("first").eqNullSafe(sources.source), "left")
    together = (F.size("members") > 1) | F.coalesce("known", F.lit(False)) & (F.size("members") == 1)
    rows = met.where(together).select("pattern", "size", "n").limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"more than {max_patterns} distinct sets of sources overlap")
    known = {r.source: r for r in sources.where("known").collect()}  # members of the rows above
    targets = {s: r.target for s, r in known.items() if quotas is None or s in quotas}
    solved = _plan_few(rows, {s: r.source_size for s, r in known.items()}, targets, max_repeats, per_bucket)
    words = F.when(F.size("members") == 0, F.lit(0)).otherwise(F.least(F.rint("target").cast("long"), F.col("size") * max_repeats))
    share = F.floor(F.col("n") / per_bucket).cast("long")
    bits = F.when(share > 0, F.least(F.lit(20), F.length(F.bin(share)))).otherwise(F.lit(0))
    parts = [F.expr("words div size"), F.expr("words % size")]
    passes, rest = [F.when(F.col("size") > 0, x).otherwise(F.lit(0)).cast("long") for x in parts]
    alone = met.where(~together).withColumn("words", words)
    alone = alone.select("pattern", "n", passes.alias("passes"), rest.alias("rest"), bits.cast("int").alias("bits"), F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"))
    return save(alone.unionByName(few_rows(spark, solved, _PLAN)))


def _meet(rows: DataFrame, plan: DataFrame, hot_rows: int | None) -> DataFrame:
    """rows joined with plan on pattern. A plan of max_patterns at most (no hot_rows) is broadcast; of a longer one, the few patterns of that many rows, so that none is hot in the shuffle of the rest."""
    if hot_rows is None:
        return rows.join(F.broadcast(plan.drop("n")), "pattern")
    hot = plan.where(F.col("n") >= hot_rows).drop("n")
    rest = rows.join(F.broadcast(hot.select("pattern")), "pattern", "left_anti").join(plan.where(F.col("n") < hot_rows).drop("n"), "pattern")
    return rows.join(F.broadcast(hot), "pattern").unionByName(rest)


def _decide(slim: DataFrame, quotas: Mapping[Source, int] | None, weights: tuple[int, ...], max_repeats: int, max_patterns: int, per_bucket: int, payload: str) -> DataFrame:
    """slim, written: payload, size, pattern, h, r (unique). Returns payload, size, pattern, repeats long, source_size long, target double."""
    spark = slim.sparkSession
    patterns = slim.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    rows = patterns.limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        patterns = save(patterns)
        plan = _plan_many(patterns, quotas, weights, max_repeats, max_patterns, per_bucket)
        hot_rows = max(1, patterns.agg(F.sum("n")).first()[0] // 1000)  # 1,000 patterns can have as many
    else:
        size_of: dict[Source, int] = {}
        for r in rows:
            for s in json.loads(r.pattern):
                size_of[s] = size_of.get(s, 0) + r["size"]
        if quotas is None:
            targets = fair_targets(size_of, cycling_weights(size_of, weights), max_repeats)
        else:
            targets = {s: float(q) for s, q in quotas.items()}
        plan, hot_rows = few_rows(spark, _plan_few(rows, size_of, targets, max_repeats, per_bucket), _PLAN), None

    bucket = F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(h, 64 - bits)"))
    dealt = _meet(slim, plan, hot_rows).withColumn("bucket", bucket)
    upto = Window.partitionBy("pattern").orderBy("bucket")
    edge = (
        dealt.groupBy("pattern", "bucket", "rest")
        .agg(F.sum("size").alias("words"))
        .withColumn("upto", F.sum("words").over(upto))
        .where("upto > rest and upto - words <= rest")
        .select("pattern", F.col("bucket").alias("edge"), (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))
    )
    dealt = _meet(dealt, plan.select("pattern", "n").join(edge, "pattern", "left"), hot_rows)
    clear = dealt.where("edge is null or bucket != edge").withColumn("extra", F.when(F.col("bucket") < F.col("edge"), 1).otherwise(0))
    on_edge = dealt.where("bucket = edge")
    met = on_edge.join(_edge_extras(on_edge), "r")
    out = [payload, "size", "pattern", "passes", "source_size", "target", F.col("extra").cast("long").alias("extra")]
    repeats = F.when(F.col("size") > 0, F.col("passes") + F.col("extra")).otherwise(F.lit(0)).cast("long")
    return clear.select(*out).unionByName(met.select(*out)).select(payload, "size", "pattern", repeats.alias("repeats"), "source_size", "target")


def _edge_extras(on_edge: DataFrame) -> DataFrame:
    """r, extra (0 or 1) of the rows in boundary buckets. Only groups of equal rows meet in one task, each as a count."""
    key = ["pattern", "h", "size"]
    groups = on_edge.groupBy(*key, "left").agg(F.count("*").alias("n"))
    out = T.StructType([*groups.select(*key, "n").schema.fields, T.StructField("take", T.LongType())])
    filled = save(groups.groupBy("pattern").applyInPandas(_fill, out))
    rows = on_edge.select(*key, "r").join(filled, key)
    sure = rows.where("take = 0 or take = n").select("r", F.when(F.col("take") > 0, 1).otherwise(0).alias("extra"))
    # A group of which some are taken: those of the smallest r. r holds the partition and the place in it, so a window holds the rows of one partition.
    some = rows.where("take > 0 and take < n").withColumn("part", F.shiftright("r", 33))
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = some.groupBy(*key, "part").agg(F.count("*").alias("m")).withColumn("start", F.coalesce(F.sum("m").over(before), F.lit(0))).select(*key, "part", "start")
    place = F.row_number().over(Window.partitionBy(*key, "part").orderBy("r")) + F.col("start")
    ranked = some.join(starts, [*key, "part"]).withColumn("place", place)
    return sure.unionByName(ranked.select("r", F.when(F.col("place") <= F.col("take"), 1).otherwise(0).alias("extra")))


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Take groups of one boundary bucket in hash order while they fit, then one document more if that comes nearer."""
    rows = rows.sort_values(["h", "size"], kind="stable").reset_index(drop=True)
    left, take = int(rows["left"].iloc[0]), []
    for size, n in zip(rows["size"], rows["n"]):
        take.append(min(int(n), left // int(size)) if size else int(n))
        left -= int(size) * take[-1]
    spare = [i for i, (t, n, size) in enumerate(zip(take, rows["n"], rows["size"])) if t < n and size > 0]
    if spare:
        best = min(spare, key=lambda i: (abs(left - rows["size"][i]), i))
        take[best] += int(abs(left - rows["size"][best]) < left)
    return rows[["pattern", "h", "size", "n"]].assign(take=take)


def _slim(payload: Column, doc_id: Column, size: Column, sources: Column, tie: Column, seed: int) -> list[Column]:
    size = F.coalesce(size, F.lit(0)).cast("long")
    return [payload.alias("payload"), size.alias("size"), _pattern(sources).alias("pattern"), F.xxhash64(F.lit(seed), doc_id, size, tie).alias("h"), F.monotonically_increasing_id().alias("r")]


def mix(docs: DataFrame, quotas: Mapping[Source, int] | None = None, *, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 17, max_patterns: int = 50_000, per_bucket: int = 256, tie: str | None = None) -> DataFrame:
    """Choose how often each document is taken so that every source comes near its quota.

    docs: doc_id long, size long, sources array<string>. quotas: words by source; left out, all words
    are shared by `weights` (see fair_targets), which needs one source a document. Returns doc_id,
    size, sources, repeats long, taken long, source_size long and target double of the first source.

    Null size or sources count as 0 and as [null]; an empty array belongs nowhere and is not taken.
    Repeated rows are separate documents. An empty table gives no rows. Sources may be as many as rows; more than
    max_patterns source sets that overlap raise ValueError: their flow is solved on the driver. tie names a column that tells
    documents of one id and size apart.
    """
    slim = save(docs.select(*_slim(F.col("doc_id"), F.col("doc_id"), F.col("size"), F.col("sources"), F.col(tie) if tie else F.lit(None).cast("long"), seed)))
    done = _decide(slim, quotas, weights, max_repeats, max_patterns, per_bucket, "payload")
    taken = (F.col("repeats") * F.col("size")).alias("taken")
    return done.select(F.col("payload").alias("doc_id"), "size", F.from_json("pattern", "array<string>").alias("sources"), "repeats", taken, "source_size", "target")


def mix_documents(documents: DataFrame, **options) -> DataFrame:
    """mix() over documents(doc_id, source, text), each a member of its one source; size is the number of words in text (0 for null)."""
    own = documents.select("doc_id", word_count(F.col("text")).alias("size"), F.array("source").alias("sources"), F.xxhash64("text").alias("tie"))
    return mix(own, tie="tie", **options)


def repeat_documents(documents: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 17, max_patterns: int = 50_000, per_bucket: int = 256) -> DataFrame:
    """documents with each row as often as mix_documents() takes it; rows without words are never taken. Columns stay, whatever their names."""
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    slim = save(documents.select(*_slim(row, F.col("doc_id"), word_count(F.col("text")), F.array("source"), F.xxhash64("text"), seed)))
    done = _decide(slim, None, weights, max_repeats, max_patterns, per_bucket, "payload").where("repeats > 0")
    each = done.select(F.col("payload").alias("row"), F.explode(F.expr("sequence(1, int(repeats))")).alias("time"))
    return unpacked(each, documents)
