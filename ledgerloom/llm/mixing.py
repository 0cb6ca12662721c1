"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them; a plain source column is the case
of one). Patterns are the supply: each can be taken up to max_repeats times, and each unit of the k-th pass costs
`pass_cost(k)`, which rises with k, so the costs are convex and repetition is spread as evenly as the quotas allow.
Sources are the demand: their quotas are their weights' shares of the total size, held to max_repeats times their own
size, the rest shared again by weight. Flow goes from patterns to the quotas of their sources.

`route` finds a maximum flow of least cost by successive shortest paths. Only the edges that supply a pattern cost
anything, and no shortest path leads back through one, so all paths of the k-th pass cost pass_cost(k): passes are
routed in turn, each by a maximum flow (Dinic's, which may move earlier flow between sources).

Patterns that share no source, even over others, don't affect each other. A pattern of one source that stands in no
other pattern needs no flow: it takes its quota. So with a plain source column everything is joins, however many
sources there are; only patterns that overlap go to the solver, one task for each set of patterns that hang together.
Its time and memory grow with the number of patterns in such a set, not with documents.

Each pattern's flow is then met by documents: all of them `whole` times, and a seeded part of them once more. The
part is a prefix of the pattern's documents in the order of a seeded hash, cut where the remainder is met. The cut is
found from a histogram of BINS hash ranges per pattern, and only the range with the cut is looked at document by
document. Rows equal in id and text are one entry with a count, and the cut may part them. So the taken size misses the
flow by at most half a document for each pattern.

Defined results: null text has size 0; documents of size 0 are never taken; a null source is a source of its own, last in order;
repeated rows are documents of their own; reruns agree, since ties in the hash are broken by id, and of equal rows it doesn't
matter which are taken; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.scratch import materialize

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 17
BINS = 1 << 12
SMALL = 10_000  # rows that may be broadcast


def word_count(text: Column) -> Column:
    """The number of runs of characters other than space and U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pass_cost(k: int) -> float:
    """The cost of a unit of a pattern's k-th pass."""
    return float(k)


def targets(sizes: list[int], weights: list[float], max_repeats: float = MAX_REPEATS, total: float | None = None) -> list[float]:
    """Shares of the total by weight, none above max_repeats times its size; what is above is shared again by weight."""
    out = [0.0] * len(sizes)
    open_at = [i for i, s in enumerate(sizes) if s > 0]
    left = float(sum(sizes) if total is None else total)
    while open_at:
        whole = sum(weights[i] for i in open_at)
        over = [i for i in open_at if left * weights[i] / whole > max_repeats * sizes[i]]
        if not over:
            for i in open_at:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = float(max_repeats * sizes[i])
        left -= sum(out[i] for i in over)
        closed = set(over)
        open_at = [i for i in open_at if i not in closed]
    return out


class _Flow:
    """Patterns, sources and what flows between them. Rooms are real numbers; less than TINY counts as nothing."""

    TINY = 1e-9

    def __init__(self, patterns: list[tuple], quotas: dict):
        self.names = sorted(quotas, key=lambda s: (s is None, s or ""))
        number = {s: i for i, s in enumerate(self.names)}
        self.of = [[number[s] for s in p if s in number] for p in patterns]
        self.holders: list[list[int]] = [[] for _ in self.names]
        for i, sources in enumerate(self.of):
            for s in sources:
                self.holders[s].append(i)
        self.left = [float(quotas[s]) for s in self.names]
        self.flow = [dict.fromkeys(sources, 0.0) for sources in self.of]

    def levels(self, room: list[float]) -> tuple[list[int], list[int]] | None:
        """Distances of patterns and sources from the patterns with room, or None if no source with a quota left is in reach."""
        far_p, far_s = [-1] * len(self.of), [-1] * len(self.names)
        front = [p for p, r in enumerate(room) if r > self.TINY]
        for p in front:
            far_p[p] = 0
        depth, found = 0, False
        while front and not found:
            sources = []
            for p in front:
                for s in self.of[p]:
                    if far_s[s] < 0:
                        far_s[s] = depth + 1
                        sources.append(s)
                        found = found or self.left[s] > self.TINY
            front = []
            for s in sources:
                for q in self.holders[s]:
                    if far_p[q] < 0 and self.flow[q][s] > self.TINY:
                        far_p[q] = depth + 2
                        front.append(q)
            depth += 2
        return (far_p, far_s) if found else None

    def push(self, start: int, room: float, far: tuple[list[int], list[int]], next_s: list[int], next_p: list[int]) -> float:
        """One path from a pattern along the levels to a quota; places that are used up are not looked at again."""
        far_p, far_s = far
        path = [start]  # pattern, source, pattern, source ...
        while path:
            p = path[-1]
            while next_s[p] < len(self.of[p]):
                s = self.of[p][next_s[p]]
                if far_s[s] == far_p[p] + 1:
                    if self.left[s] > self.TINY:
                        path.append(s)
                        return self._carry(path, min(room, self.left[s]))
                    while next_p[s] < len(self.holders[s]):
                        q = self.holders[s][next_p[s]]
                        if far_p[q] == far_s[s] + 1 and self.flow[q][s] > self.TINY:
                            break
                        next_p[s] += 1
                    else:
                        next_s[p] += 1
                        continue
                    path += [s, self.holders[s][next_p[s]]]
                    break
                next_s[p] += 1
            else:
                path.pop()
                if path:
                    next_p[path.pop()] += 1
        return 0.0

    def _carry(self, path: list[int], amount: float) -> float:
        for s, q in zip(path[1:-1:2], path[2::2], strict=True):
            amount = min(amount, self.flow[q][s])
        for k in range(0, len(path), 2):
            self.flow[path[k]][path[k + 1]] += amount
            if k:
                self.flow[path[k]][path[k - 1]] -= amount
        self.left[path[-1]] -= amount
        return amount


def route(supply: dict[tuple, float], quotas: dict, max_repeats: int = MAX_REPEATS) -> tuple[dict[tuple, float], float]:
    """The size to take of each pattern, and the cost: a maximum flow of least cost from patterns to their sources' quotas."""
    patterns = sorted(supply, key=lambda p: [(s is None, s or "") for s in p])
    net, taken, cost = _Flow(patterns, quotas), [0.0] * len(patterns), 0.0
    for k in range(1, max_repeats + 1):
        room = [float(supply[p]) for p in patterns]
        while far := net.levels(room):
            next_s, next_p = [0] * len(patterns), [0] * len(net.names)
            for i in range(len(patterns)):
                while room[i] > net.TINY and far[0][i] == 0 and (got := net.push(i, room[i], far, next_s, next_p)) > 0:
                    room[i] -= got
                    taken[i] += got
                    cost += got * pass_cost(k)
    return dict(zip(patterns, taken, strict=True)), cost


def _prepared(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """row (all columns of docs), doc_id, pattern, size, u: a seeded hash of id and text."""
    listed = docs.schema[source_col].dataType.typeName() == "array"
    none = F.array(F.lit(None).cast("string"))
    members = F.coalesce(F.col(source_col).cast("array<string>"), none) if listed else F.array(F.col(source_col).cast("string"))
    pattern = F.array_sort(F.array_distinct(F.when(F.size(members) > 0, members).otherwise(none)))
    text = F.col(text_col).cast("string")
    return docs.select(
        F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), pattern.alias("pattern"), word_count(text).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("u")
    )


def _numbered(sources: DataFrame) -> DataFrame:
    """Adds rank, from 0, in code-point order with null last. Only one row a partition is summed up in one place."""
    parted = sources.repartitionByRange(F.col("named").asc_nulls_last()).sortWithinPartitions(F.col("named").asc_nulls_last())
    parted = materialize(
        parted.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)),
        "numbered"
    )
    counts = parted.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return parted.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("at")).drop("part", "at", "before")


def _with_targets(sources: DataFrame, weights: tuple, max_repeats: int, total: float) -> DataFrame:
    """Adds target, by the rule of `targets`: each round is one aggregate, and only sums come to the driver."""
    weight = F.get(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights)).cast("int"))
    out = sources.withColumn("weight", weight).withColumn("most", (F.col("source_size") * max_repeats).cast("double")).withColumn("capped", F.col("source_size") <= 0)
    left, ratio = float(total), 0.0
    while True:
        out = materialize(out, "targets")
        whole, held, n = out.agg(F.sum(F.when(~F.col("capped"), F.col("weight"))), F.sum(F.when(F.col("capped"), F.col("most"))), F.count_if("capped")).first()
        ratio = (left - (held or 0.0)) / whole if whole else 0.0
        out = out.withColumn("capped", F.col("capped") | (F.col("weight") * ratio > F.col("most")))
        if not whole or out.agg(F.count_if("capped")).first()[0] == n:
            return out.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * ratio)).select("named", "source_size", "target")


def _taken(patterns: DataFrame, sources: DataFrame, max_repeats: int) -> DataFrame:
    """patterns with taken, the size to take of each."""
    if patterns.filter(F.size("pattern") > 1).isEmpty():
        alone = patterns.join(sources, F.element_at("pattern", 1).eqNullSafe(F.col("named")))
        return alone.select("pattern", "size", F.least("target", F.col("size") * max_repeats).alias("taken"))
    links = patterns.select("pattern", F.explode("pattern").alias("named"))
    # Patterns and sources that hang together: components of the graph of each source with the least pattern that holds it.
    least = links.groupBy("named").agg(F.min("pattern").alias("v"))
    edges = links.join(least, links["named"].eqNullSafe(least["named"])).select(F.col("pattern").alias("u"), "v")
    label = materialize(components(edges), "labels").withColumnRenamed("node", "pattern")
    aims = links.join(sources, links["named"].eqNullSafe(sources["named"])).select("pattern", sources["named"], "target")
    aims = aims.groupBy("pattern").agg(F.collect_list(F.struct("named", "target")).alias("aims"))
    sets = patterns.join(label, "pattern", "left").join(aims, "pattern").withColumn("label", F.coalesce("label", "pattern"))

    def solve(frame: pa.Table) -> pa.Table:
        rows = frame.to_pylist()
        quotas = {a["named"]: a["target"] for r in rows for a in r["aims"]}
        taken, _ = route({tuple(r["pattern"]): r["size"] for r in rows}, quotas, max_repeats)
        return pa.table({"pattern": frame["pattern"], "size": frame["size"], "taken": pa.array([taken[tuple(r["pattern"])] for r in rows], pa.float64())})

    return sets.groupBy("label").applyInArrow(solve, "pattern array<string>, size long, taken double")


def _decided(rows: DataFrame, weights: tuple, max_repeats: int):
    """A function that adds times and the first source's source_size and target to a table with rows' columns.

    rows: pattern, size, u and doc_id of all documents. What is joined to them has a row a pattern or a source; it is broadcast
    if it has at most SMALL rows, and joined by key otherwise.
    """
    patterns = materialize(rows.groupBy("pattern").agg(F.sum("size").alias("size")), "patterns")
    sized = patterns.select(F.explode("pattern").alias("named"), "size").groupBy("named").agg(F.sum("size").alias("source_size"))
    sources = materialize(_with_targets(_numbered(sized), weights, max_repeats, patterns.agg(F.sum("size")).first()[0] or 0), "sources")
    small = F.broadcast if patterns.count() <= SMALL and sources.count() <= SMALL else lambda table: table.hint("merge")
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("long")
    plan = _taken(patterns, sources, max_repeats).withColumn("whole", whole).withColumn("rest", F.col("taken") - F.col("size") * F.col("whole"))
    plan = plan.join(small(sources), F.element_at("pattern", 1).eqNullSafe(F.col("named"))).select("pattern", "whole", "rest", "source_size", "target")
    plan = materialize(plan, "plan")

    bin_of = F.floor((F.col("u") / F.lit(2.0**64) + 0.5) * BINS).cast("long")
    binned = rows.filter("size > 0").withColumn("bin", bin_of)
    bins = binned.groupBy("pattern", "bin").agg(F.sum("size").alias("held")).join(small(plan.select("pattern", "rest")), "pattern")
    bins = bins.withColumn("before", F.sum("held").over(Window.partitionBy("pattern").orderBy("bin")) - F.col("held"))
    cut = materialize(bins.filter("before <= rest and before + held > rest").select("pattern", F.col("bin").alias("cut_bin"), "before", "rest"), "cut")
    # Inside the one range with the cut, entry by entry; equal rows are one entry.
    entries = binned.join(small(cut), "pattern").filter("bin = cut_bin").groupBy("pattern", "before", "rest", "u", "doc_id", "size").agg(F.count("*").alias("n"))
    order = Window.partitionBy("pattern").orderBy("u", "doc_id", "size")
    entries = entries.withColumn("start", F.col("before") + F.sum(F.col("size") * F.col("n")).over(order) - F.col("size") * F.col("n"))
    # The last entry of which at least half a row fits, and how many of its rows are taken.
    fit = F.floor((F.col("rest") - F.col("start")) / F.col("size") + 0.5)
    last = entries.withColumn("fit", F.least("n", fit).cast("long")).filter("fit >= 1").groupBy("pattern").agg(
        F.max_by(F.struct("u", "doc_id", "size", "n", "fit"), F.struct("u", "doc_id", "size")).alias("last")
    )
    plan = materialize(plan.drop("rest").join(small(cut.select("pattern", "cut_bin")), "pattern", "left").join(small(last), "pattern", "left"), "plan")

    def attach(table: DataFrame) -> DataFrame:
        entry = F.struct("u", "doc_id", "size")
        of_last = F.struct("last.u", "last.doc_id", "last.size")
        parted = plan.filter("last.fit < last.n").select("pattern", "last")
        fits = F.lit(True)
        if not parted.isEmpty():
            # Rows of an entry that the cut parts are equal, so any `fit` of them will do: the first by their number.
            table = materialize(table.withColumn("number", F.monotonically_increasing_id()), "numbered")
            equal = table.join(small(parted), "pattern").filter(entry.eqNullSafe(of_last)).select("pattern", "number", F.shiftright("number", 33).alias("part"), "last.fit")
            counts = equal.groupBy("pattern", "part", "fit").agg(F.count("*").alias("n"))
            counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("pattern").orderBy("part")) - F.col("n")).filter("before < fit and before + n >= fit")
            at = F.row_number().over(Window.partitionBy("pattern", "part").orderBy("number"))
            upto = equal.join(
                small(counts.select("pattern", "part", "before")), ["pattern", "part"]
            ).withColumn("at", at + F.col("before")).filter("at = fit").select("pattern", F.col("number").alias("upto"))
            table = table.join(small(materialize(upto, "upto")), "pattern", "left")
            fits = F.coalesce(F.col("number") <= F.col("upto"), F.lit(True))
        marked = table.join(small(plan), "pattern").withColumn("bin", bin_of)
        within = F.coalesce((entry < of_last) | (entry.eqNullSafe(of_last) & fits), F.lit(False))
        once_more = F.when(F.col("bin") == F.col("cut_bin"), within).otherwise(F.col("bin") < F.coalesce("cut_bin", F.lit(0)))
        times = F.when(F.col("size") > 0, F.col("whole") + once_more.cast("long")).otherwise(0).cast("long")
        return marked.withColumn("times", times)

    return attach


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS,
    max_repeats: int = MAX_REPEATS, seed: int = SEED
) -> DataFrame:
    """doc_id, size, source_size and target (of its first source), taken (words, repeats counted). source_col: a string, or an array of strings."""
    rows = materialize(_prepared(docs, id_col, text_col, source_col, seed).drop("row"), "sized")
    out = _decided(rows, weights, max_repeats)(rows)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def apply(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS,
    max_repeats: int = MAX_REPEATS, seed: int = SEED
) -> DataFrame:
    """The mixture: docs' columns, each row as often as it is taken."""
    prepared = _prepared(docs, id_col, text_col, source_col, seed)
    attach = _decided(materialize(prepared.drop("row"), "sized"), weights, max_repeats)
    taken = attach(prepared).filter("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
