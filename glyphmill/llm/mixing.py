"""Mix overlapping sources to target weights: a min-cost flow from membership patterns to source quotas, with convex
costs for repetition, then a seeded choice of documents that takes each pattern's share."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import BLANKS, arrow_schema, batch_of, rows_of, written

#: The flow is solved on the driver over one row for each pattern of memberships; more are an error, never a cut.
MAX_PATTERNS = 20_000
#: A share of each pattern is cut at two levels of this many hash buckets, then row by row in one bucket.
BUCKETS = 1024
#: Units of each size class (a power of two) that may fill what a cut leaves open.
FITS = 8


def repeat_costs(most: int) -> list[int]:
    """Cost of each time that a token is taken: convex, so that repeats are spread."""
    return [i * (i + 1) for i in range(most)]


def n_words(text: Column) -> Column:
    """Number of runs of other than ASCII white space; 0 for null."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, "[ \\t-\\r]+", -1))).cast("long")


def capped_targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[int] = (5, 2, 1), most: int = 3) -> dict[str | None, float]:
    """Targets that share the sum of sizes by weights, repeating over sources by code point with null last; none is above most
    times its source's size, and what is cut there is shared by weight among the others until none is above."""
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode("utf-8", "surrogatepass")))
    total, open_ = sum(n for _, n in order), {i: weights[i % len(weights)] for i in range(len(order))}
    out: dict[int, float] = {}
    left = float(total)
    while open_:
        unit = left / sum(open_.values())
        full = [i for i, w in open_.items() if w * unit > most * order[i][1]]
        if not full:
            out |= {i: w * unit for i, w in open_.items()}
            break
        for i in full:
            out[i] = float(most * order[i][1])
            left -= out[i]
            del open_[i]
    return {order[i][0]: t for i, t in out.items()}


def route(patterns: dict[tuple, int], targets: dict, costs: Sequence[int] = (0, 2, 6)) -> dict[tuple, float]:
    """Min-cost flow. patterns: tokens by the tuple of sources that their documents belong to; targets: tokens by source.

    Each pattern can send its tokens len(costs) times, each time at a higher cost, to any of its sources. Successive
    shortest paths over pattern and source nodes: an augmenting path moves flow from a pattern through sources that
    can hand some of theirs over to other patterns, and ends at a source below its target. Returns tokens by (pattern, source).
    """
    flow: dict[tuple, float] = {}
    sent = dict.fromkeys(patterns, 0.0)
    into = dict.fromkeys(targets, 0.0)
    members: dict = {s: [] for s in targets}
    for p in patterns:
        for s in p:
            if s in members:
                members[s].append(p)
    eps = 1e-6

    def step(p: tuple) -> tuple[float, float]:
        """(cost, room) of the pattern's next token."""
        k = int((sent[p] + eps) // patterns[p]) if patterns[p] else len(costs)
        return (costs[k], (k + 1) * patterns[p] - sent[p]) if k < len(costs) else (float("inf"), 0.0)

    # all paths cost what their first pattern's next token costs, so that a search by rising cost finds the shortest
    queue = [(step(p)[0], i, p) for i, p in enumerate(patterns) if step(p)[1] > eps]
    heapq.heapify(queue)
    while queue:
        cost, i, start = heapq.heappop(queue)
        if step(start)[0] != cost:
            if step(start)[1] > eps:
                heapq.heappush(queue, (step(start)[0], i, start))
            continue
        came, todo, end = {start: None}, [start], None
        while todo and end is None:
            p = todo.pop(0)
            for s in p:
                if s in into and ("source", s) not in came:
                    came[("source", s)] = p
                    if targets[s] - into[s] > eps:
                        end = s
                        break
                    for q in members[s]:
                        if q not in came and flow.get((q, s), 0.0) > eps:
                            came[q] = ("source", s)
                            todo.append(q)
        if end is None:
            continue  # no source that it can reach has room, nor will one have later
        path, node = [], ("source", end)
        while node is not None:
            path.append(node)
            node = came[node]
        path.reverse()  # pattern, source, pattern, source, ...
        room = min(step(start)[1], targets[end] - into[end], *(flow[(path[j + 1], path[j][1])] for j in range(1, len(path) - 1, 2)))
        for j in range(0, len(path) - 1, 2):
            flow[(path[j], path[j + 1][1])] = flow.get((path[j], path[j + 1][1]), 0.0) + room
            if j:
                flow[(path[j], path[j - 1][1])] -= room
        sent[start] += room
        into[end] += room
        if step(start)[1] > eps:
            heapq.heappush(queue, (step(start)[0], i, start))
    return {k: v for k, v in flow.items() if v > eps}


def _hashed(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "id", "hash")


def _buckets(u: Column) -> tuple[Column, Column]:
    return F.pmod(u, F.lit(BUCKETS)), F.pmod(F.shiftright(u, 20), F.lit(BUCKETS))


def cuts(units: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """Which units (key, id, hash, u, size) to take so that the sizes taken of each key come near its `want`.

    Units come in the order of u, a seeded hash. Bucket sums find where the running size passes `want`, and only the rows of one
    bucket of a bucket are summed one by one, so that a key with most of the rows is spread over all tasks. What is then
    still missing, less than the next unit, is filled from the FITS largest units of each size class that fit: the largest first, among
    those not in the cut, then among those in it that are below `most` times (the one place where a few words are repeated without need
    of the flow), and at last by the smallest that overshoots by less. Returns one row for each key: bounds c1, c2 and
    last, and the units `fits` beyond them. Nothing here is larger than a few hundred rows for each key.
    """
    b1, b2 = _buckets(F.col("u"))
    rows = units.join(F.broadcast(wanted.where("want > 0").select("key", "want")), "key").withColumns({"b1": b1, "b2": b2})
    order = Window.partitionBy("key")

    def passed(sums: DataFrame, by: str, base: Column) -> DataFrame:
        """The bucket in which the running size passes what is wanted, and the size before it."""
        run = sums.withColumn("upto", base + F.sum("s").over(order.orderBy(by))).where(F.col("upto") > F.col("want"))
        return run.groupBy("key").agg(F.min(F.struct(F.col(by).alias("at"), (F.col("upto") - F.col("s")).alias("before"))).alias("m"))

    s1 = rows.groupBy("key", "want", "b1").agg(F.sum("size").alias("s"))
    c1 = written(passed(s1, "b1", F.lit(0)).select("key", F.col("m.at").alias("c1"), F.col("m.before").alias("w1")), "mix-cut1")
    near = rows.join(F.broadcast(c1), "key").where(F.col("b1") == F.col("c1"))
    s2 = near.groupBy("key", "want", "w1", "b2").agg(F.sum("size").alias("s"))
    c2 = written(passed(s2, "b2", F.col("w1")).select("key", F.col("m.at").alias("c2"), F.col("m.before").alias("w2")), "mix-cut2")
    inner = near.join(F.broadcast(c2), "key").where(F.col("b2") == F.col("c2"))
    run = inner.withColumn("upto", F.col("w2") + F.sum("size").over(order.orderBy("u", "id", "hash"))).where(F.col("upto") <= F.col("want"))
    last = run.groupBy("key").agg(F.max(F.struct("u", "id", "hash")).alias("last"), F.max("upto").alias("upto"))
    found = c1.join(c2, "key").join(last, "key", "left")
    found = found.join(wanted.select("key", "want"), "key").withColumn("gap", F.col("want") - F.coalesce("upto", "w2")).select("key", "c1", "c2", "last", "gap")
    room = written(found.join(wanted.select("key", "whole"), "key"), "mix-room")
    again = within(F.col("u"), F.struct("id", "hash")).cast("int")
    open_ = units.join(F.broadcast(room), "key").withColumn("again", again).where((F.col("size") > 0) & (F.col("size") < 2 * F.col("gap")) & (F.col("whole") + F.col("again") < most))
    # of units that overshoot, the smallest; of those that fit, the largest of each class
    over = F.col("size") > F.col("gap")
    classed = open_.withColumn("class", F.when(over, -1).otherwise(F.floor(F.log2("size")).cast("int"))).withColumn("rank_by", F.when(over, -F.col("size")).otherwise(F.col("size")))
    nth = F.row_number().over(Window.partitionBy("key", "again", "class").orderBy(F.desc("rank_by"), "u", "id", "hash"))
    few = classed.withColumn("nth", nth).where(F.col("nth") <= FITS).select("key", "gap", "again", "size", "u", "id", "hash")

    def fill(rows: pa.Table) -> pa.Table:
        found, key, gap = sorted(rows_of(rows), key=lambda r: (r[2], -r[3], r[4], r[5] is None, r[5] or 0, r[6])), None, None
        fits, left = [], []
        for key, own_gap, _, size, _, id_, hash_ in found:
            gap = own_gap if gap is None else gap
            if size <= gap:
                fits.append((id_, hash_))
                gap -= size
            else:
                left.append((size, id_, hash_))
        nearest = min((x for x in left if gap < x[0] < 2 * gap), key=lambda x: x[0], default=None)
        fits += [nearest[1:]] if nearest else []
        return pa.Table.from_batches([batch_of([(key, *f) for f in fits], arrow_schema(_FITS))])

    filled = few.groupBy("key").applyInArrow(fill, _FITS).groupBy("key").agg(F.collect_list(F.struct("id", "hash")).alias("fits"))
    out = room.select("key", "c1", "c2", "last").join(filled, "key", "left")
    return written(out.withColumn("fits", F.coalesce("fits", F.array().cast(_UNITS))), "mix-found")


_FITS, _UNITS = "key long, id long, hash long", "array<struct<id:bigint,hash:bigint>>"


def fitted(unit: Column) -> Column:
    return F.exists("fits", lambda f: f.eqNullSafe(unit))


def within(u: Column, unit: Column) -> Column:
    """Whether a unit is within the cuts of its key."""
    b1, b2 = _buckets(u)
    upto = F.coalesce(F.struct(u.alias("u"), unit["id"].alias("id"), unit["hash"].alias("hash")) <= F.col("last"), F.lit(False))
    return (b1 < F.col("c1")) | ((b1 == F.col("c1")) & ((b2 < F.col("c2")) | ((b2 == F.col("c2")) & upto)))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_cols: Sequence[str] = ("source",),
    weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 17,
) -> DataFrame:
    """docs with size long (words), source_size long, target double and taken long (words, repeats counted).

    source_cols: columns whose values are a document's sources; a document belongs to each. Sources are ordered by code point with
    null last and take weights in turn; targets share the sum of all sizes and stop at `most` times their source's size.
    source_size and target are those of the document's first source. A document is taken whole, 0 to `most` times;
    a null or empty text has size 0 and isn't taken. Rows with a null id take part each by its text, and exact repeats of a row are
    taken alike. Very long texts are taken whole or not at all. Columns of docs with the four names are replaced, others stay as they are,
    whatever their names. An empty table gives no rows. The same rows give the same mix.
    """
    base = docs.drop("size", "source_size", "target", "taken")
    srcs = F.array_distinct(F.array(*[F.col(c).cast("string") for c in source_cols]))
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    sized = written(base.select(F.col(id_col).cast("long").alias("id"), srcs.alias("srcs"), n_words(F.col(text_col)).alias("size"), text_hash.alias("hash")), "mix-sizes")
    by_pattern = sized.groupBy("srcs").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(by_pattern) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} patterns of memberships")
    patterns = {tuple(r["srcs"]): int(r["size"]) for r in sorted(by_pattern, key=lambda r: [(s is None, s or "") for s in r["srcs"]])}
    totals: dict = {}
    for p, n in patterns.items():
        for s in p:
            totals[s] = totals.get(s, 0) + n
    targets = capped_targets([*totals.items()], weights, most)
    over = sum(totals.values()) / sum(patterns.values()) if sum(patterns.values()) else 1.0
    targets = {s: t / over for s, t in targets.items()}  # where memberships overlap, quotas still share the sum of sizes once
    flow: dict[tuple, float] = {}
    for (p, _), n in route(patterns, targets, repeat_costs(most)).items():
        flow[p] = flow.get(p, 0.0) + n
    told = [(i, [*p], totals[p[0]], float(targets[p[0]]), *(divmod(round(flow.get(p, 0.0)), n) if n else (0, 0))) for i, (p, n) in enumerate(patterns.items())]
    share = docs.sparkSession.createDataFrame(told, "key long, srcs array<string>, source_size long, target double, whole long, want long")
    keyed = sized.join(F.broadcast(share), sized["srcs"].eqNullSafe(share["srcs"])).select("key", "id", "hash", "size")
    units = written(keyed.groupBy("key", "id", "hash").agg(F.sum("size").alias("size")).withColumn("u", _hashed(seed)), "mix-units")
    marks = share.join(cuts(units, share.select("key", "want", "whole"), most), "key", "left")
    told = ("srcs", "source_size", "target", "whole")
    marks = marks.withColumnsRenamed(dict(zip(told, (f"of_{c}" for c in told), strict=True)))
    names = {"id": F.col(id_col).cast("long"), "hash": text_hash, "srcs": srcs, "size": n_words(F.col(text_col))}
    own = base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("doc"), *[c.alias(k) for k, c in names.items()])
    marked = own.join(F.broadcast(marks), F.col("srcs").eqNullSafe(F.col("of_srcs")))
    unit = F.struct("id", "hash")
    extra = F.coalesce(within(_hashed(seed), unit).cast("long"), F.lit(0)) + F.coalesce(fitted(unit).cast("long"), F.lit(0))
    out = marked.withColumn("taken", F.col("size") * (F.col("of_whole") + extra))
    return out.select("doc.*", "size", F.col("of_source_size").alias("source_size"), F.col("of_target").alias("target"), "taken")
