"""Mixing of sources to target shares of a token total, with capped repetition.

A text that several sources hold is one text with a membership pattern. Token capacity of the patterns is routed to the quotas of the
sources as a min-cost flow, in which a further repetition of a pattern costs more than the one before. Texts are then laid out in a
seeded order on a line as long as their pattern's tokens, and each source takes a stretch of that line.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopyq.llm.encoding import encode
from canopyq.session import cut

#: Stretches of the seeded order whose token sums are added up before positions inside a stretch are.
BUCKETS = 16384
#: Patterns, subsets of the sources, that a mix may have: their token sums go to the driver.
MOST_PATTERNS = 100_000
#: Stretches up to which they are broadcast (6 MB).
MOST_BROADCAST = 100_000


class Flow:
    """Min-cost flow by successive shortest paths with potentials; costs are not negative and capacities whole numbers."""

    def __init__(self, n: int):
        self.arcs: list[list[int]] = []  # to, capacity left, cost
        self.at: list[list[int]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, capacity: int, cost: int) -> int:
        self.at[a].append(len(self.arcs))
        self.arcs.append([b, capacity, cost])
        self.at[b].append(len(self.arcs))
        self.arcs.append([a, 0, -cost])
        return len(self.arcs) - 2

    def run(self, s: int, t: int) -> None:
        n = len(self.at)
        high = [0] * n
        while True:
            dist: list[float] = [float("inf")] * n
            dist[s], via, heap = 0, [-1] * n, [(0, s)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for k in self.at[u]:
                    v, left, cost = self.arcs[k]
                    if left > 0 and (x := d + cost + high[u] - high[v]) < dist[v]:
                        dist[v], via[v] = x, k
                        heapq.heappush(heap, (x, v))
            if via[t] < 0:
                return
            high = [h + (int(d) if d < float("inf") else 0) for h, d in zip(high, dist, strict=True)]
            path, u = [], t
            while u != s:
                path.append(via[u])
                u = self.arcs[via[u] ^ 1][0]
            push = min(self.arcs[k][1] for k in path)
            for k in path:
                self.arcs[k][1] -= push
                self.arcs[k ^ 1][1] += push


def route(patterns: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens that each source takes of each pattern. A pattern is used at most as often as the largest cap among its sources allows."""
    names, sources = sorted(patterns), sorted(quotas)
    flow = Flow(2 + len(names) + len(sources))
    place = {s: 2 + len(names) + i for i, s in enumerate(sources)}
    arcs = {}
    for i, p in enumerate(names):
        for k in range(max(repeats[s] for s in p)):
            flow.add(0, 2 + i, patterns[p], k)
        for s in p:
            arcs[p, s] = flow.add(2 + i, place[s], patterns[p] * repeats[s], 0)
    for s in sources:
        flow.add(place[s], 1, quotas[s], 0)
    flow.run(0, 1)
    return {key: flow.arcs[k ^ 1][1] for key, k in arcs.items() if flow.arcs[k ^ 1][1]}


def units(docs: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """One row per distinct text that a target source holds: h, n_tokens, pattern (sorted sources), ids (the least doc_id in each source)."""
    d = docs.select("doc_id", "text", "source").join(targets.select("source"), "source", "left_semi").filter(F.length("text") > 0)
    d = encode(d.withColumn("h", F.sha2("text", 256)), ["doc_id", "source", "h"], path=path, ids=False)
    # hot sources shrink here on the map side; a text has at most as many sources as there are targets
    d = d.groupBy("h", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    d = d.groupBy("h").agg(F.max("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("source", "doc_id"))).alias("held"))
    return d.filter(F.col("n_tokens") > 0).withColumn("pattern", F.col("held.source"))


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 1, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(selected, report) of a mix of ``docs`` by ``targets`` (source, target_share, max_repeats).

    ``selected``: doc_id, source, n_tokens, uses (at least 1, at most the source's max_repeats). ``report``: a row per source of targets
    with its target share, quota and capacity in tokens, the tokens that it got, their share of all tokens in the mix, and whether the
    quota is reached. ``total_tokens`` is the total that the quotas are shares of, by default the tokens of all usable texts. A quota that the cap
    puts out of reach is filled as far as it goes and not made up by others. Documents with a null, empty or unlisted source, and null or empty
    texts, are never used. Copies of a text count as one text; where sources share it, its uses together stay within the largest cap among
    them. Targets whose share or cap is null or not positive get nothing. An empty table gives an empty selection.
    """
    spark = docs.sparkSession
    good = targets.filter(F.col("source").isNotNull())
    u = cut(units(docs, good, path))
    rows = good.select("source", "target_share", "max_repeats").collect()  # the flow has a node for each
    if len({r.source for r in rows}) < len(rows):
        raise ValueError("targets name a source twice")
    sums = u.groupBy("pattern").agg(F.sum("n_tokens").alias("w")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"sources overlap in more than {MOST_PATTERNS} ways")
    patterns = {tuple(r.pattern): int(r.w) for r in sums}
    total = sum(patterns.values()) if total_tokens is None else total_tokens
    share = {r.source: max(0.0, r.target_share or 0.0) for r in rows}
    quotas = {s: int(Fraction(x) * total) for s, x in share.items()}
    repeats = {r.source: max(0, r.max_repeats or 0) for r in rows}
    taken = route(patterns, quotas, repeats)
    # a stretch [low, low + tokens) of the pattern's line, end to end over its sources
    stretches, low = [], dict.fromkeys(patterns, 0)
    for (p, s), x in sorted(taken.items()):
        stretches.append((list(p), s, patterns[p], low[p], low[p] + x))
        low[p] += x
    lines = spark.createDataFrame(stretches, "pattern array<string>, source string, w long, low long, high long")
    lines = lines.select(F.xxhash64("pattern").alias("p"), "source", "w", "low", "high")
    # the flow is a forest: hardly more stretches than patterns and sources, 60 bytes each
    lines = F.broadcast(lines) if len(stretches) <= MOST_BROADCAST else lines
    order = F.xxhash64(F.col("h"), F.lit(seed))
    u = u.withColumn("o", order).withColumn("bucket", F.pmod(F.shiftrightunsigned("o", 20), F.lit(BUCKETS)))
    by = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = u.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(by), F.lit(0)))
    inside = Window.partitionBy("pattern", "bucket").orderBy("o", "h").rowsBetween(Window.unboundedPreceding, -1)
    at = u.withColumn("c", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(before.drop("t"), ["pattern", "bucket"])
    # a text goes with the stretch that holds its middle, so a stretch misses its tokens by half a text at either end at most
    at = at.select(F.xxhash64("pattern").alias("p"), "held", "n_tokens", (F.col("c") + F.col("before") + F.expr("n_tokens div 2")).alias("c"))
    # places c, c + w, c + 2 w ... inside the stretch: ceil((high - c) / w) - ceil((low - c) / w)
    ceil = lambda x: F.expr(f"-((c - {x}) div w) + if((c - {x}) % w < 0, 1, 0)")
    picked = at.join(lines, "p").withColumn("uses", F.greatest(ceil("high"), F.lit(0)) - F.greatest(ceil("low"), F.lit(0)))
    picked = picked.filter(F.col("uses") > 0).select(F.expr("filter(held, x -> x.source = source)[0].doc_id").alias("doc_id"), "source", "n_tokens", F.col("uses").cast("int").alias("uses"))
    capacity = u.select(F.explode("pattern").alias("source"), "n_tokens").groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    got = picked.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("actual_tokens"), F.max("uses").alias("most_uses"), F.count(F.lit(1)).alias("documents"))
    routed = dict.fromkeys(quotas, 0)
    for (_, s), x in taken.items():
        routed[s] += x
    quota = spark.createDataFrame([(s, q, routed[s] >= q) for s, q in quotas.items()] or [("", 0, True)], "source string, quota_tokens long, reached boolean")
    out = good.select("source", "target_share", "max_repeats").join(F.broadcast(quota), "source", "left").join(capacity, "source", "left").join(got, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = out.select("source", "target_share", "max_repeats", zero("available_tokens"), zero("quota_tokens"), zero("actual_tokens"), zero("documents"), zero("most_uses"), "reached")
    all_tokens = F.sum("actual_tokens").over(Window.partitionBy(F.lit(1)))  # a row per target
    share_column = F.when(all_tokens > 0, F.col("actual_tokens") / all_tokens).otherwise(F.lit(0.0))
    return picked, out.withColumn("actual_share", share_column)
