"""Mixing sources to target weights.

The same text may come from several sources. Texts are aggregated by membership pattern, the set of
target sources they came from; only the patterns and their tokens reach the driver, as numbers.
A min-cost flow routes tokens from patterns to source quotas; each further lap over a pattern costs
more than the one before, so repetition is spread and used only where a quota needs it. The flow is
turned back into documents without collecting any: the texts of a pattern lie on a line in seeded
order, and each source takes a stretch of it, in laps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelake.llm.tokens import DEFAULT_DIR, encoded
from hirelake.session import cut
from hirelake.sources.tables import broadcast_small, table

SEED = "mix-1"
#: Patterns of which the flow holds a matrix at once. It bounds memory only: every pattern takes part, and the result is the same with any number.
MAX_PATTERNS = 4096
#: Texts of a pattern that one task puts in order.
PER_BUCKET = 5000
#: A price that no path has.
FAR = 1 << 40


def _arcs(flow: np.ndarray, row: np.ndarray, col: np.ndarray, supply: np.ndarray, laps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Price and room of tokens given up by the pattern itself (column 0) or by a source, and of tokens taken by a source.

    All at the lap where the flow stands: the lap numbered r costs r - 1 to take, and gives that back when given up.
    """
    n, whole = supply[row], np.zeros(len(supply), np.int64)
    np.add.at(whole, row, flow)
    lap, rest = np.divmod(flow, n)
    take, take_room = np.full((len(supply), len(laps)), FAR), np.zeros((len(supply), len(laps)), np.int64)
    give, give_room = np.full((len(supply), len(laps) + 1), FAR), np.zeros((len(supply), len(laps) + 1), np.int64)
    take[row, col], take_room[row, col] = np.where(lap < laps[col], lap, FAR), n - rest
    give[row, col + 1], give_room[row, col + 1] = np.where(flow > 0, (rest == 0) - lap, FAR), np.where(rest == 0, n, rest)
    give[:, 0], give_room[:, 0] = whole // supply, supply - whole % supply
    return give, give_room, take, take_room


def least_cost(row: np.ndarray, col: np.ndarray, supply: np.ndarray, quota: np.ndarray, laps: np.ndarray) -> np.ndarray:
    """Tokens of each pair of a pattern (``row``, in order) and a source (``col``): as much of the quotas as possible, then at least cost.

    A source takes at most ``laps`` times the tokens of a pattern; the lap numbered r of a source over a
    pattern costs r - 1, and so does the lap numbered r of all sources together, which makes both costs
    convex. Successive shortest paths in a graph of the sources alone: tokens pass from one source to
    another by the patterns they share, and one step moves them in all patterns where this costs least.
    """
    size, n = len(quota), len(supply)
    flow, left = np.zeros(len(row), np.int64), quota.copy()
    starts = range(0, n, MAX_PATTERNS)
    ends = np.searchsorted(row, [*starts, n])
    # least price of an arc within each block, and the room at that price
    price, room = np.full((len(starts), size + 1, size), FAR), np.zeros((len(starts), size + 1, size), np.int64)
    own = np.eye(size + 1, size, -1, dtype=bool)

    def block(b: int) -> tuple:
        at = slice(ends[b], ends[b + 1])
        within = row[at] - starts[b], col[at]
        return flow[at], *within, *_arcs(flow[at], *within, supply[starts[b] : starts[b] + MAX_PATTERNS], laps)

    def survey(b: int, changed: list[int]) -> None:
        *_, give, give_room, take, take_room = block(b)

        def least(cost: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            low = cost.min(0)
            return low, np.where(cost == low, most, 0).sum(0)

        for s in changed:
            price[b, :, s], room[b, :, s] = least(give + take[:, s : s + 1], np.minimum(give_room, take_room[:, s : s + 1]))
            price[b, s + 1], room[b, s + 1] = least(give[:, s + 1 : s + 2] + take, np.minimum(give_room[:, s + 1 : s + 2], take_room))
        price[b, 0], room[b, 0] = least(give[:, :1] + take, np.minimum(give_room[:, :1], take_room))
        price[b][own] = FAR

    for b in range(len(starts)):
        survey(b, list(range(size)))
    steps = size + 2  # of equal prices the path of fewest steps
    while n and size:
        arc = price.min(0)
        far, by = arc[0] * steps + 1, np.zeros(size, np.int64)
        while True:
            over = far[:, None] + arc[1:] * steps + 1
            near, least = over.argmin(0), over.min(0)
            if not (better := least < far).any():
                break
            far, by = np.where(better, least, far), np.where(better, near + 1, by)
        open_far = np.where(left > 0, far, FAR * steps)
        s = int(open_far.argmin())
        if open_far[s] >= FAR // 2 * steps:
            return flow
        path, v = [], s + 1
        while v:
            path.append((int(by[v - 1]), v - 1))
            v = path[-1][0]
        amount = min(int(left[s]), *(int(room[price[:, u, c] == arc[u, c], u, c].sum()) for u, c in path))
        left[s] -= amount
        touched = set()
        for u, c in path:
            need = amount
            for b in np.flatnonzero(price[:, u, c] == arc[u, c]).tolist():
                if not need:
                    break
                part, i, s_of, give, give_room, take, take_room = block(b)
                most = np.where(give[:, u] + take[:, c] == arc[u, c], np.minimum(give_room[:, u], take_room[:, c]), 0)
                moved = np.clip(need - (most.cumsum() - most), 0, most)
                part += np.where(s_of == c, moved[i], 0) - np.where(s_of == u - 1, moved[i], 0)  # a view of flow
                need -= int(moved.sum())
                touched.add(b)
        for b in touched:
            survey(b, sorted({v for u, c in path for v in (u - 1, c) if v >= 0}))
    return flow


def min_cost_flow(supply: dict[tuple[str, ...], int], quota: dict[str, int], laps: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """``least_cost`` for patterns and sources by name: tokens from each pattern to each of its sources that has a quota."""
    number = {s: i for i, s in enumerate(quota)}
    patterns = [p for p in supply if supply[p] > 0]
    pairs = [(i, p, s) for i, p in enumerate(patterns) for s in p if s in number]
    flow = least_cost(
        np.array([i for i, _, _ in pairs], np.int64),
        np.array([number[s] for _, _, s in pairs], np.int64),
        np.array([supply[p] for p in patterns], np.int64),
        np.array(list(quota.values()), np.int64),
        np.array([laps[s] for s in quota], np.int64),
    )
    return {(p, s): 0 for p in supply for s in p if s in number} | {(p, s): int(n) for (_, p, s), n in zip(pairs, flow)}


def reachable_total(supply: dict[tuple[str, ...], int], share: dict[str, float], laps: dict[str, int]) -> int:
    """The largest total at which every source with any text can reach its share of it exactly.

    Sources without texts keep their share of the total as a shortfall.
    """
    have: dict[str, int] = {}
    for p, n in supply.items():
        for s in p:
            have[s] = have.get(s, 0) + n
    return _largest_total(have, share, laps)


def _largest_total(have: dict[str, int], share: dict[str, float], laps: dict[str, int]) -> int:
    """``reachable_total`` from the tokens that each source has. All sources can take all their laps at once, so that each one
    alone bounds the total. Found by bisection."""
    live = {s: w for s, w in share.items() if s in have and w > 0}
    if not live:
        return 0
    low, high = 0, int(min(have[s] * laps[s] / w for s, w in live.items())) + 1
    while high - low > max(1, high // 100_000):
        mid = (low + high) // 2
        low, high = (mid, high) if all(int(mid * w) <= have[s] * laps[s] for s, w in live.items()) else (low, mid)
    return low


def _units(docs: DataFrame, targets: DataFrame, path: str) -> DataFrame:
    """(u, doc_id, n_tokens, pattern): one row for each different non-empty text with a target source.

    ``doc_id`` is the least of its documents; ``pattern`` the sorted list of its target sources. Tokens
    are counted for every different text once.
    """
    rows = docs.where(F.col("text").isNotNull() & (F.btrim("text") != "")).select("doc_id", F.lower(F.btrim("source")).alias("source"), "text")
    rows = rows.join(broadcast_small(targets.select("source")), "source")
    # two hashes of different kinds and the length together stand for a text
    keyed = rows.select("doc_id", "source", F.xxhash64("text").alias("u"), F.hash("text").alias("v"), F.length("text").alias("w"), "text")
    units = keyed.groupBy("u", "v", "w").agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_set("source")).alias("pattern")).drop("v", "w")
    sized = encoded(keyed.join(units.select("doc_id"), "doc_id", "left_semi"), "doc_id", "text", path, counts_only=True)
    return units.join(sized, "doc_id").where(F.col("n_tokens") > 0)


def _numbers(found: pa.Table, name: str) -> pa.ListArray:
    """A column of lists in one piece that begins at 0."""
    chunks = found[name].chunks
    return chunks[0] if chunks else pa.array([], pa.list_(pa.int32()))


def mixed(docs: DataFrame, targets: DataFrame, path: str, total: int | None = None, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents, shares). Documents: (doc_id, source, n_tokens, repeats), each chosen text for each source
    that uses it. Shares: (source, target_share, max_repeat, available_tokens, tokens, share, shortfall_tokens).

    ``docs`` has doc_id, text, source; ``targets`` has source, target_share, max_repeat. Sources are
    compared without letter case and outer spaces; documents whose source is NULL or no target take no
    part, nor do NULL and blank texts. Without ``total`` the largest total is taken at which all sources
    that have texts reach their shares. A source without texts gets none, and its quota is its
    shortfall. No text is given to one source more than max_repeat times. The choice depends on the
    seed and the texts only. Empty tables give no documents and shares of 0.
    """
    targets = targets.groupBy(F.lower(F.btrim("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeat").alias("max_repeat"))
    units = cut(_units(docs, targets, path))
    listed = cut(units.groupBy("pattern").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")))
    goals = {r.source: r for r in targets.orderBy("source").collect()}
    share = {s: float(r.target_share or 0) for s, r in goals.items()}
    laps = {s: max(1, int(r.max_repeat or 1)) for s, r in goals.items()}
    names = [s for s in goals if s is not None]
    numbered = F.array(*map(F.lit, names)).cast("array<string>")
    found = listed.orderBy("pattern").select(F.transform("pattern", lambda s: (F.array_position(numbered, s) - 1).cast("int")).alias("pattern"), "tokens").toArrow().combine_chunks()  # every pattern, as numbers
    members, supply = _numbers(found, "pattern"), found["tokens"].to_numpy()
    row, col = np.repeat(np.arange(len(supply)), np.diff(members.offsets.to_numpy())), members.values.to_numpy()
    have = np.zeros(len(names), np.int64)
    np.add.at(have, col, supply[row])
    if total is None:
        total = _largest_total({s: int(n) for s, n in zip(names, have) if n}, share, laps)
    quota = {s: int(total * w) for s, w in share.items()}
    flow = least_cost(row, col, supply, np.array([quota[s] for s in names], np.int64), np.array([laps[s] for s in names], np.int64))
    # each source takes the next stretch of a pattern's line, so that laps are not begun before needed
    until = flow.cumsum()
    base = np.concatenate([[0], until])[members.offsets.to_numpy()[row]]
    stretches = {"members": members, "lo": pa.ListArray.from_arrays(members.offsets, pa.array(until - flow - base)), "hi": pa.ListArray.from_arrays(members.offsets, pa.array(until - base)), "line": pa.array(supply)}
    spark = docs.sparkSession
    plan = spark.createDataFrame(pa.table(stretches)).withColumn("pattern", F.transform("members", lambda i: F.element_at(numbered, i + 1)))
    plan = plan.select("pattern", "line", F.inline(F.arrays_zip(F.col("pattern").alias("source"), "lo", "hi"))).where(F.col("hi") > F.col("lo"))
    # place of each text on its pattern's line: tokens of the buckets before, then within its bucket
    buckets = listed.select("pattern", (F.floor(F.col("n") / PER_BUCKET) + 1).alias("n_buckets"))
    order = F.xxhash64(F.lit(seed), "u")
    rows = units.join(broadcast_small(buckets), "pattern").withColumn("__o", order).withColumn("bucket", F.pmod(F.shiftright("__o", 20), F.col("n_buckets")))
    before = rows.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = before.withColumn("before", F.sum("t").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("t")).drop("t")
    within = Window.partitionBy("pattern", "bucket").orderBy("__o", "doc_id")
    rows = rows.withColumn("within", F.sum("n_tokens").over(within) - F.col("n_tokens")).join(before, ["pattern", "bucket"])
    rows = rows.withColumn("place", F.col("before") + F.col("within"))
    # laps k with lo <= place + k * line < hi
    chosen = rows.join(broadcast_small(plan), "pattern").withColumn("repeats", F.ceil((F.col("hi") - F.col("place")) / F.col("line")) - F.ceil((F.col("lo") - F.col("place")) / F.col("line")))
    documents = chosen.where(F.col("repeats") > 0).select("doc_id", "source", "n_tokens", F.col("repeats").cast("bigint").alias("repeats"))
    documents = cut(documents)
    used = documents.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    have = units.select("n_tokens", F.explode("pattern").alias("source")).groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    quotas = spark.createDataFrame([(s, q) for s, q in quota.items()], "source string, quota bigint")
    shares = targets.join(quotas, "source", "left").join(used, "source", "left").join(have, "source", "left").fillna(0, ["quota", "tokens", "available_tokens"])
    whole = shares.agg(F.sum("tokens").alias("__all"))
    shares = shares.crossJoin(F.broadcast(whole))  # one row
    reached = F.when(F.col("__all") > 0, F.round(F.col("tokens") / F.col("__all"), 5)).otherwise(F.lit(0.0))
    return documents, shares.select("source", "target_share", "max_repeat", "available_tokens", "tokens", reached.alias("share"), F.greatest(F.col("quota") - F.col("tokens"), F.lit(0)).alias("shortfall_tokens"))


def _mix(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"), f"{DEFAULT_DIR}/byte_bpe_50k.json")


def p8_documents(spark, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, repeats): the chosen documents, and how often each is used for a source."""
    return _mix(spark, sf_dir)[0]


def p8_shares(spark, sf_dir: str) -> DataFrame:
    """(source, target_share, max_repeat, available_tokens, tokens, share, shortfall_tokens)."""
    return _mix(spark, sf_dir)[1]
