"""Filling containers of fixed capacity with items of varying length, never splitting one that fits.

Items are sized in parallel, spread over groups of a bounded number of items by their row numbers (so
that neither nulls nor repeated ids meet in one), and every group is packed by bin completion; so no
task ever holds more than one group, however large the input or however often one source occurs in it.

Bin completion: containers are closed one after another around the largest item left. The undominated
fillings of the room beside it are tried in the order of their waste, the least first; a branch ends as
soon as its waste shows that it cannot need fewer containers than the best packing known. That incumbent
starts as best-fit decreasing, and a search ends when it meets the lower bound (sum of sizes over
capacity).

A search may be long, so two parameters bound it: ``nodes``, the fillings it looks at in all, and
``fillings``, those it tries of one container. Without them (None) the search is exact. They bound time,
never rows: every item is in the packing returned, which is the best one found.

Defined cases: null and empty texts need no room and get no row; an item above the capacity fills
containers of its own and only its remainder is packed; repeated rows are items of their own.
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.encoding import TOKENIZER, token_count
from sparkloom.session import cut

CAPACITY = 2048
#: Items of a group, about.
GROUP_ITEMS = 4096
#: Fillings that a search looks at in all, and tries of one container; None for an exact search.
NODES = 20_000
FILLINGS = 32

PACKED = "doc_id bigint, piece int, first_token bigint, n_tokens bigint, container string"


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of the items of each container: every item, largest first, into the fullest that takes it."""
    free: list[tuple[int, int]] = []
    containers: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(free, (sizes[i], -1))
        if at == len(free):
            containers.append([i])
            bisect.insort(free, (capacity - sizes[i], len(containers) - 1))
        else:
            room, k = free.pop(at)
            containers[k].append(i)
            bisect.insort(free, (room - sizes[i], k))
    return containers


def reachable_sums(room: int, sizes: list[int], counts: dict[int, int]) -> list[int]:
    """Sums up to ``room`` that items of ``sizes`` from each place on can make, as bits."""
    mask = (1 << (room + 1)) - 1
    sums = [1] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        reach, size, left, step = sums[i + 1], sizes[i], min(counts[sizes[i]], room // sizes[i]), 1
        while left > 0:
            take = min(step, left)
            reach |= (reach << (size * take)) & mask
            left -= take
            step *= 2
        sums[i] = reach
    return sums


def fillings(room: int, sizes: list[int], counts: dict[int, int], waste: int) -> Iterator[tuple[int, ...] | None]:
    """All undominated fillings of ``room`` from distinct ``sizes`` (descending) that leave at most ``waste``, those
    of least waste first; None for each one looked at that is dominated.

    A filling is dominated if an item left over could take the place of a smaller one of it, or be
    added to it; the other filling then leaves no more to pack.
    """
    usable = sizes[bisect.bisect_left(sizes, -room, key=lambda s: -s) :]
    usable = [s for s in usable if counts[s]]
    sums = reachable_sums(room, usable, counts)

    def undominated(chosen: Counter[int], waste: int) -> bool:
        free = [s for s in usable if counts[s] > chosen[s]]
        if free and free[-1] <= waste:
            return False
        # the smallest left over that is larger than a chosen one must not fit in its place
        for small in chosen:
            at = bisect.bisect_left(free, -small, key=lambda s: -s) - 1
            if at >= 0 and free[at] <= small + waste:
                return False
        return True

    for total in range(room, max(room - waste, 0) - 1, -1):
        if not sums[0] >> total & 1:
            continue
        # each entry: place, sum left to make, items chosen so far; larger numbers of larger items first
        stack: list[tuple[int, int, tuple[int, ...]]] = [(0, total, ())]
        while stack:
            i, left, chosen = stack.pop()
            if not left:
                yield chosen if undominated(Counter(chosen), room - total) else None
                continue
            while i < len(usable) and usable[i] > left:
                i += 1
            if i == len(usable) or not sums[i] >> left & 1:
                continue
            size = usable[i]
            for k in range(min(counts[size], left // size) + 1):
                if sums[i + 1] >> (left - k * size) & 1:
                    stack.append((i + 1, left - k * size, chosen + (size,) * k))


def bin_completion(sizes: list[int], capacity: int = CAPACITY, nodes: int | None = NODES, most: int | None = FILLINGS) -> list[list[int]]:
    """Positions of the items (each 1 to ``capacity``) of each container."""
    best = best_fit_decreasing(sizes, capacity)
    total = sum(sizes)
    bound = -(-total // capacity)
    counts: dict[int, int] = defaultdict(int, Counter(sizes))
    order = sorted(counts, reverse=True)
    tried, spare, packing = 0, 0, []
    solution: list[tuple[int, ...]] | None = None
    stack: list[Iterator[tuple[int, ...]]] = []

    def allowed() -> int:
        """Waste that a packing with one container less than the best may still have."""
        return ((len(solution) if solution else len(best)) - 1) * capacity - total - spare

    def branches() -> Iterator[tuple[int, ...] | None]:
        largest = next(s for s in order if counts[s])
        counts[largest] -= 1
        left = dict(counts)
        counts[largest] += 1
        taken = 0
        for f in fillings(capacity - largest, order, left, allowed()):
            yield None if f is None else (largest, *f)
            taken += f is not None
            if taken == most:
                return

    def undo() -> None:
        nonlocal spare
        undone = packing.pop()
        spare -= capacity - sum(undone)
        for s in undone:
            counts[s] += 1

    if len(best) > bound:
        stack.append(branches())
    while stack and (nodes is None or tried < nodes):
        filling = next(stack[-1], ())
        if filling is None:
            tried += 1
            continue
        # fillings come by waste, so no later one of this container is better
        if not filling or capacity - sum(filling) > allowed():
            stack.pop()
            if packing:
                undo()
            continue
        tried += 1
        for s in filling:
            counts[s] -= 1
        packing.append(filling)
        spare += capacity - sum(filling)
        if not any(counts.values()):
            solution = list(packing)
            if len(solution) == bound:
                break
            undo()
        else:
            stack.append(branches())
    if solution is None:
        return best
    places: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(sizes):
        places[s].append(i)
    return [[places[s].pop() for s in filling] for filling in solution]


def pack_items(items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, nodes: int | None = NODES, fillings: int | None = FILLINGS) -> DataFrame:
    """Containers for ``items`` (``doc_id`` bigint, ``n_tokens`` bigint), with columns ``PACKED``.

    ``container`` is unique over the result; an item that fits has the single piece 0. The items are
    checkpointed with a number each: it names their containers and spreads them over groups, and what
    sized them shall run once.
    """
    n = F.col("n_tokens")
    numbered = cut(items.select("doc_id", n.cast("bigint").alias("n_tokens")).filter(n > 0).withColumn("item", F.monotonically_increasing_id()))
    pieces = numbered.select("doc_id", "item", n, F.explode(F.sequence(F.lit(0), F.ceil(n / capacity).cast("int") - 1)).alias("piece")).select(
        "doc_id", "item", "piece",
        (F.col("piece").cast("bigint") * capacity).alias("first_token"),
        F.least(F.lit(capacity).cast("bigint"), n - F.col("piece").cast("bigint") * capacity).alias("n_tokens"),
    )
    packed_columns = ["doc_id", "piece", "first_token", "n_tokens"]
    full = pieces.filter(n == capacity).select(*packed_columns, F.concat_ws(".", F.lit("d"), "item", "piece").alias("container"))
    rest = pieces.filter(n < capacity)
    groups = max(1, -(-rest.count() // group_items))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "item", "piece"], ascending=[False, True, True], ignore_index=True)
        names = [""] * len(group)
        for k, positions in enumerate(bin_completion(group["n_tokens"].tolist(), capacity, nodes, fillings)):
            for i in positions:
                names[i] = f"g{group['group'].iloc[0]}.{k}"
        return group[packed_columns].assign(container=names)

    packed = rest.withColumn("group", F.pmod(F.xxhash64("item"), F.lit(groups))).groupBy("group").applyInPandas(pack, PACKED)
    return packed.unionByName(full)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER) -> DataFrame:
    """Containers of ``capacity`` tokens for the texts of ``documents``."""
    return pack_items(documents.select("doc_id", token_count(F.col("text"), name).alias("n_tokens")), capacity)
