"""Texts packed into containers of fixed capacity by bin completion.

Sizes are tokens of a public tokenizer, counted in Arrow batches. The items, a few dozen bytes
each, are then spread by a hash of their row over buckets of a bounded number of items, whatever
their source, and each bucket is packed on its own: bin completion takes the largest item, lists
the undominated fillings around it, and branches, bounded by the waste that still allows fewer
containers than the best-fit-decreasing incumbent. Containers that stay less than `full` are
dissolved and their items packed again, across buckets, so the space left open does not grow with
the number of buckets.

A text is split only if it alone exceeds the capacity: into pieces that fill a container each,
cut before a word, and a rest.

Defined results: NULL texts are no items; empty texts are items of size 0; each row is an item,
equal rows too; an empty table gives no containers; columns beside the named ones are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.session import cut_lineage

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split before merges that belongs to this vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SHIPPED: dict[str, set[str]] = {}
BUCKET = 256
#: Most steps of the search in a bucket; the best packing found until then stands.
STEPS = 6000
FULL = 0.98


def _ship_vocabulary(spark: SparkSession, vocabulary: str) -> None:
    if vocabulary not in _SHIPPED.setdefault(spark.sparkContext.applicationId, set()):
        spark.sparkContext.addFile(vocabulary)
        _SHIPPED[spark.sparkContext.applicationId].add(vocabulary)


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    """The encoding of a vocabulary file, taken from what Spark sent to this worker where there is such a file."""
    import tiktoken

    sent = SparkFiles.get(os.path.basename(vocabulary)) if SparkFiles._is_running_on_worker else vocabulary
    with open(sent if os.path.exists(sent) else vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Counts tokens; words met before are looked up.

    The vocabulary's split always ends before a space that a visible character follows, so the
    counts of space-led words add up, but for runs of spaces, which are counted as a whole.
    """

    def __init__(self, vocabulary: str = VOCABULARY, kept: int = 400_000):
        self.encode, self.kept, self.known = encoding(vocabulary).encode_ordinary, kept, {}

    def part(self, text: str) -> int:
        n = self.known.get(text)
        if n is None:
            if len(self.known) >= self.kept:
                self.known.clear()
            n = self.known[text] = len(self.encode(text))
        return n

    def parts(self, text: str) -> list[str]:
        """The text in parts whose counts add up."""
        if "  " in text:
            return re.split(r"(?<=[^ ])(?= [^ ])", text)
        words = text.split(" ")
        return [words[0], *[" " + w for w in words[1:]]]

    def count(self, text: str) -> int:
        known = self.known
        try:
            return sum([known[p] for p in self.parts(text)])
        except KeyError:
            return sum([self.part(p) for p in self.parts(text)])


def pieces(text: str, counter: Counter, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the text's pieces: itself, if it fits."""
    n = counter.count(text)
    if n <= capacity:
        return [(0, len(text), n)]
    out, start, at, filled = [], 0, 0, 0
    for part in counter.parts(text):
        for sub in [part] if counter.part(part) <= capacity else _halves(part, counter, capacity):
            size = counter.part(sub) if len(sub) < 1000 else len(counter.encode(sub))
            if filled and filled + size > capacity:
                out.append((start, at, filled))
                start, filled = at, 0
            filled += size
            at += len(sub)
    return [*out, (start, at, filled)]


def _halves(part: str, counter: Counter, capacity: int) -> list[str]:
    if len(counter.encode(part)) <= capacity or len(part) < 2:
        return [part]
    half = len(part) // 2
    return _halves(part[:half], counter, capacity) + _halves(part[half:], counter, capacity)


def _best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing over sizes in falling order: each item where the least room is left."""
    room, owner, bins = [], [], []
    for i, size in enumerate(sizes):
        k = bisect_left(room, size)
        if k == len(room):
            bins.append([i])
            left, b = capacity - size, len(bins) - 1
        else:
            left, b = room.pop(k) - size, owner.pop(k)
            bins[b].append(i)
        k = bisect_left(room, left)
        room.insert(k, left)
        owner.insert(k, b)
    return bins


def _fillings(values: list[int], room: int, spare: int, budget: list[int]) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(waste, chosen places of `values`) of all undominated fillings of `room`, those with little waste first.

    `values` fall in size. A filling is dominated if another item still fits, or fits in the place
    of a smaller chosen one. At most `spare` may be wasted. The search is taken up anew for each
    band of waste, so that full fillings come first without listing all; it ends with the budget.
    """
    n = len(values)
    behind = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        behind[k] = behind[k + 1] + values[k]
    falling = [-v for v in values]
    done = -1
    for most in sorted({0, spare // 16, spare // 4, spare}):
        stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
        while stack and budget[0] > 0:
            at, left, chosen = stack.pop()
            budget[0] -= 1
            at = max(at, bisect_left(falling, -left))
            if at == n or not left:
                if done < left <= most and not _dominated(values, chosen, left):
                    yield left, chosen
                continue
            if left - behind[at] > most:
                continue
            skip = at + 1
            while skip < n and values[skip] == values[at]:
                skip += 1
            stack.append((skip, left, chosen))
            stack.append((at + 1, left - values[at], (*chosen, at)))
        done = most


def _dominated(values: list[int], chosen: tuple[int, ...], left: int) -> bool:
    taken = set(chosen)
    if not left:
        return False
    smallest = next((values[k] for k in range(len(values) - 1, -1, -1) if k not in taken), None)
    if smallest is None:
        return False
    if smallest <= left:
        return True
    for k in chosen:
        j = k - 1
        while j >= 0 and (j in taken or values[j] == values[k]):
            j -= 1
        if j >= 0 and values[j] - values[k] <= left:
            return True
    return False


def pack(sizes: list[int], capacity: int = CAPACITY, steps: int = STEPS) -> list[list[int]]:
    """Bins of item numbers. Every item is at most `capacity`."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    best = [[order[k] for k in b] for b in _best_fit([sizes[i] for i in order], capacity)]
    total = sum(sizes)
    least = max(-(-total // capacity), sum(1 for s in sizes if 2 * s > capacity))
    budget = [steps]

    def branch(rest: list[int], bins: list[list[int]], wasted: int) -> None:
        nonlocal best
        if not rest:
            if len(bins) < len(best):
                best = bins
            return
        # Fewer bins than the best known must hold everything, so this much may stay empty.
        spare = (len(best) - 1) * capacity - total - wasted
        if spare < 0 or len(best) <= least:
            return
        first, others = rest[0], rest[1:]
        for waste, chosen in _fillings([sizes[i] for i in others], capacity - sizes[first], spare, budget):
            if waste > (len(best) - 1) * capacity - total - wasted:
                continue
            gone = set(chosen)
            branch([i for k, i in enumerate(others) if k not in gone], [*bins, [first, *[others[k] for k in chosen]]], wasted + waste)
            if len(best) <= least or budget[0] <= 0:
                return

    branch([i for i in order if sizes[i]], [], 0)
    placed = {i for b in best for i in b}
    nothing = [i for i in range(len(sizes)) if i not in placed]
    if nothing:
        best = [[*best[0], *nothing], *best[1:]] if best else [nothing]
    return best


ITEMS = "id string, text_hash long, piece_no int, char_start int, char_end int, n_tokens int"
NAMES = [c.split()[0] for c in ITEMS.split(", ")]


def _measure(capacity: int, vocabulary: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(vocabulary)
        for batch in batches:
            rows = [(i, h, k, *p) for i, h, text in zip(batch["id"], batch["text_hash"], batch["text"], strict=True) for k, p in enumerate(pieces(text, counter, capacity))]
            yield pd.DataFrame(rows, columns=NAMES)

    return run


PACKED = "bucket long, container int, position int, " + ITEMS


def _fill(capacity: int, steps: int):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["id", "piece_no", "row"], ignore_index=True, na_position="first")
        bins = pack(items["n_tokens"].tolist(), capacity, steps)
        at = [(c, p, i) for c, b in enumerate(bins) for p, i in enumerate(b)]
        out = items.iloc[[i for _, _, i in at]].drop(columns="row").reset_index(drop=True)
        out.insert(1, "container", [c for c, _, _ in at])
        out.insert(2, "position", [p for _, p, _ in at])
        return out[["bucket", "container", "position", *NAMES]]

    return run


def _packed(items: DataFrame, round_: int, capacity: int, bucket: int, steps: int) -> DataFrame:
    """One round over all items; about `bucket` items share a task's group, never more than by chance."""
    buckets = max(1, -(-items.count() // bucket))
    rows = items.withColumn("row", F.monotonically_increasing_id()).withColumn("bucket", F.pmod(F.xxhash64("row", F.lit(round_)), F.lit(buckets)))
    done = rows.groupBy("bucket").applyInPandas(_fill(capacity, steps), PACKED)
    done = cut_lineage(done)
    fill = done.groupBy("bucket", "container").agg(F.sum("n_tokens").cast("int").alias("container_tokens"))
    name = F.format_string(f"{round_}-%d-%d", "bucket", "container")
    return done.join(fill, ["bucket", "container"]).select(name.alias("container_id"), "container_tokens", "position", *NAMES)


def containers(df: DataFrame, id_: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, bucket: int = BUCKET, full: float = FULL, rounds: int = 2, steps: int = STEPS) -> DataFrame:
    """(container_id, container_tokens, position, id, text_hash, piece_no, char_start, char_end, n_tokens).

    `vocabulary` is a file of a public tokenizer on the driver, which is sent to the workers.
    A container's content is its items by position; char_start and char_end count code points.
    """
    texts = df.select(F.col(id_).cast("string").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")).where("text is not null")
    _ship_vocabulary(df.sparkSession, vocabulary)
    items = cut_lineage(texts.mapInPandas(_measure(capacity, vocabulary), ITEMS))
    out = None
    for turn in range(1, rounds + 1):
        packed = _packed(items, turn, capacity, bucket, steps)
        if turn == rounds:
            return packed if out is None else out.unionByName(packed)
        keep = F.col("container_tokens") >= full * capacity
        kept = packed.where(keep)
        out = kept if out is None else out.unionByName(kept)
        items = cut_lineage(packed.where(~keep).select(*NAMES))
    return out


def container_texts(df: DataFrame, members: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(container_id, container_tokens, texts): each container's pieces of text by position.

    A container holds at most its capacity in tokens, so its array is bounded, but for texts of size 0.
    """
    texts = df.select(F.col(id_).cast("string").alias("id"), F.col(text).alias("text")).where("text is not null")
    texts = texts.groupBy("id", F.xxhash64("text").alias("text_hash")).agg(F.first("text").alias("text"))
    parts = members.join(texts, members["id"].eqNullSafe(texts["id"]) & (members["text_hash"] == texts["text_hash"])).select("container_id", "container_tokens", "position", F.expr("substring(text, char_start + 1, char_end - char_start)").alias("text"))
    return parts.groupBy("container_id", "container_tokens").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]).alias("texts"))
