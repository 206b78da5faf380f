"""Evaluation texts in a corpus: rare n-gram seeds, joined, then Smith-Waterman alignment.

The corpus is read once. A task turns a document into words, marks where n-grams of the held-out
items stand, and passes on only the regions around them. How many documents hold each n-gram is
counted over the whole corpus; of every window of n-grams that a run of `run` words spans, only
the rarest is a seed, so every such run still meets a seed while phrases that half the corpus
shares seed next to nothing. Edited copies need not hold such a run, so where they count every
n-gram up to a share of the documents (`every`) is a seed as well. Regions and items that share
a seed are aligned.

The items' n-grams filter the corpus inside the scan. Items are taken in blocks of about
`most_grams` n-grams, one scan for each block, so that what a task holds is bounded and results
are the same for any number of items.

Words are runs of letters and digits after compatibility composition, case folding and removal
of invisible characters, for documents and items alike.

Defined results: NULL and empty texts and NULL ids hold nothing; repeated rows give one row per
(document, item); items shorter than `run` words can be aligned but not be found by a run; empty
tables give an empty result; columns beside the named ones are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.session import cut_lineage, spread

GRAM, RUN = 6, 12
#: Words in a row that an edited copy has to share to be aligned.
EDITED_GRAM = 4
#: N-grams of items that one scan of the corpus looks for.
MOST_GRAMS = 2_000_000
#: Share of the documents, and number of them in any case, up to which every n-gram of an item seeds edited copies.
EVERY, EVERY_DOCS = 0.01, 100
MATCH, MISMATCH, GAP = 2, -1, -1

WORD = re.compile(r"[^\W_]+")
#: Marks that show nothing though they are no format characters (fixed values).
UNSEEN = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)}


class _Visible(dict):
    """For str.translate: drops format and control characters that are no space, finding each once."""

    def __missing__(self, code: int) -> int | None:
        ch = chr(code)
        gone = code in UNSEEN or unicodedata.category(ch) in ("Cf", "Cc") and not ch.isspace()
        self[code] = value = None if gone else code
        return value


VISIBLE = _Visible()


def normal_words(text: str) -> list[str]:
    if text.isascii():
        return WORD.findall(text.translate(VISIBLE).lower() if not text.isprintable() else text.lower())
    text = unicodedata.normalize("NFKC", text.translate(VISIBLE)).casefold()
    return WORD.findall(unicodedata.normalize("NFKC", text))


def gram_keys(words: list[str], n: int) -> np.ndarray:
    """A 63-bit key for each n-gram of words, the same in every process."""
    if len(words) < n:
        return np.empty(0, np.int64)
    ids = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    keys = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        keys = keys * np.uint64(1_000_003) + ids[j : len(words) - n + 1 + j]
    return (keys >> np.uint64(1)).astype(np.int64)


def _item_words(n: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [normal_words(t) for t in batch["text"]]
            yield pd.DataFrame({"item": batch["id"], "words": words, "grams": [gram_keys(w, n) for w in words]})

    return run


class _Vocabulary:
    """The words and n-grams of the items, for a quick look at a document's words."""

    def __init__(self, grams: np.ndarray, words: set[str], n: int):
        self.grams, self.words, self.n = np.sort(grams), words, n

    def hits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known = self.words
        runs = np.fromiter([w in known for w in words], bool, len(words))
        if len(words) < self.n:
            return np.empty(0, int), np.empty(0, np.int64)
        # Only n words in a row that all occur in items can make up one of their n-grams.
        total = np.concatenate([[0], np.cumsum(runs)])
        starts = np.flatnonzero(total[self.n :] - total[: -self.n] == self.n)
        if not len(starts):
            return starts, np.empty(0, np.int64)
        first, last = starts[0], starts[-1] + self.n
        keys = gram_keys(words[first:last], self.n)[starts - first]
        at = np.searchsorted(self.grams, keys)
        good = self.grams[np.minimum(at, len(self.grams) - 1)] == keys
        return starts[good], keys[good]


REGIONS = "doc string, first int, words array<string>, grams array<long>"


def _regions(vocabulary: _Vocabulary, n: int, margin: int):
    """The regions of each document around the items' n-grams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                words = normal_words(text)
                at, keys = vocabulary.hits(words)
                if not len(at):
                    continue
                breaks = np.flatnonzero(np.diff(at) > 2 * margin) + 1
                for where, grams in zip(np.split(at, breaks), np.split(keys, breaks), strict=True):
                    first = max(0, int(where[0]) - margin)
                    rows.append((doc, first, words[first : int(where[-1]) + n + margin], grams.tolist()))
            yield pd.DataFrame(rows, columns=["doc", "first", "words", "grams"])

    return run


def rare_seeds(grams: DataFrame, frequency: DataFrame, n: int, run: int) -> DataFrame:
    """(item, at, gram): of each window of run - n + 1 n-grams of an item the rarest in the corpus.

    `grams` has (item, at, gram), `frequency` (gram, docs). An n-gram that no document holds can
    seed nothing and is taken only where a window has no other.
    """
    counted = grams.join(frequency, "gram", "left").withColumn("order", F.struct(F.coalesce("docs", F.lit(1 << 62)).alias("docs"), "gram", "at"))
    span = Window.partitionBy("item").orderBy("at").rowsBetween(0, run - n)
    windows = counted.withColumns({"low": F.min("order").over(span), "size": F.count("*").over(span), "all": F.count("*").over(Window.partitionBy("item"))})
    # An item with fewer n-grams than a window is one window.
    return windows.where((F.col("size") == run - n + 1) | ((F.col("at") == 0) & (F.col("all") < run - n + 1))).select("item", F.col("low.at").alias("at"), F.col("low.gram").alias("gram")).distinct()


def align(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: (score, words of `a` in the alignment's span, longest equal run)."""
    code: dict[str, int] = {}
    x = np.array([code.setdefault(w, len(code)) for w in a])
    y = np.array([code.setdefault(w, len(code)) for w in b])
    steps = np.arange(len(y) + 1) * -GAP
    above, run, begin = (np.zeros(len(y) + 1, int) for _ in range(3))
    best, longest, spans = 0, 0, 0
    for i, w in enumerate(x):
        same = y == w
        grown = np.concatenate([[0], np.where(same, run[:-1] + 1, 0)])
        diagonal = np.concatenate([[0], above[:-1] + np.where(same, MATCH, MISMATCH)])
        free = np.maximum(0, np.maximum(diagonal, above + GAP))
        from_diagonal = np.concatenate([[i], np.where(above[:-1] > 0, begin[:-1], i)])
        origin = np.where(free == diagonal, from_diagonal, begin)
        lifted = free + steps
        top = np.maximum.accumulate(lifted)
        row = np.maximum(free, top - steps)
        left = np.maximum.accumulate(np.where(lifted == top, np.arange(len(lifted)), 0))
        begin = np.where(row > free, origin[left], origin)
        above, run = row, grown
        at = int(row.argmax())
        if row[at] > best:
            best, spans = int(row[at]), i - int(begin[at]) + 1
        longest = max(longest, int(grown.max()))
    return best, spans, longest


def scores(owns: list[np.ndarray], regions: list[np.ndarray], at_once: int = 128) -> np.ndarray:
    """The Smith-Waterman scores of many pairs of word codes (0 and above), rows of the matrices of `at_once` pairs at a time.

    Pairs of like sizes are taken together and padded with codes that match nothing, which
    raises no score.
    """
    out = np.zeros(len(owns), np.int32)
    order = sorted(range(len(owns)), key=lambda k: (len(owns[k]), len(regions[k])))
    for first in range(0, len(order), at_once):
        taken = order[first : first + at_once]
        rows, columns = max(len(owns[k]) for k in taken), max(len(regions[k]) for k in taken)
        x, y = np.full((len(taken), rows), -2, np.int32), np.full((len(taken), columns), -1, np.int32)
        for at, k in enumerate(taken):
            x[at, : len(owns[k])], y[at, : len(regions[k])] = owns[k], regions[k]
        steps = np.arange(1, columns + 1, dtype=np.int32) * -GAP
        above, best = np.zeros((len(taken), columns + 1), np.int32), np.zeros(len(taken), np.int32)
        for i in range(rows):
            diagonal = above[:, :-1] + np.where(y == x[:, i : i + 1], MATCH, MISMATCH)
            free = np.maximum(np.maximum(diagonal, above[:, 1:] + GAP), 0)
            above[:, 1:] = np.maximum.accumulate(free + steps, axis=1) - steps
            best = np.maximum(best, above.max(axis=1))
        out[taken] = best
    return out


def _possible(least: float):
    """The pairs whose common words can make up `least` of a full score: no alignment matches more words than both have in common."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: dict[str, Counter] = {}
            keep = []
            for item, words, own in zip(batch["item"], batch["words"], batch["own"], strict=True):
                if item not in known:
                    known[item] = Counter(own)
                keep.append((known[item] & Counter(words)).total() >= least * len(own))
            yield batch[keep]

    return run


def _aligned(least: float):
    """Alignments of each region and item that reach `least` of a full score: the scores are worked out for many pairs at once first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if least and len(batch):
                code: dict[str, int] = {}
                coded = [[np.array([code.setdefault(w, len(code)) for w in words], np.int32) for words in batch[c]] for c in ("own", "words")]
                batch = batch[scores(*coded) >= least * MATCH * batch["own"].map(len).to_numpy()]
            rows = []
            for doc, item, words, own in zip(batch["doc"], batch["item"], batch["words"], batch["own"], strict=True):
                score, span, longest = align(list(own), list(words))
                rows.append((doc, item, score, span, longest, len(own)))
            yield pd.DataFrame(rows, columns=["doc", "item", "score", "span", "run", "words"])

    return run


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", doc_text: str = "text", item: str = "item_id", item_text: str = "text", gram: int = GRAM, run: int = RUN, most_grams: int = MOST_GRAMS, every: float | None = None, least: float = 0.0) -> DataFrame:
    """(doc, item, score, span, run, words): the best alignment of each document and item that share a seed.

    score is the Smith-Waterman score (2 a match, -1 a mismatch or gap), span the words of the item
    that the alignment covers, run the longest run of equal words, words the item's length. With `every`, n-grams found in at most
    that share of the documents (or `EVERY_DOCS`) are seeds too, beside the rarest of each window.
    Alignments below the share `least` of a full copy's score are left out.
    """
    if gram > run:
        raise ValueError("an n-gram must not be longer than the run it seeds")
    wanted = items.select(F.col(item).cast("string").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null").distinct()
    held = cut_lineage(wanted.mapInPandas(_item_words(gram), "item string, words array<string>, grams array<long>"))
    grams = held.select("item", F.posexplode("grams").alias("at", "gram"))
    bounds = held.agg(F.sum(F.size("grams")).alias("n"), F.max(F.size("words")).alias("most")).first()
    blocks = max(1, math.ceil((bounds.n or 0) / max(1, most_grams)))
    held = held.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    texts = documents.select(F.col(doc).cast("string").alias("id"), F.col(doc_text).alias("text")).where("id is not null and text is not null")
    regions = None
    for block in range(blocks):
        own = held.where(F.col("block") == block)
        keys, known = (own.select(F.explode(c).alias("x")).distinct().collect() for c in ("grams", "words"))  # about `most_grams` at most
        vocabulary = _Vocabulary(np.array([r.x for r in keys] or [-1], np.int64), {r.x for r in known}, gram)
        found = cut_lineage(texts.mapInPandas(_regions(vocabulary, gram, max(run, bounds.most or 0)), REGIONS)).withColumn("block", F.lit(block).cast("long"))
        regions = found if regions is None else regions.unionByName(found)
    seen = regions.select("doc", F.explode("grams").alias("gram"))
    frequency = seen.join(grams.select("gram").distinct(), "gram", "left_semi").distinct().groupBy("gram").agg(F.count("*").alias("docs"))
    if every is not None:
        frequency = cut_lineage(frequency)
    seeds = rare_seeds(grams, frequency, gram, run).select("item", "gram")
    if every is not None:
        most = max(EVERY_DOCS, every * texts.count())
        seeds = seeds.unionByName(grams.join(frequency.where(F.col("docs") <= most), "gram", "left_semi").select("item", "gram"))
    seeds = seeds.join(held.select("item", "block"), "item").distinct()
    region = F.xxhash64("doc", "first", "words", "block").alias("region")
    found = regions.select("doc", region, "block", F.explode(F.array_distinct("grams")).alias("gram")).join(seeds, ["block", "gram"]).select("doc", "region", "item").distinct()
    pairs = found.join(regions.select("doc", region, "words").distinct(), ["doc", "region"]).join(held.select("item", F.col("words").alias("own")), "item")
    pairs = pairs.select("doc", "item", "words", "own")
    if least:
        pairs = pairs.mapInPandas(_possible(least), pairs.schema)
    # An alignment takes far longer than its bytes tell.
    best = spread(pairs).mapInPandas(_aligned(least), "doc string, item string, score int, span int, run int, words int")
    return best.groupBy("doc", "item").agg(F.max("score").alias("score"), F.max_by("span", F.struct("score", "span")).alias("span"), F.max("run").alias("run"), F.max("words").alias("words"))


def repeated_runs(documents: DataFrame, items: DataFrame, run: int = RUN, **names) -> DataFrame:
    """(doc, item) of the documents that repeat `run` consecutive words of an item."""
    return leaks(documents, items, run=run, **names).where(F.col("run") >= run).select("doc", "item")
