"""Texts cut off by a field limit or in transfer: a vocabulary trie, ends of units and lengths.

One pass over all texts counts, within each task first, the corpus's words (without each text's
last one), how often each ends a sentence or line, and the lines within texts, their last
ones left out, that end without a stop; it also keeps every text's last line. From the counts Spark builds the vocabulary trie as a table
with a row for each proper prefix and the weight of the words below it. A text's last line is then
judged by what ends it:

* a stop, or a stop within closing signs: whole, unless it belongs to an abbreviation;
* nothing but a line that is also the whole of other texts, while few texts go on from it: whole;
* a last word that the corpus hardly knows but that begins words it knows well: cut;
* a mark of omission behind an open sentence: cut;
* a list item, table row, heading, label, reference, sign-off, or a line that recurs within
  enough different texts (or at their ends, if its last word mostly ends what it is in): whole, unless its length is one at which its source piles up texts and
  its last word seldom ends anything;
* any other line without a stop: cut, because its last word, as the trie counts it, seldom ends
  anything, because of its length, or for want of any sign of an end.

Defined results: NULL, empty and blank texts are whole; repeated rows give one row per id; a
NULL source is a source of its own in the rates; an empty table gives empty results; columns
beside the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.session import cut_lineage

#: A word with at most this share of the weight of the words it begins is taken for unknown.
KNOWN_SHARE = 0.004
#: Share of a word's uses that end a sentence or line, below which it seldom ends anything.
SELDOM = 0.05
#: Texts of one length in one source, and their excess over the lengths around, that speak of a limit.
PILE, EXCESS, AROUND = 5, 4.0, 12
#: Longest label, whole text and last line that may vouch for others; lines within texts are counted whatever their length.
SHORT = 90
#: Letters by which words and longer last words are joined in the trie.
HEAD = 12
#: Different texts, and share of all texts, that must hold a line for it to recur.
RECURS, RECURS_SHARE = 3, 0.0002
#: Share of a word's uses that end a sentence or line, from which texts' last lines with it may vouch for each other;
#: and share of the texts with one beginning that end there, from which the beginning is a whole text.
MOSTLY = 0.5
#: Distinct words a task holds before it passes its counts on.
HELD = 400_000

WORDS = re.compile(r"[^\W_]+")
STOP = re.compile(r"[.!?。！？][\"”»'’)\]*_]*$")
#: The same without an expression: what stands for a stop, and what may close behind it.
STOPS, CLOSERS = frozenset(".!?。！？"), "\"”»'’)]*_"
CITED = re.compile(r"(?:\s*\[\d{1,4}\])+$")
#: Marks of omission (fixed values), with or without brackets.
OMITTED = re.compile(
    r"(?:\s*(?:\.{3,}|…|[\[(<{]\s*(?:\.{2,}|…|cut|more|truncated|trunc|snip|continued|continues|cont(?:\.|inued)?|clipped|read more|see more|suite|la suite|lire la suite|weiter|mehr|gekürzt|abgeschnitten|seguir|sigue|más|leer más|cortado|tronqué|coupé)\s*(?:\.{2,}|…)?\s*[\])>}]|(?:read more|continue reading|show more)\s*[.»>]*))+\s*$",
    re.I,
)
#: Abbreviations whose stop ends no sentence (fixed values).
ABBREVIATED = re.compile(r"(?:^|[\s(])(?:sec|cf|no|nr|núm|n|e\.g|i\.e|p\. ?ex|z\. ?b|p\. ?ej|vgl|fig|art|abs|par|approx|vs)\.$|\bsec\. ?\d*\.$", re.I)
LIST = re.compile(r"^\s*(?:[-*•–+·]|\(?(?:\d{1,3}|[a-z])[.)])\s")
SIGNED = re.compile(r"^\s*(?:[—–]\s*\S|(?:kind|best|warm) regards|regards|sincerely|yours|mit freundlichen|cordialement|bien à vous|atentamente|saludos)", re.I)
REFERENCE = re.compile(r"^\s*(?:\[\d+\]|(?:see|cf|ref|refs|source|siehe|vgl|voir|véase|version|rev)\b.{0,80}\d[a-z]?\W*$|https?://\S+$)", re.I)
LABEL = re.compile(r"^\s*[^\W\d_][^\W\d_ ]*(?: [^\W\d_]+)?:\s")
#: What stands for a value that is not given (fixed values).
PLACEHOLDER = re.compile(r"^\W*(?:[^\W\d_]{1,2}(?:[./][^\W\d_]{1,2})+\.?|none|null|nil|unknown|tbd)\W*$", re.I)
BRACKETED = re.compile(r"^\s*[(\[<{].*[)\]>}]\s*$")
NUMBERED = re.compile(r"^\s*(?:\d+(?:\.\d+)*\.?|[A-Z]{1,4}-\d+[a-z]?(?:\(\d+\))*|(?:annex|appendix|anhang|annexe|anexo|chapter|section|part)\s+\S+)[ :–-]+\S", re.I)

#: The reasons for which a text counts as cut.
CUT = ("abbreviation", "mark", "prefix", "open", "goes_on", "limit", "unended")

COUNTED = "kind string, key string, n long, ends long, id string, source string, size int, line string, mark boolean, words array<string>, head string, line_key string"


def _trimmed(text: str) -> str:
    """Without white space, control, format and replacement characters at the end."""
    end = len(text)
    while end and (text[end - 1].isspace() or not text[end - 1].isprintable() or text[end - 1] == "�"):
        end -= 1
    return text[:end]


def last_line(text: str) -> tuple[str, bool]:
    """What the text ends with, without a mark of omission, and whether there was one (or a broken character)."""
    body = _trimmed(text)
    mark = "�" in text[len(body) :]
    # A mark is short, so each is looked for at the very end, until there is none left.
    while m := OMITTED.search(body[-80:]):
        before = body[: len(body) - len(body[-80:]) + m.start()]
        if not before.strip():
            break
        body, mark = _trimmed(before), True
    return body.rsplit("\n", 1)[-1].strip(), mark


def line_key(line: str) -> str:
    """A hash of 64 bits of a line's words."""
    words = " ".join(WORDS.findall(line.lower())).encode(errors="replace")
    return hashlib.blake2b(words, digest_size=8).hexdigest()


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in COUNTED.split(", ")]
    tokens, opened, lines = Counter(), Counter(), Counter()
    holders: dict[str, tuple[str, ...]] = {}  # up to RECURS different texts of each line

    def passed_on() -> pd.DataFrame:
        words, ends = Counter(), Counter()
        for token, n in tokens.items():
            found = WORDS.findall(token)
            for w in found:
                words[w] += n
            if found and STOP.search(token):
                ends[found[-1]] += n
        for token, n in opened.items():
            found = WORDS.findall(token)
            if found:
                ends[found[-1]] += n
        rows = [("word", w, n, ends[w], *[None] * 8) for w, n in words.items()] + [("line", k, n, 0, *[None] * 5, holders[k], None, None) for k, n in lines.items()]
        for c in (tokens, opened, lines, holders):
            c.clear()
        return pd.DataFrame(rows, columns=columns)

    for batch in batches:
        tails = []
        for id_, source, text in zip(batch["id"], batch["source"], batch["text"], strict=True):
            line, mark = last_line(text)
            low = text.lower().split()
            body = line.lower().split()
            # The last word says nothing about which words there are.
            tokens.update(low)
            if body:
                tokens[body[-1]] -= 1
            inside = set()
            for inner in text[: len(text.rstrip())].split("\n")[:-1]:
                inner = inner.strip()
                if inner and inner.rstrip(CLOSERS)[-1:] not in STOPS:
                    opened[inner.rsplit(None, 1)[-1].lower()] += 1
                    inside.add(line_key(inner))
            name = str(zlib.crc32(text.encode(errors="replace")))
            if inside:
                lines.update(inside)
                for key in inside:
                    known = holders.get(key, ())
                    if len(known) < RECURS and name not in known:
                        holders[key] = (*known, name)
            tails.append(("tail", name, 0, 0, id_, source, len(text), line, mark, WORDS.findall(line.lower())[-1:], text.strip()[: SHORT + 1], line_key(line)))
        yield pd.DataFrame(tails, columns=columns)
        if len(tokens) + len(lines) > HELD:
            yield passed_on()
    yield passed_on()


def counts(df: DataFrame, id_: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One pass over all texts: rows of kind word, line and tail, written once and read by each use."""
    rows = df.select(F.col(id_).cast("string").alias("id"), F.col(source).alias("source"), F.col(text).alias("text")).where("id is not null and text is not null")
    return cut_lineage(rows.mapInPandas(_count, COUNTED))


def vocabulary(counted: DataFrame) -> DataFrame:
    """(word, n, ends): words of letters, each text's last left out."""
    return counted.where("kind = 'word'").groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).where("n > 0")


def trie(words: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, below): of the `wanted` nodes (word) those that begin other words, and the weight of the words they begin.

    Nodes of fewer than `HEAD` letters are found by listing each word's shorter prefixes, deeper
    ones by joining on the first letters, so that a word of any length has few rows.
    """
    wanted = wanted.select(F.col("word").alias("node")).where("node is not null").distinct()
    heads = F.transform(F.sequence(F.lit(1), F.least(F.length("word") - 1, F.lit(HEAD - 1))), lambda k: F.substring("word", 1, k))
    short = words.where(F.length("word") > 1).select(F.explode(heads).alias("node"), "n").join(wanted, "node", "left_semi")
    head = lambda c: F.substring(c, 1, HEAD).alias("head")
    deep = words.where(F.length("word") > HEAD).select("word", "n", head("word")).join(wanted.where(F.length("node") >= HEAD).select("node", head("node")), "head")
    deep = deep.where(F.startswith("word", "node") & (F.col("word") != F.col("node"))).select("node", "n")
    return short.unionByName(deep).groupBy("node").agg(F.sum("n").alias("below"))


def piles(tails: DataFrame) -> DataFrame:
    """(source, size): lengths at which a source has far more texts than at the lengths around."""
    sizes = tails.where("size > 40").groupBy("source", "size").agg(F.count("*").alias("here"))
    near = F.sum("here").over(Window.partitionBy("source").orderBy("size").rangeBetween(-AROUND, AROUND)) - F.col("here")
    usual = F.greatest(near / (2.0 * AROUND), F.lit(0.5))
    return sizes.withColumn("usual", usual).where((F.col("here") >= PILE) & (F.col("here") >= EXCESS * F.col("usual"))).select("source", "size")


def whole_values(tails: DataFrame, least: float) -> DataFrame:
    """(value, alone): short lines without a stop that are all of at least `least` texts, and of most texts that begin with them."""
    values = tails.where((F.col("head") == F.col("line")) & (F.length("line") <= SHORT) & ~F.col("line").rlike("[.!?。！？]$"))
    values = values.groupBy(F.col("line").alias("value")).agg(F.count_distinct("id").alias("alone")).where(F.col("alone") >= least)
    sizes = [r.n for r in values.select(F.length("value").alias("n")).distinct().collect()]  # at most SHORT
    begun = tails.select("head", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("n")).where(F.length("head") > F.col("n"))
    longer = begun.select(F.left("head", "n").alias("value")).join(values.select("value"), "value", "left_semi").groupBy("value").agg(F.count("*").alias("longer"))
    return values.join(longer, "value", "left").where(F.col("alone") >= MOSTLY * (F.col("alone") + F.coalesce("longer", F.lit(0)))).select("value", "alone")


def _matches(line: Column, pattern: re.Pattern[str]) -> Column:
    """The pattern as Python means it: letters and digits of all scripts."""
    return line.rlike(("(?iU)" if pattern.flags & re.I else "(?U)") + pattern.pattern)


def _structural(line: Column) -> Column:
    """Whether a line is of a kind that ends without a stop."""
    title = line.rlike(r"^(?:[\p{Lu}][\p{L}\p{M}]*[ -]*){1,8}(?:[A-Z]{1,4}-\d+[a-z]?(?:\(\d+\))*)?$")
    signs = ~line.rlike(r"[\p{L}\p{N}]")
    patterns = [_matches(line, p) for p in (LIST, SIGNED, REFERENCE, BRACKETED)]
    label = _matches(line, LABEL) & (F.length(line) <= SHORT)
    numbered = _matches(line, NUMBERED) & (F.length(line) <= 60) & ~line.rlike(r"^[A-Z]{1,4}-\d+[a-z]?(?:\(\d+\))*:")
    kinds = title | signs | label | numbered | line.contains("|")
    for p in patterns:
        kinds = kinds | p
    return kinds


def judged(df: DataFrame, id_: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(id, source, size, cut, reason) of each text with an id; reason tells by what it was judged."""
    counted = counts(df, id_, source, text)
    tails = counted.where("kind = 'tail'").select(F.col("key").alias("name"), "id", "source", "size", "line", "mark", "head", "line_key", F.try_element_at("words", F.lit(-1)).alias("word"))
    words = cut_lineage(vocabulary(counted))
    nodes = cut_lineage(trie(words, tails))
    different = F.size(F.array_distinct(F.flatten(F.collect_list("words"))))
    lines = counted.where("kind = 'line'").groupBy(F.col("key").alias("line_key")).agg(F.sum("n").alias("times"), different.alias("different"))
    ending = tails.where((F.length("line") <= SHORT) & ~F.col("line").rlike("[.!?。！？]$")).groupBy("line_key").agg(F.count("*").alias("times"), F.count_distinct("name").alias("different"))
    least = max(RECURS, RECURS_SHARE * tails.count())
    enough = (F.col("different") >= RECURS) & (F.col("times") >= least)
    values = whole_values(tails, least)
    recurring, shared = lines.where(enough).drop("different"), ending.where(enough).select("line_key", F.col("times").alias("ending"))
    limits = piles(tails)
    known = tails.join(words, "word", "left").join(nodes.withColumnRenamed("node", "word"), "word", "left").join(recurring, "line_key", "left").join(shared, "line_key", "left").join(values, (F.col("head") == F.col("value")) & (F.col("line") == F.col("value")), "left")
    known = known.join(limits.withColumnsRenamed({"source": "_source", "size": "_size"}), F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")), "left")
    line, n = F.col("line"), F.coalesce("n", F.lit(0))
    cited = F.regexp_replace(line, CITED.pattern, "")
    stop = _matches(cited, STOP) & ~line.rlike(r"\.\.\.$")
    abbreviated = _matches(line, ABBREVIATED)
    last = F.regexp_extract(line, r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1)
    prefix = line.rlike(r"[\p{L}\p{M}]$") & last.rlike(r"^\p{L}+$") & F.col("below").isNotNull() & (n <= KNOWN_SHARE * F.col("below"))
    at_limit = F.col("_size").isNotNull()
    seldom = F.coalesce("ends", F.lit(0)) < SELDOM * n
    # Cut texts end alike too, but at words that mostly go on.
    ends_it = F.col("ending").isNotNull() & (F.coalesce("ends", F.lit(0)) >= MOSTLY * n)
    value = F.col("alone").isNotNull() & ~(prefix & (F.col("alone") < F.col("below")))
    reason = (
        F.when(F.length(line) == 0, "blank")
        .when(stop & abbreviated, "abbreviation")
        .when(stop, "stop")
        .when(F.col("mark") & ~line.rlike(r"^\W*$"), "mark")
        .when(_matches(line, PLACEHOLDER), "structure")
        .when(value, "recurring")
        .when(prefix, "prefix")
        .when((F.col("times").isNotNull() | ends_it & (F.length(line) <= SHORT)) & ~(at_limit & seldom), "recurring")
        .when(line.rlike(r"[,;(\[“«„'’-]$") & ~line.rlike(r"^\W*$") & ~line.rlike(r"^- .* -$"), "open")
        .when(_structural(line) & ~(at_limit & seldom), "structure")
        .when(seldom & (n > 0), "goes_on")
        .when(at_limit, "limit")
        .otherwise("unended")
    )
    return known.withColumn("reason", reason).select("id", "source", "size", F.col("reason").isin(*CUT).alias("cut"), "reason")


def cut_texts(df: DataFrame, id_: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(id) of the texts that were cut off."""
    return judged(df, id_, source, text).where("cut").select("id").distinct()


def rates(df: DataFrame, id_: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(source, texts, cut, share): how often each source cuts its texts."""
    by = judged(df, id_, source, text).groupBy("source").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut"))
    return by.withColumn("share", F.col("cut") / F.col("texts"))
