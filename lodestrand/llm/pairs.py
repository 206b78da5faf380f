"""Broken prompt and response pairs: clauses tagged by a conditional random field.

Each response is cut into clauses; a linear-chain field tags each clause as answer, refusal,
echo, foreign or unfinished, and the words covered by each tag settle the pair's defect.

The field sees no list of phrases. Its features are a clause's words and word pairs (words of the
question and control ids masked), how far clause and question overlap, the clause's language
scores against the question's, its length, place and ending, and how often its closing phrase
stands complete elsewhere. It is fitted on a bounded sample of pairs (`SAMPLE`, chosen by a hash
of the pair's id) with labels from several sources:

* planted defects, whose tags are known: sound responses cut at any place, put to questions in
  another language, or replaced by their question;
* for refusals, which can't be planted, five noisy sources of which one suffices: an apology
  before the clause, a speaker who says that they can't or won't, an opening that mostly answers
  questions known to be unanswerable, an opening that elsewhere stands behind an apology, and,
  behind a clause taken for a refusal, an opening that often stands there. Every
  refusal is also taken without its apology, so that the field learns the rest of its words;
* all other clauses count as answers. Pairs that may be defective in a way no source settles
  (another language than the question's, an end without a stop that is no known phrase) are
  left out of the fit.

What words speak for which language, how often an opening follows an apology, and how often a
short phrase stands as a whole response are counted over all pairs, by Spark.

Defined results: a NULL, blank or placeholder response, or one that is only a label or marks, is
`empty`, whatever the question; a NULL question counts as an empty one, which nothing repeats and
whose language is unknown; repeated rows count once; a pair without an id is left out; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.crf import Crf
from lodestrand.session import cut_lineage, spread

#: Most pairs the field is fitted on, and the share of them that is drawn from those with an apology or inability.
SAMPLE, SUSPECT = 4000, 0.08
#: Buckets of the field's words, and of the words counted by language; tables of these sizes go to the tasks.
HASHED, SPOKEN = 1 << 15, 1 << 16
#: How strongly the field's weights are drawn to 0, for the shape of a clause and for its words.
SHAPE_DECAY, WORD_DECAY = 1e-4, 2e-4
TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)

# Frequent function words by language, from which the languages of questions are told at first.
FUNCTION_WORDS = {
    "en": "the of and to in is are be that for with by which what how who when does do must shall should under on at from this it as or not an if has have was were will can may its their they there but than into each any no",
    "fr": "le la les des du de et que qui à pour dans est sont doit par sur aux au un une selon avec sans ce cette ces il elle ils elles ne pas plus ou où son sa ses leur leurs en dès après avant chaque lors toute tout quel quelle",
    "de": "der die das und den dem des ist wird für mit von zu bei nach wer was wann wie in vor gemäß ein eine einen einer eines nicht auf im am als aus durch oder sie er es sich werden sind bis unter über zum zur trotz welche welcher",
    "es": "el la los las de del y que en para con por es debe un una se al según quién cuándo qué cómo no su sus lo como más o sin este esta estos sobre son ser hasta cada tras ante durante cualquier cuál",
}
NAMES = tuple(FUNCTION_WORDS)
LANGUAGES = {w: {lang for lang, words in FUNCTION_WORDS.items() if w in words.split()} for words in FUNCTION_WORDS.values() for w in words.split()}
# Whole responses that stand for none.
PLACEHOLDERS = frozenset("empty null none nil na nan tbd tba todo pending unknown blank missing placeholder noanswer noresponse nothing tobeadded tobedone tobecompleted tobedetermined answer response".split())
# How an apology begins, and how a speaker says that they can't or won't.
APOLOGY = re.compile(
    r"^\W*(?:(?:i'm|i am|we are|we're) (?:very |so )?sorry|sorry|apologies|i apologi[sz]e|unfortunately|regrettably|as an? (?:ai|language model|assistant)|(?:je suis )?désolée?|malheureusement|leider|es tut mir leid|entschuldigung|lo siento|lamentablemente|desafortunadamente)\b[^,.;]{0,24}[,.;:]\s*(?:but|mais|aber|pero)?\s*",
    re.I,
)
INABILITY = re.compile(
    r"\b(?:i|we)(?:'m|'re)? (?:\w+ ){0,3}?(?:cannot|can't|can not|could not|couldn't|unable|won't|will not|decline|not able|not allowed|not permitted|rather not|don't know|do not know|refuse)\b"
    r"|\bje ne (?:peux|puis|sais|suis)\b|\bich (?:kann|darf|weiß|möchte)\b.*\bnicht\b|\bno (?:puedo|podemos|sé)\b|\bno me es posible\b",
    re.I,
)
#: The same for whoever may decline, spoken of by the rules they follow.
BARRED = re.compile(r"\b(?:i|me|my|we|us|our|permitted|guidelines)\b|\bby policy\b", re.I)

CITATIONS = re.compile(r"(?:\s*\[\d{1,4}\])+(?=\s*[.!?]?\s*$)")
MARKED_UP = re.compile(r"\[\d{1,4}\]")
SENTINEL = re.compile(r"\[NO_ANSWER\]", re.I)
LEAD = re.compile(r"^\W*(?:q|a|question|answer|response|frage|antwort|réponse|pregunta|respuesta)\s*:\s*", re.I)
WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
IDS = re.compile(r"\b[A-Z]{1,4}-\d+[a-z]?(?:\(\d+\))*")
CLAUSE_END = re.compile(r"(?<=[.!?;…])[\"”»)\]]*\s+(?=\S)|\n+")
ENDED = re.compile(r"[.!?…][\"”»'’)\]]*$")
OMITTED = re.compile(r"(?:\.\.\.|…)\W*$")


def clauses(text: str | None) -> list[str]:
    """The clauses of a response without sentinels, leads and citations; none if it says nothing."""
    body = CITATIONS.sub("", SENTINEL.sub(" ", text or "").strip()).strip()
    body = LEAD.sub("", body)
    parts, start = [], 0
    for m in CLAUSE_END.finditer(body):
        parts.append(body[start : m.start()] + body[m.start() : m.end()].strip())
        start = m.end()
    parts.append(body[start:])
    return [p for p in parts if WORDS.search(MARKED_UP.sub("", p))]


def is_empty(text: str | None) -> bool:
    bare = "".join(WORDS.findall(MARKED_UP.sub("", text or ""))).lower()
    return not bare or bare in PLACEHOLDERS or not clauses(text)


def words(text: str) -> list[str]:
    return WORDS.findall(MARKED_UP.sub("", text).lower().replace("’", "'"))


def phrase(text: str) -> str:
    """A short clause as it is counted: control ids as one word, case and signs left out."""
    return " ".join(words(IDS.sub(" id ", text)))


def ended(part: str) -> bool:
    return bool(ENDED.search(part.rstrip())) and not OMITTED.search(part.rstrip())


def language(tokens: list[str]) -> str | None:
    """The language most function words speak for; None without a clear lead."""
    score: dict[str, float] = {}
    for w in tokens:
        for bit in w.split("'"):
            hits = LANGUAGES.get(bit, ())
            for lang in hits:
                score[lang] = score.get(lang, 0) + 1 / len(hits)
    order = sorted(score.items(), key=lambda x: -x[1])
    if not order or order[0][1] < 1 or len(order) > 1 and order[0][1] < 1.3 * order[1][1]:
        return None
    return order[0][0]


def _bare_quotes(text: str) -> str:
    """The text without what is quoted, which may be in any language."""
    return re.sub(r"[“«\"„][^”»\"“]*[”»\"“]", " ", text)


def spoken_words(text: str) -> list[str]:
    """The words that speak for a language: none of quotes and ids."""
    return words(_bare_quotes(IDS.sub(" ", text)))


def masked(part: str, asked: set[str]) -> list[str]:
    """A clause's words with ids and longer words of the question masked, runs of masks as one."""
    out: list[str] = []
    for w in words(IDS.sub(" id ", part)):
        w = "_" if len(w) > 4 and w in asked else w
        if w != "_" or not out or out[-1] != "_":
            out.append(w)
    return out


#: What may lead up to the statement of a clause: its words before the first comma or colon.
LEAD_IN = re.compile(r"^[^,:]{1,60}[,:]\s*(?:but|mais|aber|pero)?\s*")


def openings_of(bare: str, asked: set[str]) -> set[str]:
    """The first three and four words of a clause, and of what follows a lead-in, if they say anything."""
    heads = [masked(t, asked)[:n] for t in {bare, LEAD_IN.sub("", bare)} for n in (3, 4)]
    return {" ".join(h) for h in heads if any(w not in ("_", "id") and w not in LANGUAGES for w in h)}


def overlap(clause: list[str], question: list[str]) -> float:
    """The share of the question that the clause repeats in order, 0 if it says more than that."""
    if not clause or not question:
        return 0.0
    text, whole = " " + " ".join(clause) + " ", " " + " ".join(question) + " "
    if text in whole:
        return len(clause) / len(question)
    return len(question) / len(clause) if whole in text and len(clause) <= len(question) + 2 else 0.0


@lru_cache(maxsize=1 << 18)
def bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode()) % buckets


class Tongues:
    """How much each word speaks for each language, learnt from all pairs; unknown words for none."""

    def __init__(self, counts: np.ndarray):
        # A word's share in each language, smoothed, against its mean over the languages that occur.
        total = counts.sum(axis=0)
        self.spoken = total > 0
        share = (counts + 0.1) / np.maximum(total, 1.0)
        known = np.log(share)
        known[:, ~self.spoken] = -30.0
        mean = known[:, self.spoken].mean(axis=1, keepdims=True) if self.spoken.any() else 0.0
        self.odds = np.where(counts.sum(axis=1, keepdims=True) > 0, np.clip(known - mean, -4, 4), 0.0).astype(np.float32)

    def scores(self, tokens: list[str]) -> np.ndarray:
        if not tokens:
            return np.zeros(len(NAMES))
        return self.odds[[bucket(w, SPOKEN) for w in tokens]].sum(axis=0)


# The levels of each feature of a clause's shape; its words come behind.
LEVELS = {"any": 1, "of_clause": 6, "of_question": 6, "repeats": 4, "foreign": 6, "foreign_all": 6, "ending": 6, "complete": 6, "size": 5, "place": 4, "only_ids": 2}
OFFSET = dict(zip(LEVELS, np.cumsum([0, *LEVELS.values()]).tolist(), strict=False))
SHAPES = sum(LEVELS.values())
FEATURES = SHAPES + HASHED


def _level(x: float, bounds: tuple[float, ...]) -> int:
    return sum(x >= b for b in bounds)


def _ending(part: str) -> int:
    """How a clause ends: in a stop, a mark of omission, a letter, a digit, a comma and the like, or another sign."""
    part = part.rstrip()
    if OMITTED.search(part):
        return 1
    if ENDED.search(part):
        return 0
    end = part[-1:]
    return 2 if end.isalpha() else 3 if end.isdigit() else 4 if end in ",;:-–(" else 5


def describe(question: str, response: str, complete: float | None, tongues: Tongues) -> tuple[list[list[int]], list[int]]:
    """Of each clause: its features and its number of words.

    `complete` is the share of complete uses of the response's short last clause, if it has one.
    """
    asked, parts = words(question), clauses(response)
    known = set(asked)
    spoken = [spoken_words(p) for p in parts]
    base = tongues.scores(spoken_words(question))
    own_tongue = int(base.argmax()) if base.max() > 1 else None
    together = tongues.scores([w for s in spoken for w in s])

    def strange(score: np.ndarray, n: int) -> int:
        """How far another language than the question's is ahead of it, per word."""
        if own_tongue is None or not n:
            return 5
        return _level((score.max() - score[own_tongue]) / n, (0.02, 0.3, 0.8, 1.5))

    features, sizes = [], []
    for i, part in enumerate(parts):
        own = words(part)
        n, last = len(own), i == len(parts) - 1
        shared = sum(w in known for w in own)
        bounds = (0.2, 0.4, 0.6, 0.8, 0.999)
        shape = {
            "any": 0,
            "of_clause": _level(shared / n, bounds),
            "of_question": _level(len(known & set(own)) / max(1, len(known)), bounds),
            "repeats": _level(overlap(own, asked), (0.01, 0.5, 0.7)),
            "foreign": strange(tongues.scores(spoken[i]), len(spoken[i])),
            "foreign_all": strange(together, sum(map(len, spoken))),
            "size": _level(n, (2, 4, 7, 13)),
            "place": 2 * (i == 0) + last,
            "only_ids": int(all(w in ("id", "and", "or") for w in words(IDS.sub(" id ", part)))),
        }
        if last:
            # What ends a response, and whether a short phrase there is one that stands complete elsewhere.
            shape["ending"] = _ending(part)
            alone = all(overlap(words(p), asked) >= 0.7 for p in parts[:-1])
            shape["complete"] = 5 if complete is None or not alone else _level(complete, (0.2, 0.4, 0.6, 0.8))
        tokens = ["^", *masked(part, known), "$" if ended(part) else "~"]
        hashed = {SHAPES + bucket(w, HASHED) for w in [*tokens[1:-1], *(f"{a} {b}" for a, b in zip(tokens[:-2], tokens[1:-1], strict=True)), " ".join(tokens[:4])]}
        features.append([OFFSET[k] + v for k, v in shape.items()] + sorted(hashed))
        sizes.append(n)
    return features, sizes


class Pair(NamedTuple):
    question: str
    response: str
    complete: float | None


def cut(text: str, at: float) -> str:
    """A response cut off after the share `at` of its characters."""
    return text[: max(1, int(len(text) * at))].rstrip()


def _share_of(name: str, salt: str) -> float:
    """A number of 0..1 that is always the same for one name."""
    return int.from_bytes(hashlib.blake2b(f"{salt}:{name}".encode(), digest_size=8).digest()) / 2**64


def refusing(parts: list[str], asked: set[str], openings: dict[str, tuple[int, int, int, int]], usual: float) -> list[bool]:
    """Which clauses one of the noisy sources takes for a refusal.

    `openings` has (uses, behind an apology, for unanswerable questions, after such a clause).
    """
    out: list[bool] = []
    for part in parts:
        bare = APOLOGY.sub("", part)
        found = bare != part or bool(INABILITY.search(part))
        for key in openings_of(bare, asked):
            n, behind, lacking, after = openings.get(key, (0, 0, 0, 0))
            lacks = n >= 5 and lacking >= max(0.5, min(0.9, 3 * usual)) * n
            led = behind >= 2 and behind >= 0.1 * n
            follows = bool(out) and out[-1] and n >= 3 and after >= 0.2 * n
            found = found or lacks or led or follows
        out.append(found)
    return out


def labelled(name: str, pair: Pair, openings: dict, usual: float) -> tuple[list[int] | None, bool]:
    """The tags of a pair's clauses by the sources, None where they don't settle it; and whether it is sound."""
    asked, parts = words(pair.question), clauses(pair.response)
    declines = refusing(parts, set(asked), openings, usual)
    tags = []
    for part, no in zip(parts, declines, strict=True):
        tags.append(ECHO if overlap(words(part), asked) >= 0.7 else REFUSAL if no else ANSWER)
    own, theirs = language(asked), language([w for p in parts for w in spoken_words(p)])
    if own and theirs and own != theirs and set(tags) != {REFUSAL}:
        return None, False
    known_phrase = all(t == ECHO for t in tags[:-1]) and pair.complete is not None and pair.complete >= 0.6
    if not ended(parts[-1]) and tags[-1] != ECHO and not known_phrase:
        return None, False
    return tags, set(tags) == {ANSWER}


def training(pairs: list[tuple[str, Pair]], openings: dict, usual: float, tongues: Tongues) -> tuple[list[list[list[int]]], list[list[int]]]:
    """Sequences of features with their tags: the pairs that the sources settle, and planted defects."""
    xs, ys, sound = [], [], []

    def add(question: str, response: str, complete: float | None, tags: list[int]) -> None:
        features, _ = describe(question, response, complete, tongues)
        if features and len(features) == len(tags):
            xs.append(features)
            ys.append(tags)

    for name, pair in pairs:
        tags, whole = labelled(name, pair, openings, usual)
        if tags is None:
            continue
        add(*pair, tags)
        if REFUSAL in tags:
            parts = clauses(pair.response)
            bare = " ".join([APOLOGY.sub("", p) for p in parts])
            if bare != " ".join(parts):
                add(pair.question, bare, None, tags)
        if whole:
            sound.append((name, pair, language(words(pair.question))))
    asked = {lang: [p.question for _, p, own in sound if own == lang] for lang in NAMES}
    for name, pair, own in sound:
        kind, at = _share_of(name, "kind"), _share_of(name, "at")
        if kind < 0.5:
            if len(words(pair.response)) > 6 or own not in (None, "en"):
                short = cut(pair.response, 0.15 + 0.8 * at)
                if at < 0.1 and "," in pair.response:
                    short = pair.response[: pair.response.rindex(",") + 1]
                parts = clauses(short)
                if parts and short != pair.response.rstrip() and not ended(short):
                    few = len(words(parts[-1])) <= 6 and len(parts) == 1
                    add(pair.question, short, 0.0 if few else None, [ANSWER] * (len(parts) - 1) + [UNFINISHED])
        elif kind < 0.7:
            said = cut(pair.question, 0.75 + 0.3 * at) if at < 0.5 else pair.question
            said = said.lower() if 0.3 < at < 0.4 else said.upper() if 0.4 < at < 0.5 else said
            n = len(clauses(said))
            add(pair.question, said, 0.0 if len(words(said)) <= 6 else None, [ECHO] * n)
        else:
            others = [lang for lang in NAMES if lang != own and asked[lang]]
            spoken = language(spoken_words(pair.response))
            if own and spoken == own and others:
                lang = others[int(at * len(others))]
                question = asked[lang][int(_share_of(name, "question") * len(asked[lang]))]
                add(question, pair.response, pair.complete, [FOREIGN] * len(clauses(pair.response)))
    return xs, ys


def defect(tags: list[int], sizes: list[int], lacks_only: bool, may_lack: bool) -> str | None:
    """The pair's defect by the words that each tag covers."""
    words_of = [sum(n for t, n in zip(tags, sizes, strict=True) if t == k) for k in range(len(TAGS))]
    told = sum(words_of) - words_of[ECHO]
    if not told:
        return "copy"
    if words_of[FOREIGN] >= 0.5 * told:
        return "language"
    if words_of[REFUSAL] > 0.5 * told or tags[0] == REFUSAL and not words_of[ANSWER]:
        return None if lacks_only and may_lack else "refusal"
    return "truncated" if tags[-1] == UNFINISHED else None


def fitted_field(xs: list[list[list[int]]], ys: list[list[int]]) -> Crf:
    decay = np.where(np.arange(FEATURES) < SHAPES, SHAPE_DECAY, WORD_DECAY)
    return Crf(FEATURES, len(TAGS)).fit(xs, ys, decay)


def tagged_pair(model: Crf, tongues: Tongues, question: str | None, response: str | None, may_lack: bool, complete: float | None) -> tuple[str | None, list[int] | None, list[int] | None]:
    """(defect, tags, sizes) of one pair."""
    if is_empty(response):
        return "empty", None, None
    features, sizes = describe(question or "", response, complete, tongues)
    tags = model.decode(features)
    lacks = not any(t == REFUSAL and BARRED.search(c) for t, c in zip(tags, clauses(response), strict=True))
    return defect(tags, sizes, lacks, may_lack), tags, sizes


SURVEY = "kind string, key string, pair_id string, a long, b long, c long, d long"


def _survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the pairs say of words, openings and short phrases, added up within each batch.

    word: (bucket:language, pairs). opening: (uses, behind an apology, for unanswerable questions,
    after an apology or inability). phrase: (whole uses, longer uses). short: a pair's last clause
    if it is short and unended.
    """
    for batch in batches:
        spoken, openings, phrases, shorts = Counter(), {}, {}, []
        for pair_id, question, response, may_lack in zip(batch["pair_id"], batch["question"], batch["response"], batch["may_lack"], strict=True):
            if is_empty(response):
                continue
            asked = words(question or "")
            known, own, parts = set(asked), language(asked), clauses(response)
            if own:
                spoken.update(f"{bucket(w, SPOKEN)}:{NAMES.index(own)}" for w in {*spoken_words(question), *spoken_words(response)})
            before = False
            for i, part in enumerate(parts):
                bare = APOLOGY.sub("", part)
                for key in openings_of(bare, known):
                    seen = openings.setdefault(key, [0, 0, 0, 0])
                    seen[0] += 1
                    seen[1] += bare != part
                    seen[2] += bool(may_lack)
                    seen[3] += before
                before = bare != part or bool(INABILITY.search(part))
                tokens = phrase(part).split()
                if i == len(parts) - 1 and len(tokens) <= 6 and not ENDED.search(part.rstrip()):
                    shorts.append(("short", " ".join(tokens), pair_id, 0, 0, 0, 0))
                    phrases.setdefault(" ".join(tokens), [0, 0])[0] += 1
                    continue
                for n in range(1, min(6, len(tokens)) + 1):
                    phrases.setdefault(" ".join(tokens[:n]), [0, 0])[n < len(tokens)] += 1
        rows = [("word", k, None, n, 0, 0, 0) for k, n in spoken.items()] + [("opening", k, None, *v) for k, v in openings.items()]
        yield pd.DataFrame(rows + [("phrase", k, None, *v, 0, 0) for k, v in phrases.items()] + shorts, columns=["kind", "key", "pair_id", "a", "b", "c", "d"])


def _tag(model: Crf, tongues: Tongues):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pair_id, question, response, may_lack, complete in zip(batch["pair_id"], batch["question"], batch["response"], batch["may_lack"], batch["complete"], strict=True):
                found, tags, sizes = tagged_pair(model, tongues, question, response, bool(may_lack), None if complete != complete else complete)
                rows.append((pair_id, found, tags and [TAGS[t] for t in tags], sizes))
            yield pd.DataFrame(rows, columns=["pair_id", "defect", "tags", "words"])

    return run


def pairs_of(golden: DataFrame, calls: DataFrame) -> DataFrame:
    """(pair_id, question, response, may_lack) of golden examples and recorded calls, once each."""
    first = golden.select(F.col("id").alias("pair_id"), "question", F.col("reference_answer").alias("response"), F.coalesce(F.col("type") == "unanswerable", F.lit(False)).alias("may_lack"))
    asked = F.filter(F.flatten(F.transform(F.filter("request.messages", lambda m: m["role"] == "user"), lambda m: F.split(F.coalesce(m["content"], F.lit("")), "\r?\n"))), lambda line: line.startswith("Question: "))
    second = calls.select(F.col("call_id").alias("pair_id"), F.substring(F.try_element_at(asked, F.lit(-1)), 11, 1 << 30).alias("question"), F.col("response.text").alias("response"), F.lit(False).alias("may_lack"))
    return first.unionByName(second).where("pair_id is not null").distinct()


def sampled(rows: DataFrame, sample: int) -> list[tuple[str, Pair]]:
    """At most `sample` pairs in the order of a hash of their ids, part of them with a sign of refusal."""
    said = rows.where("response is not null")
    order = [F.xxhash64("pair_id"), F.col("pair_id"), F.col("response")]
    signs = [F.col("response").rlike("(?iU)" + p.pattern) for p in (APOLOGY, INABILITY)]
    suspects = said.where(signs[0] | signs[1]).orderBy(*order).limit(int(sample * SUSPECT)).collect()
    known = {(r.pair_id, r.response) for r in suspects}
    others = [r for r in said.orderBy(*order).limit(sample).collect() if (r.pair_id, r.response) not in known]
    return [(r.pair_id, Pair(r.question or "", r.response, r.complete)) for r in [*suspects, *others][:sample] if not is_empty(r.response)]


def fitted(pairs: DataFrame, sample: int = SAMPLE) -> tuple[Crf, Tongues, DataFrame]:
    """The field, the languages' words, and the pairs with `complete`."""
    pairs = cut_lineage(spread(pairs))
    # Read by each of the counts below, so it is worked out once.
    survey = cut_lineage(pairs.mapInPandas(_survey, SURVEY))
    totals = survey.where("kind <> 'short'").groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in "abcd"])
    counts = np.zeros((SPOKEN, len(NAMES)))
    for r in totals.where("kind = 'word'").collect():  # at most SPOKEN rows a language
        at, lang = r.key.split(":")
        counts[int(at), int(lang)] = r.a
    tongues = Tongues(counts)
    uses = totals.where("kind = 'phrase'").select("key", "a", "b")
    short = survey.where("kind = 'short'").select("key", "pair_id").withColumn("opening", F.regexp_replace("key", " ?[^ ]+$", ""))
    # A cut word is no opening of its own, so what the words before it go on to counts as well.
    opened = uses.select(F.col("key").alias("opening"), F.col("b").alias("around"))
    share = F.col("a") / (F.col("a") + F.col("b") + F.coalesce("around", F.lit(0)))
    short = short.join(uses, "key").join(opened, "opening", "left").groupBy("pair_id").agg(F.min(share).alias("complete"))
    rows = cut_lineage(spread(pairs.join(short, "pair_id", "left")))
    chosen = sampled(rows, sample)
    keys = {k for _, p in chosen for c in clauses(p.response) for k in openings_of(APOLOGY.sub("", c), set(words(p.question)))}
    wanted = pairs.sparkSession.createDataFrame([(k,) for k in sorted(keys)], "key string")  # of the sample's clauses only
    known = totals.where("kind = 'opening'")
    openings = {r.key: (r.a, r.b, r.c, r.d) for r in known.join(wanted, "key").collect()}
    usual = known.agg(F.sum("c") / F.sum("a")).first()[0] or 0.0
    return fitted_field(*training(chosen, openings, usual, tongues)), tongues, rows


def tagged(pairs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(pair_id, defect, tags, words): the tags of a pair's clauses and their sizes; defect NULL if sound."""
    model, tongues, rows = fitted(pairs, sample)
    return rows.mapInPandas(_tag(model, tongues), "pair_id string, defect string, tags array<string>, words array<int>")


def broken_pairs(pairs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return tagged(pairs, sample).where("defect is not null").select("pair_id", "defect").distinct()
