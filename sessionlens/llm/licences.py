"""Licence scan: lines and whole texts against licence templates by the Dice coefficient of word bigrams.

A text is normalised (lower case, letters and digits kept, everything else a gap). Its units are
every line and the text as a whole; a unit and a template are compared as sets of word bigrams (a
single word stands for itself), Dice = 2 * common / (sizes added). A Dice of `least` or more is only
possible if the unit's size lies between least / (2 - least) and (2 - least) / least times the
template's, so a unit meets only the templates of fitting size, found by an equi join on the size.

Most units are passed over before they are cut into words: of a template's longest words, a few touch so
many of its bigrams that a unit with none of them has too few in common, so a unit must hold one of these
anchors (`anchors`), which a search for their letters tells.

Templates are a short list given as a parameter, at most `MOST_TEMPLATES` of at most `MOST_WORDS`
words, which bounds the broadcast. The scan adds no shuffle: every unit is judged on the row of its
document. Everything here is DataFrame and SQL functions.

`passages` compares windows of the whole text's words, which lines and whole texts miss.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

MOST_TEMPLATES = 500
MOST_WORDS = 20_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "), " "), "")


def bigrams_of(words: Column) -> Column:
    """The distinct bigrams; of a single word the word, of none nothing."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(n == 1, words).otherwise(pairs))


#: Words of so many letters are rare enough to be anchors by themselves.
RARE = 7


def anchors(templates: dict[str, str], least: float) -> list[tuple[str, ...]]:
    """Words, or pairs of words, of which the lower-cased text of every unit and window of Dice `least` or more contains one.

    A Dice of `least` needs least / (2 - least) of the template's bigrams. Long words are taken, the
    longest first, then bigrams, until the bigrams with none of them are fewer than that. Short templates choose
    first, and what they chose serves for longer ones too, inside words as well.
    """
    found: list[tuple[str, ...]] = []
    split = [re.sub("[^a-z0-9]+", " ", text.lower()).split() for text in templates.values()]
    for words in sorted(split, key=lambda w: (len(w), w)):
        bigrams = set(zip(words, words[1:])) if len(words) > 1 else {(w,) for w in words}
        needed = math.ceil(len(bigrams) * least / (2 - least) - 1e-9)
        seen = lambda b: any(all(any(a in w for w in b) for a in anchor) for anchor in found)
        bigrams = {b for b in bigrams if not seen(b)}
        single = [(w,) for w in sorted({w for w in words if len(w) >= RARE}, key=lambda w: (-len(w), w))]
        for anchor in [*single, *sorted(bigrams, key=lambda b: (-sum(map(len, b)), b))]:
            if len(bigrams) < needed:
                break
            if any(all(a in b for a in anchor) for b in bigrams):
                found.append(anchor)
                bigrams = {b for b in bigrams if not seen(b)}
    return sorted(set(found), key=lambda a: (len(a), -len(a[0]), a))


def _likely(text: str, pairs: list[tuple[str, ...]]) -> Column:
    """Whether a text holds the words of an anchor, in lower case, which is worked out once for all of them."""

    def holds(lower: Column) -> Column:
        out = F.lit(False)
        for first, *more in pairs:
            here = lower.contains(first)
            for w in more:
                here = here & lower.contains(w)
            out = out | here
        return out

    return F.exists(F.array(F.lower(F.col(text))), holds)


def _templates(spark: SparkSession, templates: dict[str, str], least: float) -> DataFrame:
    """(size, [(name, bigrams)]): for each unit size the templates that may reach `least`."""
    if len(templates) > MOST_TEMPLATES or any(len(t.split()) > MOST_WORDS for t in templates.values()):
        raise ValueError(f"at most {MOST_TEMPLATES} templates of {MOST_WORDS} words")
    listed = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("text")) for k, v in sorted(templates.items())])
    rows = spark.range(1, numPartitions=1).select(F.explode(listed).alias("t")).select("t.name", bigrams_of(words_of(F.col("t.text"))).alias("bigrams"))
    size = F.size("bigrams")
    low, high = F.ceil(size * F.lit(least / (2 - least)) - F.lit(1e-9)), F.floor(size * F.lit((2 - least) / least) + F.lit(1e-9))
    sized = rows.where(size > 0).withColumn("size", F.explode(F.sequence(F.greatest(low, F.lit(1)).cast("int"), high.cast("int"))))
    return sized.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("name", "bigrams"))).alias("fitting"))


def scanned(docs: DataFrame, templates: dict[str, str], least: float, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, `line`, `licence` and `dice`: one row for every unit and template of Dice `least` or more.

    Lines count from 1; the text as a whole is line 0 and is compared only if it has several lines
    with words. Null and empty texts and lines without a letter or digit match nothing. Repeated
    rows give repeated results; no rows or no templates give none. Long texts are read whole, a line at a time and
    once as a whole. Where `keep` has a name of a result, the result gets an underscore.
    """
    if not 0 < least <= 1:
        raise ValueError("least must lie in (0, 1]")
    source, keep, results = _inner(docs, text, keep, ("line", "licence", "dice"), templates, least)
    if not templates:
        return results(source.select(*keep, F.lit(0).alias("line"), F.lit("").alias("licence"), F.lit(0.0).alias("dice")).limit(0))
    likely = anchors(templates, least)
    by_size = _templates(docs.sparkSession, templates, least)
    lines = F.split(F.col("__text"), "\n")
    several = F.size(F.filter(lines, lambda x: F.lower(x).rlike("[a-z0-9]"))) > 1
    unit = lambda line, text: F.struct(line.cast("int").alias("line"), text.alias("unit"))
    every = F.concat(F.transform(lines, lambda x, i: unit(i + 1, x)), F.when(several, F.array(unit(F.lit(0), F.col("__text")))).otherwise(F.array().cast("array<struct<line: int, unit: string>>")))
    units = source.select(*keep, F.explode(every).alias("__u")).select(*keep, "__u.*").where(_likely("unit", likely))
    units = units.select(*keep, "line", bigrams_of(words_of(F.col("unit"))).alias("__bigrams"))
    units = units.where(F.size("__bigrams") > 0)
    fitted = units.join(F.broadcast(by_size), F.size("__bigrams") == by_size["size"])
    pairs = fitted.select(*keep, "line", "__bigrams", F.explode("fitting").alias("__t"))
    common = F.size(F.array_intersect(F.col("__bigrams"), F.col("__t.bigrams")))
    dice = 2 * common / (F.size("__bigrams") + F.size("__t.bigrams"))
    return results(pairs.select(*keep, "line", F.col("__t.name").alias("licence"), dice.alias("dice")).where(F.col("dice") >= F.lit(least)))


def _inner(docs: DataFrame, text: str, keep: tuple[str, ...], own: tuple[str, ...], templates: dict[str, str], least: float):
    """The texts that may hold a template, with the kept columns under inner names; these names; and how a result gets its outer names."""
    names = tuple(f"__kept{i}" for i in range(len(keep)))
    source = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("__text"))
    source = source.where(F.col("__text").isNotNull() & _likely("__text", anchors(templates, least)))
    outer = fresh(docs.select(*keep), *own)

    def results(frame: DataFrame) -> DataFrame:
        return frame.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], *[F.col(c).alias(o) for c, o in zip(own, outer)])

    return source, names, results


def passages(docs: DataFrame, templates: dict[str, str], least: float, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, `word`, `n_words`, `licence` and `dice`: windows of the whole text of Dice `least` or more.

    Line breaks are gaps like any other. A window begins and ends with a bigram of the template (others only lower
    its Dice); `word` counts from 1. Its bigrams are as many as the size bounds allow, repeated ones counted, where the
    template's own repeated ones count too. Of windows of one template that overlap, the one of the highest Dice stays,
    then the first, then the shorter; next to it those that it does not touch. A template of one word is compared with
    single words. Null texts match nothing; repeated rows give repeated results. Where `keep` has a name of a result, the
    result gets an underscore. A long text costs, for every place where a bigram of a template that it has enough of
    stands, a look at the window from there.
    """
    if not 0 < least <= 1:
        raise ValueError("least must lie in (0, 1]")
    if len(templates) > MOST_TEMPLATES or any(len(t.split()) > MOST_WORDS for t in templates.values()):
        raise ValueError(f"at most {MOST_TEMPLATES} templates of {MOST_WORDS} words")
    source, keep, results = _inner(docs, text, keep, ("word", "n_words", "licence", "dice"), templates, least)
    if not templates:
        return results(source.select(*keep, F.lit(0).alias("word"), F.lit(0).alias("n_words"), F.lit("").alias("licence"), F.lit(0.0).alias("dice")).limit(0))
    listed = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("text")) for k, v in sorted(templates.items())])
    rows = docs.sparkSession.range(1, numPartitions=1).select(F.explode(listed).alias("t")).select("t.name", words_of(F.col("t.text")).alias("words"))
    size, long = F.size("bigrams"), F.greatest(F.size("words") - 1, F.lit(1))
    low, high = F.ceil(size * F.lit(least / (2 - least)) - F.lit(1e-9)), F.floor(long * F.lit((2 - least) / least) + F.lit(1e-9))
    rows = rows.withColumn("bigrams", bigrams_of(F.col("words"))).where(size > 0)
    rows = rows.select("name", "bigrams", (F.size("words") == 1).alias("single"), F.greatest(low, F.lit(1)).cast("int").alias("low"), high.cast("int").alias("high"))
    every = rows.agg(F.array_distinct(F.flatten(F.collect_list("bigrams"))).alias("__every"))

    # Common bigrams are at least `low`, since 2 c >= least * (c + size).
    worded = source.select(*keep, words_of(F.col("__text")).alias("__words")).crossJoin(F.broadcast(every))
    met = F.array_intersect(F.concat(_pairs(F.col("__words")), F.col("__words")), F.col("__every"))
    met = worded.select(*keep, "__words", met.alias("__met"))
    fitted = met.join(F.broadcast(rows), F.size(F.array_intersect(F.col("__met"), rows["bigrams"])) >= rows["low"])
    fitted = fitted.select(*keep, "name", "bigrams", "single", "low", "high", F.when(F.col("single"), F.col("__words")).otherwise(_pairs(F.col("__words"))).alias("__grams"))

    grams, wanted = F.col("__grams"), F.col("bigrams")

    def begins(at: Column) -> Column:
        return F.array_contains(wanted, F.element_at(grams, at)) & (F.size(F.array_intersect(F.slice(grams, at, F.col("high")), wanted)) >= F.col("low"))

    def measured(at: Column, n: Column) -> Column:
        window = F.slice(grams, at, n)
        common = F.size(F.array_intersect(window, wanted))
        return F.struct((2 * common / (F.size(F.array_distinct(window)) + F.size(wanted))).alias("dice"), (-at).alias("at"), (-n).alias("n"))

    def best(at: Column) -> Column:
        last = F.least(F.col("high"), F.size(grams) - at + 1)
        ends = F.filter(F.sequence(F.col("low"), last), lambda n: F.array_contains(wanted, F.element_at(grams, at + n - 1)))
        return F.array_max(F.transform(F.when(last >= F.col("low"), ends), lambda n: measured(at, n)))

    starts = F.filter(F.sequence(F.lit(1), F.size(grams)), begins)
    found = fitted.where(F.size(grams) >= F.col("low")).select(*keep, "name", "single", F.filter(F.transform(starts, best), lambda w: w["dice"] >= F.lit(least)).alias("__found"))
    found = found.select(*keep, "name", "single", F.sort_array("__found", asc=False).alias("__found"))
    apart = lambda a, b: (-a["at"] - a["n"] <= -b["at"]) | (-b["at"] - b["n"] <= -a["at"])
    # Windows of bigrams that follow each other share a word, but no bigram: they count as apart.
    chosen = F.aggregate("__found", F.slice("__found", 1, 0), lambda got, w: F.when(F.forall(got, lambda g: apart(g, w)), F.concat(got, F.array(w))).otherwise(got))
    chosen = found.select(*keep, "name", "single", F.explode(chosen).alias("__w"))
    n_words = -F.col("__w.n") + F.when(F.col("single"), 0).otherwise(1)
    return results(chosen.select(*keep, (-F.col("__w.at")).alias("word"), n_words.alias("n_words"), F.col("name").alias("licence"), F.col("__w.dice").alias("dice")))


def _pairs(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))
