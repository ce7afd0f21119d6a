"""Full-text search: stemmed words without stop words, and an inverted index that batches and streams keep up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquarry.engine.tables import kept
from skyquarry.streaming.merge import MergedTable

#: English words that aren't searched for.
STOP = """a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down
during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself
no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then
there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves""".split()

#: The endings of a published suffix-stripping algorithm (steps 2 to 4), and what replaces them.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: A stem's measure: vowel-consonant pairs.
MORE_THAN_0, EXACTLY_1, MORE_THAN_1 = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}"
HAS_VOWEL, SHORT = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"


def _ending(word: Column, endings: list[str], then: Callable[[Column, Column], Column]) -> Column:
    """word with its longest of these endings changed: then(what is before it, the ending)."""
    pattern = f"^(.+?)({'|'.join(endings)})$"
    return F.when(word.rlike(pattern), then(F.regexp_extract(word, pattern, 1), F.regexp_extract(word, pattern, 2))).otherwise(word)


def _plural(w: Column) -> Column:
    return F.when(w.rlike("^.+(ss|i)es$"), F.substring(w, F.lit(1), F.length(w) - 2)).when(w.rlike("^.+[^s]s$"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def _past(w: Column) -> Column:
    """eed, ed and ing; the words that lose one of the last two end in an apostrophe, for the step that mends them."""
    stem = F.regexp_extract(w, "^(.+?)(ed|ing)$", 1)
    eed = F.when(F.regexp_extract(w, "^(.+?)eed$", 1).rlike(MORE_THAN_0), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.when(w.rlike("^.+eed$"), eed).when(w.rlike("^.+(ed|ing)$") & stem.rlike(HAS_VOWEL), F.concat(stem, F.lit("'"))).otherwise(w)


def _mended(w: Column) -> Column:
    bare = F.substring(w, F.lit(1), F.length(w) - 1)
    out = F.when(bare.rlike("(at|bl|iz)$") | (bare.rlike(SHORT) & ~bare.rlike(r"([^aeiouylsz])\1$")), F.concat(bare, F.lit("e")))
    return F.when(w.endswith("'"), out.when(bare.rlike(r"([^aeiouylsz])\1$"), F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)).otherwise(w)


def _final_y(w: Column) -> Column:
    stem = F.substring(w, F.lit(1), F.length(w) - 1)
    return F.when(w.endswith("y") & stem.rlike(HAS_VOWEL), F.concat(stem, F.lit("i"))).otherwise(w)


def _replaced(endings: dict[str, str]) -> Callable[[Column], Column]:
    table = F.create_map(*(F.lit(x) for pair in endings.items() for x in pair))
    return lambda w: _ending(w, list(endings), lambda stem, e: F.when(stem.rlike(MORE_THAN_0), F.concat(stem, table[e])).otherwise(w))


def _dropped(w: Column) -> Column:
    ion = w.rlike("^.+[st]ion$")
    stem = F.substring(w, F.lit(1), F.length(w) - 3)
    out = _ending(w, FOURTH, lambda stem, e: F.when(stem.rlike(MORE_THAN_1), stem).otherwise(w))
    return F.when(ion, F.when(stem.rlike(MORE_THAN_1), stem).otherwise(w)).otherwise(out)


def _final_e(w: Column) -> Column:
    stem = F.substring(w, F.lit(1), F.length(w) - 1)
    return F.when(w.endswith("e") & (stem.rlike(MORE_THAN_1) | (stem.rlike(EXACTLY_1) & ~stem.rlike(SHORT))), stem).otherwise(w)


def _double_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & w.rlike(MORE_THAN_1), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def _each(words: Column, step: Callable[[Column], Column]) -> Column:
    return F.transform(words, lambda w: F.when(w.rlike("^[a-zY][a-z']{2,}$"), step(w)).otherwise(w))


def stems(words: Column) -> Column:
    """Each word of an array without its suffix; words under three letters, or with others than a to z, stay.

    One transform a step, so no step repeats what is before it.
    """
    plain = lambda w: (F.length(w) > 2) & w.rlike("^[a-z]+$")
    out = F.transform(words, lambda w: F.when(plain(w), F.regexp_replace(w, "^y", "Y")).otherwise(w))
    for step in (_plural, _past, _mended, _final_y, _replaced(SECOND), _replaced(THIRD), _dropped, _final_e, _double_l):
        out = _each(out, step)
    return F.transform(out, lambda w: F.regexp_replace(w, "^Y", "y"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def lexemes(text: Column) -> Column:
    """(term, position) of a text's words, from 1; stop words count as places only.  Null text has none."""
    words = words_of(text)
    placed = F.transform(F.arrays_zip(words.alias("w"), stems(words).alias("t")), lambda s, i: F.struct(s["t"].alias("term"), (i + 1).alias("position"), F.array_contains(F.array(*(F.lit(x) for x in STOP)), s["w"]).alias("stop")))
    return F.transform(F.filter(placed, lambda s: ~s["stop"]), lambda s: F.struct(s["term"].alias("term"), s["position"].alias("position")))


def terms_of(spark: SparkSession, text: str) -> list[str]:
    """The distinct terms of a search text."""
    return sorted({s["term"] for s in spark.range(1).select(lexemes(F.lit(text)).alias("l")).first()["l"]})


def matching(docs: DataFrame, text: str, id_column: str = "id", text_column: str = "text") -> DataFrame:
    """The ids of docs that hold all terms of a search text, by a scan; a text without terms finds nothing."""
    wanted = terms_of(docs.sparkSession, text)
    found = docs.select(id_column, F.transform(lexemes(F.col(text_column)), lambda s: s["term"]).alias("_terms"))
    return found.where(F.size(F.array_except(F.array(*(F.lit(w) for w in wanted)).cast("array<string>"), F.col("_terms"))) == 0).select(id_column) if wanted else found.where("false").select(id_column)


class Index:
    """Postings (term, id, positions) by term, beside the terms of each id, so that an update knows what to take away."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 16):
        self.spark = spark
        self.postings = MergedTable(spark, f"{path}/postings", "term string, id bigint, positions array<int>", ["term", "id"], parts)
        self.postings.part_of = lambda *keys: F.pmod(F.xxhash64(*(keys or ["term"])), F.lit(parts)).cast("int")  # a term lies in one partition
        self.forward = MergedTable(spark, f"{path}/forward", "id bigint, terms array<string>", ["id"], parts)

    def apply(self, docs: DataFrame, batch: int, deleted: Column | None = None, order: list[str] | None = None) -> None:
        """Indexes a batch of docs(id, text): new, changed and (where ``deleted``) removed ones; running it again changes nothing."""
        gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
        last = docs.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct(*(order or []), gone.alias("_gone"), F.col("text").alias("_text"))).alias("_l"))
        now = last.select("id", F.when(~F.col("_l._gone"), F.col("_l._text")).alias("text"), F.col("_l._gone").alias("gone"))
        # each distinct word is stemmed once
        words = now.select("id", F.posexplode(words_of(F.col("text"))).alias("at", "word")).where(~F.col("word").isin(STOP))
        known = kept(words.select("word").distinct().select("word", stems(F.array("word"))[0].alias("term")))  # a table, so Spark can split a frequent word's rows
        placed = kept(words.join(known, "word").select("id", "term", F.col("at") + 1))
        placed = placed.toDF("id", "term", "position")
        new = placed.groupBy("term", "id").agg(F.sort_array(F.collect_list("position")).alias("positions"))
        old = self.forward.read(batch).join(now.select("id"), "id", "left_semi").select(F.explode("terms").alias("term"), "id")
        stale = old.join(new.select("term", "id"), ["term", "id"], "left_anti").select("term", "id", F.lit(None).cast("array<int>").alias("positions"), F.lit(True).alias("_del"))
        self.postings.apply(new.withColumn("_del", F.lit(False)).unionByName(stale), batch, F.col("_del"))
        terms = placed.groupBy("id").agg(F.collect_set("term").alias("terms"))
        named = now.select("id", "gone").join(terms, "id", "left").select("id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), "gone")
        self.forward.apply(named, batch, F.col("gone"))

    def search(self, text: str, phrase: bool = False) -> DataFrame:
        """The ids that hold all terms of a text; only the partitions of its terms are read.  phrase: in its order, side by side."""
        wanted = [(s["term"], s["position"]) for s in self.spark.range(1).select(lexemes(F.lit(text)).alias("l")).first()["l"]]
        distinct = sorted({t for t, _ in wanted})
        none = self.spark.createDataFrame([], "id bigint")
        if not distinct:
            return none
        parts = [r[0] for r in self.spark.createDataFrame([(t,) for t in distinct], "term string").select(self.postings.part_of("term")).collect()]
        found = self.postings.read(parts=parts).where(F.col("term").isin(distinct))
        by_id = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at")).where(F.col("n") == len(distinct))
        if phrase:
            shifted = lambda t, off: F.transform(F.col("at")[F.lit(t)], lambda p: p - off)
            starts = [shifted(t, off) for t, off in wanted]
            common = starts[0]
            for s in starts[1:]:
                common = F.array_intersect(common, s)
            by_id = by_id.where(F.size(common) > 0)
        return by_id.select("id")
