"""Paragraphs, sentences and sentence-packed segments, in one narrow plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import SPACE, any_case, bind, count_words, has_words, strip

#: Limits, and abbreviations whose full stops end no sentence, in the order of their protection.
MAX_CHARS = 1500
MIN_SEGMENT_WORDS = 15
MAX_SENTENCES = 5
MIN_PARAGRAPH_WORDS = 8
ABBREVIATIONS = [
    "млрд.", "проч.", "напр.", "акад.", "проф.",
    "т.д.", "т.п.", "т.е.", "т.н.", "т.к.", "тыс.", "млн.", "руб.", "чел.",
    "гг.", "вв.", "др.", "см.", "ср.", "ок.", "им.",
    "г.", "в.",
]
#: Stands for the full stop of an abbreviation while a text is split.
GUARD = "\x03"


def paragraphs(c: Column) -> Column:
    """Blocks between blank lines with at least MIN_PARAGRAPH_WORDS words."""
    blocks = F.transform(F.split(c, rf"\n{SPACE}*\n", -1), strip)
    return F.filter(blocks, lambda p: has_words(p, MIN_PARAGRAPH_WORDS))


#: Any of them: most texts of some languages have none and are left alone after one search.
ANY_ABBREVIATION = f"(?=[{any_case(''.join(sorted({a[0] for a in ABBREVIATIONS})))}])(?iu)(?:{'|'.join(a.replace('.', chr(92) + '.') for a in ABBREVIATIONS)})"


def guard_abbreviations(c: Column) -> Column:
    def guard(text: Column, abbreviation: str) -> Column:
        return F.regexp_replace(text, f"(?=[{any_case(abbreviation[0])}])(?iu)" + abbreviation.replace(".", r"\."), abbreviation.replace(".", GUARD))

    def guarded(text: Column) -> Column:
        # A text of as many bytes as characters is ASCII, and no abbreviation is.
        return F.when((F.octet_length(text) > F.length(text)) & text.rlike(ANY_ABBREVIATION), reduce(guard, ABBREVIATIONS, text)).otherwise(text)

    return bind(c, guarded)


def sentences(c: Column) -> Column:
    """Split behind . ! ? and one closing mark; abbreviations come back in lower case."""
    parts = F.split(guard_abbreviations(c), rf'(?={SPACE})(?:(?<=[.!?])|(?<=[.!?][»")\]])){SPACE}+', -1)
    return F.filter(F.transform(parts, lambda s: strip(F.replace(s, F.lit(GUARD), F.lit(".")))), lambda s: s != "")


SEGMENT = "struct<text:string,n:int>"


def pack_sentences(sents: Column, max_chars: int = MAX_CHARS) -> Column:
    """array<struct<text, n>> by a fold over the sentences.

    A segment is closed before a sentence that would take it past max_chars if it has two sentences, and at
    MAX_SENTENCES in any case. A sentence counts one more character than it has, but not as the first of a segment
    behind a closed one. A single last sentence joins the segment before it while that has room.
    """
    # The fold sees lengths only: starts of the segments, sentences and characters of the open one, and the place.
    none = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(0).alias("at"))

    def step(state: Column, length: Column) -> Column:
        full = ((state["size"] + length > max_chars) & (state["n"] >= 2)) | (state["n"] >= MAX_SENTENCES)
        return F.struct(
            F.when(full, F.concat(state["starts"], F.array(state["at"]))).otherwise(state["starts"]).alias("starts"),
            F.when(full, 1).otherwise(state["n"] + 1).alias("n"),
            F.when(full, length).otherwise(state["size"] + length + 1).alias("size"),
            (state["at"] + 1).alias("at"),
        )

    def finish(state: Column) -> Column:
        starts, n = state["starts"], F.size(state["starts"])
        merge = (state["n"] == 1) & (n > 1) & (F.get(starts, n - 1) - F.get(starts, n - 2) < MAX_SENTENCES)
        return F.when(merge, F.slice(starts, F.lit(1), n - 1)).otherwise(starts)

    def segments_at(starts: Column) -> Column:
        def segment(start: Column, i: Column) -> Column:
            n = F.coalesce(F.get(starts, i + 1), F.size(sents)) - start
            return F.struct(F.array_join(F.slice(sents, start + 1, n), " ").alias("text"), n.alias("n"))

        return F.transform(starts, segment)

    found = bind(F.aggregate(F.transform(sents, F.length), none, step, finish), segments_at)
    return F.when(F.size(sents) > 0, found).otherwise(F.array().cast(f"array<{SEGMENT}>"))


def paragraph_segments(paragraph: Column, sents: Column, max_chars: int = MAX_CHARS) -> Column:
    n = F.size(sents)
    whole = F.array(F.struct(paragraph.alias("text"), n.alias("n")))
    short = ((F.length(paragraph) <= max_chars) & (n <= MAX_SENTENCES)) | (n <= 2)
    return F.when(short, whole).otherwise(pack_sentences(sents, max_chars))


def explode_paragraphs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per paragraph: paragraph_idx counts those that are kept."""
    rest = [c for c in docs.columns if c != text_col]
    return docs.select(*rest, F.posexplode(paragraphs(F.col(text_col))).alias("paragraph_idx", "paragraph"))


def segments(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per segment of at least MIN_SEGMENT_WORDS words; segment_idx counts all of a paragraph's, so it may have gaps."""
    found = explode_paragraphs(docs, text_col).withColumn("sents", sentences(F.col("paragraph")))
    rest = [c for c in docs.columns if c != text_col]
    # The words are counted here, once: a filter on a column of counts would count them again.
    every = F.transform(
        paragraph_segments(F.col("paragraph"), F.col("sents")),
        lambda s, i: F.struct(i.alias("segment_idx"), s["text"].alias("text"), F.length(s["text"]).alias("char_count"), count_words(s["text"]).alias("word_count"), s["n"].alias("sentence_count")),
    )
    return found.select(*rest, "paragraph_idx", F.inline(F.filter(every, lambda s: s["word_count"] >= MIN_SEGMENT_WORDS)))


def segmentation_stats(segs: DataFrame) -> DataFrame:
    """Per period and, with a null period, in all; periods without segments don't show."""
    return segs.rollup("period").agg(
        F.count("*").alias("n_segments"),
        F.sum("char_count").alias("n_chars"),
        F.sum("word_count").alias("n_words"),
        F.avg("word_count").alias("avg_words"),
    )
