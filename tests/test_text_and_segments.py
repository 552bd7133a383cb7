"""Exact-semantics rules of normalization, splitting, packing and scoring, against hand-made cases and plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import html, text
from textloom.operators import lexicon, segment


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expression(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


@pytest.mark.parametrize(
    "given,want",
    [
        ("a\r\nb\rc", "a b c"),
        ("a b​c\fd", "a bc\n\nd"),
        ("‐‑‒–—―", "------"),
        ("строка\n12\nстрока", "строка\n\nстрока"),
        ("строка\n- 7 -\nстрока", "строка\n\nстрока"),
        ("строка\n1937\nстрока", "строка\n\nстрока"),
        ("см. Стр. 45 и стр 7.", "см.  и .".replace("  ", " ")),
        ("а [1] б [см. 5] в [1-3, 4; 5] г [1937] д [1, 2-3]", "а б в г [1937] д [1, 2-3]"),
        ("индустриа-\nлизация", "индустриализация"),
        ("one\ntwo\n\nthree\n\n\n\nfour", "one two\n\nthree\n\nfour"),
        ("one\n \ntwo", "one two"),
        ("  x  ", "x"),
        ("", ""),
    ],
)
def test_normalize(spark, given, want):
    assert column(spark, [given], text.normalize) == [want]


def test_repair_needs_few_breaks_and_length(spark):
    long = "Слово." * 2000 + "Конец г.Москва § 5"
    got = column(spark, [long, "Слово.Слово", "x\n" * 30 + long], text.repair_breaks)
    assert got[0].count("\n\n") == 2001 and "г.Москва" in got[0] and "\n\n§ 5" in got[0]
    assert got[1] == "Слово.Слово" and "\n\n" not in got[2]


def test_scalars(spark):
    assert column(spark, ["über die", "Ёж ёлка 12", ""], text.count_words) == [2, 3, 0]
    assert column(spark, [" a b\x1fc "], text.count_tokens) == [3]
    assert column(spark, ["  Ёж,  И_ель!² "], text.comparison_form) == ["еж и_ель ²"]
    assert column(spark, ["abcabc", "ab", "", "a😀bc"], lambda c: F.array_sort(text.ngrams(c))) == [["abc", "bca", "cab"], ["ab"], [], ["a😀b", "😀bc"]]
    assert column(spark, ["abcdef", "abc"], lambda c: text.truncate(c, 3)) == ["abc...", "abc"]
    assert column(spark, ["СССР", "Россия", "Франция", None], text.country_name) == ["URSS", "Russie", "Франция", None]
    assert column(spark, ["", "x", "7"], lambda c: text.first_int(c, F.lit("1980"))) == [1980, None, 7]
    assert column(spark, ["ab"], lambda c: text.jaccard(F.array(c, F.lit("x")), F.array(c))) == [0.5]


def test_paragraph_limits(spark):
    got = column(spark, ["a b c d e f g\n\n1 2 3 4 5 6 7 8\n \n x1 x2 x3 x4 x5 x6 x7 x8 x9 ", ""], segment.paragraphs)
    assert got == [["1 2 3 4 5 6 7 8", "x1 x2 x3 x4 x5 x6 x7 x8 x9"], []]


def test_sentences(spark):
    cases = {
        "Да. Нет! Что? Так… далее.": ["Да.", "Нет!", "Что?", "Так… далее."],
        'Он сказал «да.» И ушёл (совсем.) Вот "так!" И.': ["Он сказал «да.»", "И ушёл (совсем.)", 'Вот "так!"', "И."],
        "В 1953 Г. умер. И т.д. и т.п. Конец": ["В 1953 г. умер.", "И т.д. и т.п. Конец"],
        "Это друг. Потом": ["Это друг. Потом"],
        "Проф. Иванов и акад. Петров. Вот Кузьмин. Всё": ["проф. Иванов и акад. Петров. Вот Кузьмин.", "Всё"],
    }
    assert column(spark, list(cases), segment.sentences) == list(cases.values())


def plain_pack(sents):
    done, now, size = [], [], 0
    for s in sents:
        if (size + len(s) > 1500 and len(now) >= 2) or len(now) >= 5:
            done.append((" ".join(now), len(now)))
            now, size = [s], len(s)
        else:
            now.append(s)
            size += len(s) + 1
    if len(now) == 1 and done and done[-1][1] < 5:
        done[-1] = (f"{done[-1][0]} {now[0]}", done[-1][1] + 1)
    elif now:
        done.append((" ".join(now), len(now)))
    return done


def test_packing_against_plain(spark):
    r = random.Random(4)
    cases = [["s" * r.choice([3, 200, 499, 500, 748, 749, 750, 900, 1600]) for _ in range(r.randint(1, 16))] for _ in range(150)]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s array<string>").select("i", segment.pack_sentences(F.col("s")).alias("p")).collect()
    for row in rows:
        got = [(p["text"], p["n"]) for p in row["p"]]
        assert got == plain_pack(cases[row["i"]]) and all(n <= 5 for _, n in got)


def test_segments_have_gaps_and_limits(spark):
    sents = [f"Предложение номер {i} из ровно шести." for i in range(6)]
    docs = spark.createDataFrame([("p", "d", " ".join(sents)), ("p", "e", "x " * 14), ("p", "f", "x " * 15), ("p", "g", None)], "period string, doc_id string, text string")
    got = {r["doc_id"]: r for r in segment.segments(docs).collect()}
    assert set(got) == {"d", "f"} and got["d"]["sentence_count"] == 5 and got["d"]["segment_idx"] == 0
    stats = {r["period"]: r["n_segments"] for r in segment.segmentation_stats(segment.segments(docs)).collect()}
    assert stats == {"p": 2, None: 2}


def score(spark, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    return sorted(lexicon.score_segments(rows, all_years=True).collect(), key=lambda r: r["i"])


def test_lexicon(spark):
    cases = [
        ("Сталинград и сталинградский", 0, None),
        ("Сталин", 3, "stalin_direct"),
        ("Коба в 1937 и 1938", 1, None),
        ("голодомор", 1, None),
        ("голодомор 1932", 2 + 1 - 1, "strong_events"),
        ("репрессии, бухарин и рыков", 4, "strong_trials"),
        ("репрессии и культ личности", 4, "strong_mixed"),
        ("гулаг 1929 1930 1932 1933 1934", 5, "strong_repression"),
        ("гулаг в 19370 году", 2, "strong_repression"),
        ("расстрёлы 1937г, 1937-м", 3, "strong_repression"),
        ("арестован был тогда 1937", 3, "strong_repression"),
    ]
    for (given, want, reason), row in zip(cases, score(spark, [c[0] for c in cases])):
        assert (row["score"], row["reason"]) == (want, reason), given


def test_lexicon_counts_against_re(spark):
    r = random.Random(8)
    bits = ["сталин", "Сталинград", "сталина", "культ личности", "врагов народа", "ГУЛАГа", "нквд", "нквдэ", "московский процесс", "дело врачей", "берия", "либерия", "арестованы в мае 1938", "1941 год", "ударники", "первая  пятилетка", "и", "тройка", "тройкам"]
    cases = [" ".join(r.choice(bits) for _ in range(12)) for _ in range(60)]
    lex = lexicon.Lexicon()
    patterns = {c: re.compile("|".join(f"(?:{p})" for p in v), re.I) for c, v in lex.patterns.items()}
    for given, row in zip(cases, score(spark, cases)):
        for c, p in patterns.items():
            assert row[f"n_{c}"] == len(p.findall(given)), (c, given)


def test_html():
    page = "<html><nav><p>menu</p></nav><p> One <b>two</b> three</p><script>var x='</p>';</script><p></p><p>outer<p>inner</p><br>tail"
    assert html.paragraphs(page) == ["Onetwothree", "outerinnertail", "inner"]
    assert html.paragraphs(None) == [] and html.paragraphs("no paragraphs &amp; so") == []


def test_streaming_scores(spark, tmp_path):
    from textloom.streaming.pretreatment import retention_counts, score_stream

    rows = spark.createDataFrame([("p", "d", "Сталин и " + "слово " * 20), ("q", "e", "слово " * 20)], "period string, doc_id string, text string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = retention_counts(score_stream(stream)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("counts").collect()} == {("p", 1, 1), ("q", 1, 0)}
