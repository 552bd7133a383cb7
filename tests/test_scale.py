"""What keeps the work in proportion to the input: each test fails with the forms before."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textloom.functions import html, text
from textloom.operators import dedup, encoder, lexicon, segment, vectors


def test_texts_without_the_letters_of_the_lexicon_are_not_matched(spark):
    lex = lexicon.Lexicon()
    texts = ["plain words in 1937", "Élan sans rien 1948", "СТАЛИН и гулаг, 1937", "ᲃталин", "сталинград", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    assert [r["m"] for r in rows.select("i", lex.may_match(F.col("text")).alias("m")).orderBy("i").collect()] == [False, False, True, True, True, False, None]
    got = {r["i"]: r for r in lexicon.score_segments(rows).collect()}
    assert [got[i]["n_stalin"] for i in range(7)] == [0, 0, 1, 1, 0, 0, None]
    assert [got[i]["key_years"] for i in range(7)] == [["1937"], ["1948"], ["1937"], [], [], [], None]


def test_patterns_of_a_letter_keep_their_order(spark):
    """A lexicon whose patterns overlap, and one that can't be gated, against Python's re."""
    own = {"a": [r"\bкот", r"\bкоты\w*", r"\bпёс|\bлис"], "b": ["кот", r"ко\w+", "дом"], "stalin": [r"\d+", "дом"]}
    lex = lexicon.Lexicon(patterns=own, weights=dict.fromkeys(own, 1), strong=["a"], ranked=["a", "b"])
    texts = ["Коты и кот, домкот. ПЁС лис", "12 ДОМ коллаж", "none 5"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    assert lex.may_match(F.col("text")) is None and lex.initials("b") == "дк" and not lex.initials("a")
    got = rows.select("i", *(F.regexp_count("text", F.lit(lex.pattern(c))).alias(c) for c in own)).orderBy("i").collect()
    for r, t in zip(got, texts):
        assert [r[c] for c in own] == [len(re.findall("|".join(f"(?:{p})" for p in own[c]), t, re.I)) for c in own]


def test_words_of_a_segment_are_counted_once(spark):
    docs = spark.createDataFrame([(1, "word " * 30)], "doc_id int, text string")
    plan = segment.segments(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("regexp" in line.lower() for line in plan.splitlines() if "Filter (" in line)


def test_early_rows_decide_the_same(spark, monkeypatch):
    """Many alike rows, with the first ones decided first and with all at once; and what is shuffled isn't the sets."""
    texts = [f"{'общий текст всех строк, длинный и одинаковый ' * 3}{chr(1072 + i % 30) * (i % 7)} хвост {i % 40}" for i in range(150)]
    rows = spark.createDataFrame([("p" if i % 3 else "q", i, t) for i, t in enumerate(texts)], "period string, seq bigint, text string")
    want = {tuple(r) for r in dedup.fuzzy_matches(rows, "seq").collect()}
    monkeypatch.setattr(dedup, "EARLY", 10)
    monkeypatch.setattr(dedup, "SHARE", 4)
    monkeypatch.setattr(dedup, "BLOCK", 20)
    assert len(want) > 50 and {tuple(r) for r in dedup.fuzzy_matches(rows, "seq").collect()} == want


def test_pairs_of_copies_are_pairs(spark):
    rows = spark.createDataFrame([(1, "Один длинный текст"), (2, "один, длинный текст!"), (3, "Один длинный текст."), (4, "другое содержание"), (5, "мало"), (6, "мало"), (7, None)], "seq bigint, text string").withColumn("period", F.lit("p"))
    assert sorted((r["a"], r["b"], r["similarity"]) for r in dedup.pairs_with_copies(rows, "seq").collect()) == [(1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0)]


def peak(run) -> float:
    """MB that Python allocates at most meanwhile."""
    import tracemalloc

    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def test_python_holds_slices_of_a_batch():
    """The functions behind the Arrow columns, run here over one large batch."""
    texts = pa.array(["<p>" + "wort und text " * 40 + "</p>"] * 5000)
    assert peak(lambda: html.html_batch(texts)) < 12
    assert peak(lambda: encoder.encode_batch(pa.array(["ein text"] * 5000), encoder.HashingEncoder(64))) < 6


def test_neighbours_with_ties_over_slices(spark, monkeypatch):
    monkeypatch.setattr(vectors, "NEAR_ROWS", 3)
    points = [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]] * 8
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "vec_id bigint, embedding array<double>").repartition(2)
    got = vectors.knn_cosine(rows.where("vec_id < 3"), rows, 4).orderBy("query_id", "place").collect()
    assert [r["id"] for r in got] == [3, 6, 9, 12, 4, 7, 10, 13, 5, 8, 11, 14]


def test_large_groups_are_clustered_by_all_tasks(spark, monkeypatch):
    """The same clusters from distances that are dealt over tasks; 50,000 vectors were the limit of a group before."""
    r = np.random.default_rng(1)
    points = np.vstack([r.normal(c, 0.3, (60, 5)) for c in (0, 2, 4, 9)] + [r.uniform(-9, 9, (60, 5)), np.ones((15, 5))])
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id bigint, embedding array<double>")
    for options in ({}, {"metric": "manhattan"}):
        want = {x["id"]: (x["cluster"], round(x["probability"], 9)) for x in vectors.hdbscan_labels(rows, **options).collect()}
        with monkeypatch.context() as m:
            m.setattr(vectors, "HDBSCAN_LOCAL", 155)
            m.setattr(vectors, "HDBSCAN_ROWS", 32)
            m.setattr(vectors, "HDBSCAN_TILE", 50)
            m.setattr(vectors, "hdbscan", None)
            got = {x["id"]: (x["cluster"], round(x["probability"], 9)) for x in vectors.hdbscan_labels(rows, **options).collect()}
        assert got == want and len({c for c, _ in got.values()}) > 3


def test_has_words_is_a_count_of_words(spark):
    texts = ["", "a", "a b", "a-b  c", "one, two; three four", "ё1 Ё2", "- - -", "abc" * 50, None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for least in (1, 2, 3, 4):
        assert all(r[0] == r[1] for r in rows.select(text.has_words(F.col("text"), least), text.count_words(F.col("text")) >= least).collect())
