"""The runner with its exit codes, the reports it writes, and explained variance."""

import numpy as np

from textloom.__main__ import NO_METADATA, NO_SEGMENTS, NOTHING_RETAINED, main
from textloom.operators import vectors

KEPT = "Сталин и НКВД начали репрессии в 1937 году, и об этом в книге сказано так много слов, что это отдельный сегмент номер {}. "
PLAIN = "Обычный текст без всяких признаков темы, в нём просто достаточно слов, чтобы стать отдельным сегментом после деления в 1991 году. "


def corpus(tmp_path, texts):
    for period, name, text in texts:
        (tmp_path / "corpus" / period).mkdir(parents=True, exist_ok=True)
        (tmp_path / "corpus" / period / f"{name}.txt").write_text(text, encoding="utf-8")
    return tmp_path / "corpus"


def test_runner(spark, tmp_path):
    folder = corpus(tmp_path, [("p1", "a", KEPT.format(1) + "\n\n" + PLAIN), ("p1", "b", KEPT.format(1)), ("p2", "c", KEPT.format(1))])
    out = tmp_path / "out"
    assert main([str(folder), str(out)]) == NO_METADATA
    (folder / "metadata.csv").write_text("idx,doc_id,pays,annee,niveau,auteur,titre\n1,a,СССР,1980,9,x,y\n", encoding="utf-8")
    assert main([str(folder), str(out), "--all-years"]) == 0
    kept = spark.read.parquet(f"{out}/04_dedup/segments")
    assert sorted((r["period"], r["doc_id"], r["year"]) for r in kept.select("period", "doc_id", "year").collect()) == [("p1", "a", 1980), ("p2", "c", None)]
    report = spark.read.json(f"{out}/03_filtered/quality_report")
    assert {r["section"]: r["count"] for r in report.groupBy("section").count().collect()} == {"top_scoring": 3, "random_retained": 3, "random_rejected": 1}
    assert [tuple(r) for r in spark.read.json(f"{out}/03_filtered/years_rejected").select("place", "year", "n").collect()] == [(1, "1991", 1)]
    pairs = spark.read.json(f"{out}/04_dedup/duplicate_report").collect()
    assert [(r["section"], r["place"], r["similarity"], r["removed_text"] == r["kept_text"]) for r in pairs] == [("exact", 1, 1.0, True)]


def test_runner_says_what_is_missing(spark, tmp_path):
    for text, code in (("мало слов", NO_SEGMENTS), (PLAIN, NOTHING_RETAINED)):
        folder = corpus(tmp_path / str(code), [("p", "a", text)])
        (folder / "metadata.csv").write_text("doc_id,annee\na,1980\n", encoding="utf-8")
        assert main([str(folder), str(tmp_path / f"out{code}")]) == code


def test_explained_variance(spark):
    m = np.random.default_rng(3).normal(size=(200, 6)) * [5, 3, 1, 1, 0.5, 0.1]
    rows = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(m)], "vec_id bigint, embedding array<double>")
    values = np.linalg.eigvalsh(np.cov(m.T, bias=True))[::-1]
    assert abs(vectors.pca_project(rows, 2, explained=True)[1] - values[:2].sum() / values.sum()) < 1e-9
