import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import mixing, queries, toxicity

INSULTS = ["grob", "fiend", "wretch", "rattbag"]


def corpus(spark, n=1200):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 7))) for _ in range(rng.randint(20, 80))] + ["the", "and", "of"]
        toxic = rng.random() < 0.25
        for _ in range(rng.randint(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS).capitalize() + rng.choice(["", ",", "!!"]))
        rows.append((i, " ".join(words), "en", f"src{i % 4}", 0, 1.5))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels, truth = corpus(spark)
    model = toxicity.fit(docs, labels)
    scored = toxicity.score_column(docs.drop("score"), model).select("doc_id", "score", toxicity.held_out("doc_id").alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in scored)
    held = [r for r in scored if r.out]
    assert sum((r.score >= 0.5) == (truth[r.doc_id] == 1) for r in held) / len(held) > 0.95
    again = toxicity.fit(docs.repartition(7), labels.unionByName(labels))
    assert np.array_equal(model.out, again.out) and model.shift == again.shift
    odd = ["", None, " ", "grob", "x", "word " * 60_000 + "wretch fiend grob", "word " * 60_000]
    s = toxicity.scores(model, odd)
    assert np.isfinite(s).all() and s[5] >= 0.5 > s[6] and s[0] == s[1] == s[2]
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and 0.6 * 1200 < kept.count() < 0.85 * 1200
    assert toxicity.reject(docs.where("false"), labels).count() == 0


def test_labels_of_one_class_or_none(spark):
    docs = spark.createDataFrame([(i, "some words") for i in range(20)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 0) for i in range(20)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.fit(docs, marks).constant == 0 and toxicity.fit(docs, marks.where("false")).constant == 0
    assert toxicity.reject(docs, marks).count() == 20


def test_parts_of_long_texts_are_pooled(monkeypatch):
    model = toxicity.new_model(seed=3)
    texts = toxicity.word_ids([" ".join(f"w{i * k % 97}" for i in range(500)) for k in range(1, 6)] + [""])
    whole = toxicity.logits(model, model.tables(), texts)
    monkeypatch.setattr(toxicity, "PART", 37)
    assert np.allclose(whole, toxicity.logits(model, model.tables(), texts), atol=1e-5)


def test_languages():
    said = ["the cat and the dog", "der Hund und die Katze", "le chien et la table des amis", "el perro y los gatos", "zzz"]
    assert [toxicity.LANGUAGES[toxicity.language(i)] for i in toxicity.word_ids(said)] == ["en", "de", "fr", "es", ""]


def test_pipeline_stages_follow_brute_force(spark, tmp_path):
    import corpus_pipeline as pipeline
    from test_text_dedup import brute_lines

    rng = random.Random(9)
    docs, labels, truth = corpus(spark, 600)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    long_line = "this very line is in very many of the documents and goes after the first"
    rows = [(i, t.replace(" ", "\n", 3) + (f"\n{long_line}" if i % 3 == 0 else "")) for i, t in rows]
    rows += [(600 + i, rows[i][1]) for i in range(30)]
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows += [(700 + i, " ".join([*base[:100], f"edit{i}", *base[101:]])) for i in range(5)]
    table = spark.createDataFrame([(i, t, "en", f"src{i % 4}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    steps, at = {}, read
    for name, stage in pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(str(tmp_path / name.replace(" ", "-")))
        at = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        steps[name] = at
    assert list(steps) == ["toxicity", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing"]
    assert all(df.columns == read.columns for df in list(steps.values())[:-1])
    clean = {r.doc_id for r in steps["toxicity"].collect()}
    known = [i for i in truth if i in truth]
    assert sum((i in clean) == (truth[i] == 0) for i in known) / len(known) > 0.95
    want = brute_lines([r for r in rows if r[0] in clean], 4, 20)
    lines = {r.doc_id: r for r in steps["line dedup"].collect()}
    assert {i: r.text for i, r in lines.items()} == {i: w[2] for i, w in want.items()} and all(r.n_chars == len(r.text) for r in lines.values())
    kept = {r.doc_id: r.text for r in steps["SimHash near-dedup"].collect()}
    near = [i for i in range(700, 705) if i in clean]
    assert [i for i in near if i in kept] == near[:1]
    emptied = [i for i in sorted(clean) if not lines[i].text]
    assert [i for i in emptied if i in kept] == emptied[:1]
    assert set(lines) - set(kept) == set(near[1:]) | set(emptied[1:])
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(steps["SimHash near-dedup"]).collect()}
    mixed = {r.doc_id: r["count"] for r in steps["mixing sources to target weights"].groupBy("doc_id").count().collect()}
    assert mixed == {i: c for i, c in copies.items() if c}
    packed = steps["best-fit packing"]
    assert packed.where("piece = 0").count() == sum(mixed.values()) and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert pipeline.run(spark, str(tmp_path)).count() == packed.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    import duckdb

    from pathlib import Path

    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    got = queries.QUERIES[name](spark, str(data))
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_stages_leave_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs, labels, _ = corpus(spark, 300)
    names = ["mix_source", "_copy", "_gone", "_lines", "_toxicity", "size", "Copies", "n_removed", "component_id", "_key"]
    docs = docs.select("doc_id", "text", "source", "n_chars", *[F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in names])
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in names)
    assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).where("piece = 0").count() == 300


def test_each_language_has_a_threshold(monkeypatch):
    rng = np.random.default_rng(4)
    spoken = np.array([0] * 60 + [1] * 40 + [2] * 30 + [3] * 5)
    labels = np.array(([0, 1] * 100)[:130] + [0] * 5)
    scores = labels * 2.0 + spoken * 1.5 + rng.normal(size=len(labels)) * 0.1
    monkeypatch.setattr(toxicity, "logits", lambda model, tables, texts: scores)
    monkeypatch.setattr(toxicity, "language", lambda text: int(text[0]))
    model = toxicity.calibrate(toxicity.new_model(), [[s] for s in spoken], labels, weight=10)
    every = toxicity._threshold(scores, labels)
    for i, n in ((0, 30), (1, 20), (2, 15)):
        own = toxicity._threshold(scores[spoken == i], labels[spoken == i])
        assert abs(own - (1 + 1.5 * i)) < 0.5 and model.shift[i] == pytest.approx((n * own + 10 * every) / (n + 10))
    assert model.shift[3] == every  # no row of one of its classes
