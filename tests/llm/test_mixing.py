import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.llm import mixing as mx

WORDS = {"alpha": "river stone bridge water", "beta": "quantum photon lattice spin", "gamma": "fugue sonata chord tempo"}


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        name = list(WORDS)[i % 3]
        text = " ".join(rng.choice(WORDS[name].split(), 20 + i % 30))
        given = {0: f" {name.upper()} ", 1: name.title(), 2: None}.get(i % 10, name)
        rows.append((i, text, given, name, 1.0))
    rows += [(1000, None, "alpha", "alpha", 1.0), (1001, "", "alpha", "alpha", 1.0), (1002, "river", "elsewhere", "alpha", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, truth string, cap double").cache()


def test_shares_meet_the_targets(docs):
    targets = [mx.Target("alpha", 0.5, 3), mx.Target("Beta", 0.2, 1), mx.Target("gamma", 0.3, 1), mx.Target("none", 0.0, 1)]
    mixed = mx.mix(docs, targets)
    chosen, shares = mixed.chosen, mixed.shares
    by = {r["source"]: r for r in shares.collect()}
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert by["alpha"]["reached_tokens"] == pytest.approx(0.5 * total, rel=0.02) and by["alpha"]["most_repeats"] <= 3
    assert by["Beta"]["reached_tokens"] == pytest.approx(0.2 * total, rel=0.02) and not by["Beta"]["short"]
    assert by["gamma"]["short"] == (by["gamma"]["available_tokens"] < 0.3 * total)
    assert by["none"]["reached_tokens"] == 0
    rows = chosen.join(docs.select("doc_id", "text", F.lower(F.trim("source")).alias("s")), "doc_id").collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and all(r["repeats"] >= 1 for r in rows)
    assert all(r["source"].lower() == r["s"] and r["n_tokens"] == len(r["text"]) for r in rows)
    for name, r in by.items():
        assert sum(x["repeats"] * x["n_tokens"] for x in rows if x["source"] == name) == r["reached_tokens"]


def test_short_sources_are_used_up_to_the_cap(docs):
    shares = mx.mix(docs, [mx.Target("alpha", 0.9, 2), mx.Target("beta", 0.1, 5)]).shares
    by = {r["source"]: r for r in shares.collect()}
    assert by["alpha"]["short"] and by["alpha"]["reached_tokens"] == 2 * by["alpha"]["available_tokens"]
    assert not by["beta"]["short"]


def test_unlabelled_documents_go_to_their_source(docs):
    chosen = mx.mix(docs, [mx.Target(n, 1 / 3, 9) for n in WORDS], admit_unlabelled=True).chosen
    extra = chosen.join(docs.where("source IS NULL").select("doc_id", "truth"), "doc_id").collect()
    assert len(extra) > 20 and np.mean([r["source"] == r["truth"] for r in extra]) > 0.95


def test_held_out_recall(docs):
    for r in mx.mix(docs, [mx.Target(n, 1 / 3, 1) for n in WORDS]).recall.collect():
        assert r["recall"] > 0.95 and r["n_right"] <= r["n_docs"]


def test_titles_tell_what_texts_do_not(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["one", "two", "three"], 30)), f"page {i % 40}", ["alpha", "beta"][i % 40 // 20]) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, title string, source string")
    targets = [mx.Target("alpha", 0.5, 1), mx.Target("beta", 0.5, 1)]
    assert all(r["recall"] > 0.95 for r in mx.mix(docs, targets).recall.collect())
    assert all(r["recall"] < 0.75 for r in mx.mix(docs.drop("title"), targets).recall.collect())


def classes_of(spark, rows):
    return spark.createDataFrame(rows, "s int, m array<double>, cap double, tokens double")


def test_rates_solve_the_least_squares(spark):
    classes = classes_of(spark, [(0, [1.0, 0.0], 1.0, 100.0), (1, [0.0, 1.0], 4.0, 50.0), (1, [0.5, 0.5], 2.0, 80.0)])
    fit = mx.fit_rates(classes, np.array([90.0, 110.0]))
    r = [x[0] for x in classes.select(fit.rate()).collect()]
    assert 0 <= min(r) and r[0] <= 1 and r[1] <= 4 and r[2] <= 2 and not fit.capped
    assert 100 * r[0] + 40 * r[2] == pytest.approx(90, rel=1e-5) and 50 * r[1] + 40 * r[2] == pytest.approx(110, rel=1e-5)


def test_what_cannot_be_reached_does_not_pull(spark):
    rows = [(0, [0.98, 0.01, 0.01], 1.0, 100.0), (1, [0.02, 0.97, 0.01], 2.0, 50.0)]
    fit = mx.fit_rates(classes_of(spark, rows), np.array([60.0, 500.0, 300.0]))  # the last has no documents
    assert sorted(fit.capped) == [1, 2] and fit.used[1] == 1 and fit.expected[0] == pytest.approx(60, rel=1e-5)
    none = mx.fit_rates(classes_of(spark, rows), np.zeros(3))
    assert none.expected.tolist() == [0, 0, 0] and none.used[0] == 0


def test_short_depends_on_the_fit(docs, monkeypatch):
    targets = [mx.Target("alpha", 0.9, 2), mx.Target("beta", 0.1, 5)]
    monkeypatch.setattr(mx, "fit_rates", lambda c, t, **_: mx.Fit([], [], np.zeros(2), np.zeros(2)))
    assert not any(r["short"] for r in mx.mix(docs, targets).shares.collect())


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    mixed = mx.mix(none, [mx.Target("alpha", 1.0, 2)])
    assert mixed.chosen.count() == 0 and mixed.shares.first()["reached_tokens"] == 0 and mixed.recall.count() == 0
    assert mx.mix(none, []).shares.count() == 0


def test_null_features_and_repeated_rows(spark):
    rows = [(1, "river", None, "alpha", "x"), (1, "river", None, "alpha", "x"), (None, "stone", "t", None, None), (3, "bridge", "t", "beta", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, title string, source string, s string")  # a clashing name
    mixed = mx.mix(docs, [mx.Target("alpha", 0.4, 1), mx.Target("beta", 0.2, 1)])
    by = {r["source"]: r for r in mixed.shares.collect()}
    assert by["alpha"]["n_docs"] == 2 and by["beta"]["n_docs"] == 1
