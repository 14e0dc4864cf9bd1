"""The pipeline, stage by stage, and the registered queries."""

import pathlib

import corpus_pipeline
import duckdb
import pytest
from spindrift.llm import quality_rules, registry
from test_operators import brute_components, brute_counts, brute_hits, brute_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = corpus_pipeline.settle(stage(spark, docs, SF), name)
        assert new.columns == docs.columns and new.dtypes == docs.dtypes, name
        ids = {r[0] for r in new.select("doc_id").collect()}
        assert before is None or ids <= before
        before, docs = ids, new
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == before and len(before) > 100


def test_registry():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES if k.startswith("op")) == list(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_against_sql(spark, name):
    own, db = registry.QUERIES[name](spark, SF), duckdb.connect()
    for path in pathlib.Path(SF).glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    columns = sorted(own.columns)
    want = db.execute(f"select {', '.join(columns)} from ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, own.select(*columns).collect())) == sorted(want)


def brute_kept(text, rules):
    """The base rule and a learned list, on counts made in Python."""
    n_words, word_chars, symbols, dup_lines, repeat_words = brute_counts(text)
    words = [w for w in (text or "").translate(str.maketrans("\t\n\x0b\f\r", "     ")).split(" ") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\f\r")]
    same = sum(a == b for a, b in zip(words, words[1:]))
    value = {"words": n_words, "word_length": word_chars / max(n_words, 1), "symbols": symbols / max(n_words, 1), "repeated_lines": dup_lines / max(len(lines), 1), "repeated_words": repeat_words / max(n_words, 1), "same_next": same / max(n_words, 1)}
    fired = any(all((value[c.feature] > c.threshold) == c.above for c in r.conditions) for r in rules.rules)
    return n_words >= 20 and 100 * repeat_words <= 30 * n_words and not fired


def test_stages_against_brute_force(spark):
    """Which documents each stage keeps, and their texts; the learned rules are taken as they are."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    settings = quality_rules.Settings()
    rules = quality_rules.learn(quality_rules.labelled_counts(docs, labels, settings), settings)
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    text = lambda: [(i, r["text"]) for i, r in sorted(rows.items())]

    def quality():
        return {i: t for i, t in text() if brute_kept(t, rules)}

    def lines():
        return {i: t for i, _, _, t in brute_lines(text())}

    def near():
        first = {i for i, _, c in brute_components(text(), 5, 80) if i == c}
        return {i: t for i, t in text() if i in first}

    def benchmark():
        clean = {i for i, _, _, found in brute_hits(text(), items) if not found}
        return {i: t for i, t in text() if i in clean}

    removed = []
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (quality, lines, near, benchmark)):
        docs, want = corpus_pipeline.settle(stage(spark, docs, SF), name), brute()
        got = [r.asDict() for r in docs.collect()]
        assert sorted(r["doc_id"] for r in got) == sorted(want), name
        for r in got:
            assert r == {**rows[r["doc_id"]], "text": want[r["doc_id"]], "n_chars": r["n_chars"]}, name
            assert name != "line_dedup" or r["n_chars"] == len(r["text"])
        removed.append(len(rows) - len(got) + sum(rows[i]["text"] != t for i, t in want.items()))
        rows = {r["doc_id"]: r for r in got}
    assert all(removed)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_awkward_rows(spark, empty):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names, and an empty table, through the chain."""
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a few words\nof text " * 12, None, "s", 3), (3, long, "en", "s", 4), (3, long, "en", "s", 4), (4, long + " end", "en", None, 5)]
    docs = spark.createDataFrame([] if empty else [(*r, "k", "h", 7, "r") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, keep string, hits string, n_words long, rule string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = corpus_pipeline.settle(stage(spark, docs, SF), name)
        assert set(new.columns) <= set(docs.columns) and {"doc_id", "text", "lang", "source", "n_chars"} <= set(new.columns), name
        docs = new
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == (set() if empty else {3})
