"""Every operator and stage on columns with clashing names, repeated and null ids, and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from switchboard.llm import audit, decontamination, language, licenses, mixing, names, ngram_join, packing, quality, queries, rules, substrings, token_ids
from tests.llm.test_operators import prose, shingles

CLASHES = ("_id _no_id _sum label _size _source _source_size _target _copies _copy _bad _kept _of _component _key _text _place _h _words _seed _item id doc text_ key n "
           "digest row number no_id component block blocks tokens sum rid part good toxic fails").split()


def rows_of(rng):
    """Repeated and null ids with different texts, equal rows, empty texts."""
    texts = [prose(rng, rng.randint(20, 90), 3000) for _ in range(14)]
    rows = [(k, t) for k, t in enumerate(texts[:6])] + [(None, t) for t in texts[6:10]] + [(3, t) for t in texts[10:]] + [(None, texts[6]), (2, texts[2]), (None, None), (7, ""), (None, "")]
    return rows + [(None, texts[6] + " end"), (20, texts[0] + " end")]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(40)
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(t or "")) for i, t in rows_of(rng)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.concat(F.lit(c + " of "), F.coalesce(F.col("text"), F.lit("null"))) for c in CLASHES})


def whole(df):
    return sorted(map(tuple, df.collect()), key=repr)


def kept_values(df, out):
    """Rows that come out are rows that went in."""
    assert out.columns == df.columns
    inside = set(whole(df))
    rows = out.collect()
    assert all(tuple(r) in inside for r in rows)
    return rows


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 0, 1), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").withColumns({c: F.lit("x") for c in ("_id", "label", "id")})


def test_names_differ(docs):
    assert names.unused(docs, "_size", "_SIZE", "fresh", "Text") == ["_size_", "_SIZE__", "fresh", "Text__"]


def test_filters_keep_rows_unchanged(spark, docs, labels):
    items = spark.createDataFrame([(1, docs.where("doc_id = 1").first()["text"]), (2, "sixty one"), (3, None), (4, "")], "item_id long, text string")
    out = kept_values(docs, decontamination.without_benchmark(docs, items))
    assert len(out) == docs.count() - 1 and all(r["doc_id"] != 1 for r in out)
    model = quality.train(docs, labels)
    assert len(kept_values(docs, quality.accepted(docs, model, least=-1.0))) == docs.count()
    mixed = kept_values(docs, mixing.mix_sources(docs))
    assert mixed and kept_values(docs, ngram_join.one_per_component(docs))


def test_contaminated_rows_go_and_rows_of_their_ids_stay(spark):
    rng = random.Random(41)
    item = prose(rng, 30, 3000)
    clean = [prose(rng, 40, 3000) for _ in range(6)]
    rows = [(None, t) for t in clean] + [(None, f"{clean[0]} {item}"), (5, clean[1]), (5, f"{item} x"), (6, clean[2]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = whole(decontamination.without_benchmark(df, items))
    assert left == sorted((r for r in rows if not r[1] or item not in r[1]), key=repr)
    assert whole(decontamination.contaminated(df, items).select("doc_id", "n_items")) == [(5, 1), (None, 1)]


def test_short_items_match_whole(spark):
    """Items of five to ten words inside a text, shorter ones only if the text is nothing else."""
    items = spark.createDataFrame([(1, "Quiet grey harbour wall light"), (2, "one two three four five six seven eight nine ten"), (3, "grey"), (4, "grey!")], "item_id long, text string")
    rows = [(1, "the quiet, GREY harbour wall -- light on"), (2, "quiet grey old harbour wall light"), (3, "zero one two three four five six seven eight nine ten eleven"),
            (4, "one two three four five six seven eight nine"), (5, "Grey."), (6, None), (7, "harbour")]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 5, 0, 4, 1), (3, 2, 10, 0, 9, 1), (5, 3, 1, 0, 0, 1)]
    left = decontamination.without_benchmark(spark.createDataFrame(rows, "doc_id long, text string"), items.where("item_id = 2"))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 4, 5, 6, 7]


def test_rows_of_null_ids_are_joined_once(spark, monkeypatch):
    """The texts of classes are fetched by id and text: their number is linear in the rows, null ids or not."""
    rng = random.Random(42)
    base = [prose(rng, 60, 4000) for _ in range(12)]
    rows = [(None, t) for t in base] + [(None, t + " end") for t in base] + [(4, t + " more") for t in base[:4]] + [(None, base[0])] * 20
    fetched = spark.sparkContext.accumulator(0)
    plain = ngram_join.set_bytes

    def counting(size):
        def run(batches):
            batches = list(batches)
            fetched.add(sum(b.num_rows for b in batches))
            return plain(size)(iter(batches))
        return run

    monkeypatch.setattr(ngram_join, "set_bytes", counting)
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert 0 < fetched.value <= 28  # once for each different text
    sets = [shingles(t, 5) for _, t in rows]
    links = sorted(sum(j != i and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets))
    assert sorted(r["n_links"] for r in got) == links and len(got) == len(rows)
    kept = ngram_join.one_per_component(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["doc_id"] is None for r in kept) == 44


def test_operators_bear_clashing_names(spark, docs, labels, tmp_path):
    n = docs.count()
    assert rules.apply_rules(docs, sample=3).count() == n
    assert licenses.license_spans(docs).count() == n
    assert quality.score_quality(docs, quality.train(docs, labels)).count() == n
    assert language.languages_of(docs, language.train(docs)).count() == n
    assert substrings.remove_repeats(docs).count() == n
    assert ngram_join.ngram_jaccard_join(docs).count() == n
    assert {r["part"] for r in audit.audit_filters(docs, labels).collect()} == {"", "de", "en"}
    assert {r["doc_id"] for r in packing.pack_documents(docs, queries.tokenizer_path(), 2).collect()} == {r["doc_id"] for r in docs.collect()}
    planned = mixing.copies_of(docs)
    assert planned.columns == docs.columns + ["_size_", "_source_size_", "_target_", "_copies_"]
    assert all(r["_size"].startswith("_size of ") and r["_size_"] == len((r["text"] or "").split()) for r in planned.collect())
    token_ids.write_corpus(docs, str(tmp_path / "ids"), queries.tokenizer_path(), 2)
    assert token_ids.read_corpus(spark, str(tmp_path / "ids")).count() == n


def test_sample_of_rules_is_rows(spark):
    """An id or a row that a third of all rows have doesn't widen the sample."""
    df = spark.range(300).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "if(id % 6 = 0, 'same text', concat('text ', id)) AS text")
    import numpy as np

    found = df.select(F.xxhash64("doc_id", "text").alias("key")).orderBy("key").limit(40).distinct().count()
    assert found <= 40 and len(rules.ordered_rules(df, rules=(lambda d, a: np.zeros(len(a) - 1, bool),), sample=40)) == 1


def test_stages_on_odd_and_empty_tables(spark, docs, tmp_path):
    from tests.conftest import TESTDATA

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars", "_id", "label", "_size", "_key", "_text", "_bad", "_kept")
    for k, df in enumerate((plain, plain.limit(0))):
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, df, TESTDATA)
            rows = kept_values(df, out)
            assert bool(rows) == (k == 0), name
        assert corpus_pipeline.STAGES[4][1](spark, df, TESTDATA).count() == (plain.count() if k == 0 else 0)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert substrings.remove_repeats(empty).count() == ngram_join.ngram_jaccard_join(empty).count() == licenses.license_spans(empty).count() == 0
    assert decontamination.contaminated(empty, items).count() == decontamination.contaminated(some, items).count() == 0
    assert decontamination.contaminated(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert decontamination.without_benchmark(some, items).count() == 1 and ngram_join.one_per_component(empty).count() == 0


def test_text_does_not_depend_on_the_number_of_pages(spark):
    """The same page has the same text on hosts of 2 to 30 pages, with and without article elements."""
    from switchboard.llm import templates

    post = "<body><div class=top>Buy now</div><div class=post><h1>Head {k}</h1><p>In all</p><p>Own words {k}</p></div><div class=bottom>All rights</div></body>"
    rows = [(100 * n + k, f"http://h{n}.example.com/{k}", post.format(k=k)) for n in (2, 7, 8, 30) for k in range(n)]
    got = {r["page_id"]: r["text"] for r in templates.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Head {i % 100}\nIn all\nOwn words {i % 100}" for i, _, _ in rows}
