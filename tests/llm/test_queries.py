"""The registered corpus queries on the smallest tables: SQL where there is one, brute force or held-out accuracy elsewhere."""

import hashlib
import html
import os
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from switchboard.llm import licenses, quality, queries, token_ids
from tests.conftest import TESTDATA
from tests.llm.test_operators import LOW, WORD, shingles

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="needs the document tables")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for file in os.listdir(TESTDATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{TESTDATA}/{file}'")
    return con


@pytest.fixture(scope="module")
def texts(database):
    return {i: t or "" for i, t in database.execute("SELECT doc_id, text FROM documents").fetchall()}


def collected(spark, name):
    return queries.QUERIES[name](spark, TESTDATA).collect()


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, database, name):
    df = queries.QUERIES[name](spark, TESTDATA)
    want = database.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(want.fetchall())


def test_decontamination_finds_every_whole_item(spark, database, texts):
    plain = lambda t: f" {' '.join(re.sub('[^a-z0-9]+', ' ', t.lower()).split())} " if t.isascii() else f" {' '.join(WORD.findall(t.lower()))} "
    items = [plain(t) for (t,) in database.execute("SELECT text FROM benchmark").fetchall()]
    whole = {i for i, t in texts.items() if any(x in plain(t) for x in items)}
    got = {r["doc_id"] for r in collected(spark, "op1_benchmark_decontamination")}
    assert whole and whole <= got and len(got - whole) <= len(whole)


def test_repeats(spark, texts):
    words = {i: WORD.findall(t) for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k:k + 13]), i)
    for r in collected(spark, "op2_substring_dedup"):
        w = words[r["doc_id"]]
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k:k + 13])] < r["doc_id"]:
                gone[k:k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_licenses(spark, texts):
    for r in collected(spark, "op3_license_scan"):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r["doc_id"]].translate(LOW))
        places = [(k, n.label) for n in licenses.BASE for q in [n.words.split()] for k in range(len(w)) if w[k:k + len(q)] == q]
        at = [k for k, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""} and 0 <= r["score"] <= 1


def test_languages_held_out(spark, database):
    want = dict(database.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = collected(spark, "op4_language_mixture")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows) and len(rows) == len(want)
    held = [r["lang_pred"] == want[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(held) >= 0.97 * len(held) > 20


def test_pages(spark, database):
    pages = dict(database.execute("SELECT page_id, html FROM pages").fetchall())
    for r in collected(spark, "op5_html_templates"):
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.DOTALL)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_quality_held_out(spark, database):
    want = dict(database.execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = collected(spark, "op7_quality_classifier")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r["predicted"] == want[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in want]
    assert sum(held) >= 0.9 * len(held) > 5


def test_join(spark, texts):
    sets = {i: shingles(t, 3) for i, t in texts.items()}
    name = {i: i for i in sets}
    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = sorted((name[i], name[j]))
                name = {k: a if v == b else v for k, v in name.items()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in collected(spark, "op8_ngram_jaccard_join")} == {i: (len(sets[i]), name[i]) for i in ids}


def test_pipeline_stages(spark, database, tmp_path):
    """Each stage against brute force over what it was given."""
    from tokenizers import Tokenizer

    docs = queries.table(spark, TESTDATA, "documents")
    columns, kept = docs.columns, {}
    kept["documents"] = docs.select("doc_id", "text", "source").collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, TESTDATA)
        if k < 4:
            assert out.columns == columns
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            kept[name] = docs.select("doc_id", "text", "source").collect()
        else:
            kept[name] = out.collect()
    ids = lambda name: {r["doc_id"] for r in kept[name]}
    label = dict(database.execute("SELECT doc_id, quality FROM labels").fetchall())
    good = {i for i, q in label.items() if q}
    assert len(good - ids("quality_classifier")) <= 0.03 * len(good)
    assert len(ids("quality_classifier") & (set(label) - good)) <= 0.1 * len(set(label) - good) + 1
    sets = {r["doc_id"]: shingles(r["text"], 5) for r in kept["quality_classifier"]}
    name = {i: i for i in sets}
    for i in sorted(sets):
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((name[i], name[j]))
                name = {k: a if v == b else v for k, v in name.items()}
    assert ids("ngram_jaccard_join") == set(name.values()) and len(kept["ngram_jaccard_join"]) == len(set(name.values()))
    # the SQL of the operators over what each stage was given
    over = duckdb.connect()
    over.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{TESTDATA}/benchmark.parquet'")
    over.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/ngram_jaccard_join/*.parquet'")
    hit = {i for (i,) in over.execute(f"SELECT doc_id FROM ({queries.ORACLES['op1_benchmark_decontamination']})").fetchall()}
    assert hit and ids("benchmark_decontamination") == ids("ngram_jaccard_join") - hit
    over.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/benchmark_decontamination/*.parquet'")
    count = Counter(r["doc_id"] for r in kept["mixing_sources"])
    plan = over.execute(f"SELECT doc_id, size, taken FROM ({queries.ORACLES['op6_mixing_sources']})").fetchall()
    assert {i for i, _, _ in plan} == ids("benchmark_decontamination") >= set(count)
    assert all(count[i] * size == taken for i, size, taken in plan) and max(count.values()) <= 2
    library = Tokenizer.from_file(queries.tokenizer_path())
    mixed = sorted(kept["mixing_sources"], key=lambda r: r["doc_id"])
    want = [len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in mixed]
    rows = sorted(kept["token_ids"], key=lambda r: r["start"])
    assert [(r["doc_id"], r["n_tokens"]) for r in rows] == list(zip((r["doc_id"] for r in mixed), want, strict=True))


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, TESTDATA).collect()
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    rows.sort(key=lambda r: r["start"])
    assert rows and [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:k]) for k in range(len(rows))]
    assert quality.REJECT_BELOW == 0.3 and token_ids.BLOCK_IDS > 0
