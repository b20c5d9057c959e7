"""Filter audit, packing and vector codes against brute force, and on nulls, repeats, empty tables and odd columns."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from switchboard.llm import audit, lookup, packing, queries, vector_codes
from switchboard.llm import words as W
from switchboard.llm.token_ids import Encoder
from tests.llm.test_operators import WORD, corpus, found, table

CLASHES = ["_id", "label", "doc", "rid", "part", "good", "toxic", "fails", "digest", "first", "held", "side", "before", "alive", "filter", "n", "id", "place"]


def odd(df):
    """Extra columns under names that the operators use."""
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})


# filter audit

def plain_fails(rows):
    """The filters each (id, text) fails."""
    first = {}
    for i, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        tests = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": i is not None and first.get(t, i) < i}
        out.append({f for f, bad in tests.items() if bad})
    return out


def plain_audit(rows, parts, labels, names="ABCDE"):
    """Every order applied row by row."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails, out, total = plain_fails(rows), {}, Counter()
    for order in itertools.permutations(names):
        for part in set(parts):
            left = [k for k in range(len(rows)) if parts[k] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [k for k in left if f in fails[k]]
                left = [k for k in left if f not in fails[k]]
                out[part, "".join(order), step] = (
                    len(left), len(removed), sum(f in fails[k] for k in gone), sum(fails[k] == {f} for k in range(len(rows)) if parts[k] == part),
                    sum(rows[k][0] in good for k in removed), sum(rows[k][0] in toxic for k in removed))
                total[part, f] += len(removed)
                gone += removed
    return sorted((*key, *row, total[key[0], key[1][key[2] - 1]]) for key, row in out.items())


def test_audit_equals_brute_force(spark):
    rng = random.Random(21)
    rows = corpus(21) + [(500 + k, t) for k, t in enumerate(["ABC DEF " * 60, "# " * 120, " ".join(f"w{k}" for k in range(200)), " ".join(f"W{k}" for k in range(200)) + " &"])]
    rows += [(600 + k, rows[-2][1]) for k in range(30)] + [(None, rows[-2][1])] * 2  # a third of all rows are copies
    langs = [rng.choice(["en", "de", None, ""]) for _ in rows]
    docs = spark.createDataFrame([(i, t, g, "x") for (i, t), g in zip(rows, langs, strict=True)], "doc_id long, text string, lang string, source string").repartition(3)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i, _ in rows if rng.random() < 0.7] + [(None, 1, 1), (9999, 1, 1), (601, 1, None), (601, 0, 1)]
    table_of = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit_filters(odd(docs), odd(table_of.withColumnRenamed("toxic", "t")).drop("toxic").withColumnRenamed("t", "toxic"))
    want = plain_audit(rows, [g or "" for g in langs], labels)
    assert len(want) == 3 * 600 and any(r[5] for r in want) and any(r[7] for r in want)
    assert sorted(map(tuple, got.collect())) == want
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("audit_")]


def test_audit_of_other_filters(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a"), (3, None), (4, "a b")], "doc_id long, text string").withColumn("kind", F.lit(7))
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    own = {"x": lambda t: t.contains("b"), "y": lambda t: F.length(t) < 2}
    got = {(r["filter_order"], r["step"]): (r["part"], r["kept"], r["removed"], r["good_lost"]) for r in audit.audit_filters(docs, labels, own, None, part_column="kind").collect()}
    assert got == {("xy", 1): ("7", 2, 2, 0), ("xy", 2): ("7", 0, 2, 1), ("yx", 1): ("7", 2, 2, 1), ("yx", 2): ("7", 0, 2, 0)}
    clean = audit.audit_filters(docs, labels.limit(0), {"z": lambda t: t == "none"}, None, part_column="kind").collect()
    assert [(r["kept"], r["removed"], r["unique_fails"], r["shapley"]) for r in clean] == [(4, 0, 0, 0)]
    assert audit.audit_filters(docs.limit(0), labels, own, "E", part_column="kind").count() == 0
    with pytest.raises(ValueError):
        audit.audit_filters(docs, labels, {"long name": own["x"]}, None)


def test_facts_of_frequent_and_rare_keys(spark, monkeypatch):
    monkeypatch.setattr(lookup, "MOST_HOT", 10)
    rows = spark.range(300).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 40)) AS key")
    facts = rows.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("held")).where("key <> 'k1'")
    got = {r["id"]: r["least"] for r in lookup.with_facts(rows, facts, "key", "held").collect()}
    key = {i: "hot" if i % 3 == 0 else f"k{i % 40}" for i in range(300)}
    assert got == {i: None if key[i] == "k1" else min(j for j in key if key[j] == key[i]) for i in range(300)}


# packing

def checked(rows, docs, library, capacity):
    """Asserts that pieces cover every document once and sequences have no gaps; gives ids in sequences, padding, pieces of a document."""
    by_text, by_sequence = Counter(), defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) > 0 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_sequence[r["sequence_id"]].append(r)
        pieces[r["doc_id"]].append(r)
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in docs)
    for i, own in pieces.items():
        # rows of one id may be several documents: pieces follow one another within each
        open_ = []
        for p in sorted(own, key=lambda p: p["start"]):
            for d in open_ if p["start"] else []:
                if len(d) == p["start"] and any(k[0] == i and k[1][:len(d) + p["length"]] == (*d, *p["ids"]) and len(k[1]) == p["doc_tokens"] for k in want):
                    d += p["ids"]
                    break
            else:
                assert p["start"] == 0
                open_.append(list(p["ids"]))
        by_text.update((i, tuple(d)) for d in open_)
    assert by_text == want
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        at = [0, *itertools.accumulate(r["length"] for r in own)]
        assert [r["offset"] for r in own] == at[:-1] and at[-1] <= capacity
        padding += 0 if math.log2(at[-1]).is_integer() else capacity - at[-1]
    return sum(r["length"] for r in rows), padding, len(rows) / len(docs)


@pytest.mark.parametrize("capacity, by_word", [(4096, True), (100, True), (64, False), (1, True)])
def test_packing(spark, capacity, by_word):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    rows = [(i, t) for i, t in corpus(31) if capacity > 1 or i is None or i % 7 == 0]
    docs = odd(table(spark, rows))
    got = packing.pack_documents(docs, queries.tokenizer_path(), 2, capacity=capacity, by_word=by_word)
    ids, padding, _ = checked(got.collect(), rows, library, capacity)
    assert padding <= 0.03 * ids
    assert packing.pack_documents(docs.limit(0), queries.tokenizer_path(), 2).count() == 0


def test_large_workers_fill_their_classes():
    rng = np.random.default_rng(4)
    worker, rows, lengths = packing.Worker(4096, packing.SLACK, 0), [], {}
    for batch in range(20):
        n = (2 ** rng.uniform(0, 14, 300)).astype(np.int64)
        names = np.arange(300) + 300 * batch
        lengths |= dict(zip(names.tolist(), n.tolist(), strict=True))
        for doc, start, length, _, sizes, sequence, offset, _ in worker.add(packing.pa.array(names), np.concatenate([np.arange(k) for k in n]).astype(np.uint32), n):
            rows += zip(doc.to_pylist(), start, length, sizes, sequence, offset, strict=True)
            assert len(worker.ids) <= 128 * 4096
    full = sum(r[2] for r in rows)
    for doc, start, length, _, sizes, sequence, offset, flat in worker.finish():
        rows += zip(doc.to_pylist(), start, length, sizes, sequence, offset, strict=True)
        assert flat.tolist() == [x for a, b in zip(start, length, strict=True) for x in range(a, a + b)]
    assert full > 0.9 * sum(r[2] for r in rows)
    covered = defaultdict(list)
    for doc, start, length, size, _, _ in rows:
        assert size == lengths[doc]
        covered[doc].append((start, length))
    assert set(covered) == set(lengths)
    for doc, runs in covered.items():
        runs.sort()
        assert [s for s, _ in runs] == [0, *itertools.accumulate(n for _, n in runs)][:-1] and sum(n for _, n in runs) == lengths[doc]
    held = Counter()
    for *_, length, _, sequence, _ in rows:
        held[sequence] += length
    total, padding = sum(held.values()), sum(0 if n & (n - 1) == 0 else 4096 - n for n in held.values())
    assert padding <= 0.01 * total and max(held.values()) <= 4096
    assert len(rows) <= 4 * len(lengths) + total / 4096


def test_cuts_keep_to_their_classes():
    for capacity in (1, 7, 100, 4096):
        n = np.arange(1, 3 * capacity + 5)
        pieces = packing.cut(n, capacity)
        assert np.array_equal(np.bincount(pieces.doc, pieces.length), n) and (pieces.length <= pieces.place).all()
        assert set(pieces.place.tolist()) <= {capacity // k for k in range(1, capacity + 1)}
        assert ((pieces.place - pieces.length) * packing.SLACK <= n[pieces.doc]).all()
    assert packing.borders(4096 * 2 + 7, 4096).tolist() == [0, 4096, 8192, 8196, 8198, 8199] and packing.borders(0, 4096).tolist() == [0]


def test_long_texts_are_encoded_in_runs(monkeypatch):
    pytest.importorskip("tokenizers")
    encoder = Encoder(queries.tokenizer_path(), True)
    text = (" ".join(f"word{k}é" for k in range(300)) + " " + "x" * 90 + "\n<|endoftext|> end ").encode()
    data = np.frombuffer(text, np.uint8)
    whole, n = packing.encoded(encoder, data, np.array([0, len(data)]), 2)
    monkeypatch.setattr(W, "SLICE_BYTES", 50)
    again, m = packing.encoded(encoder, data, np.array([0, len(data)]), 2)
    assert whole.tolist() == again.tolist() == [*encoder.tokenizer.encode(text.decode(), add_special_tokens=False).ids, 2] and n == m


def test_sequences_hold_their_pieces(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    rows = [(i, t) for i, t in corpus(32) if i is not None]
    pieces = packing.pack_documents(table(spark, rows), queries.tokenizer_path(), 2, capacity=200, by_word=True)
    got = packing.sequences(pieces, pad=0, capacity=200).collect()
    assert all(len(r["ids"]) == (r["length"] if r["length"] & (r["length"] - 1) == 0 else 200) and not any(r["ids"][r["length"]:]) for r in got)
    want = Counter(x for _, t in rows for x in library.encode(t or "", add_special_tokens=False).ids + [2])
    assert Counter(x for r in got for x in r["ids"][:r["length"]]) == want


def test_packing_query(spark):
    tokenizers = pytest.importorskip("tokenizers")
    from tests.conftest import TESTDATA

    docs = queries.table(spark, TESTDATA, "documents")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rows = packing.pack_documents(docs, queries.tokenizer_path(), 2, by_word=True).collect()
    ids, padding, pieces = checked(rows, texts, tokenizers.Tokenizer.from_file(queries.tokenizer_path()), 4096)
    assert padding <= 0.01 * ids and pieces < 4
    query = queries.QUERIES["op12_packing"](spark, TESTDATA)
    assert found(query.drop("sequence_id", "offset")) == found(spark.createDataFrame(rows).select(*query.columns).drop("sequence_id", "offset"))


# vector codes

def plain_codes(values, entries, rounds):
    """Books and codes by comparing everything with everything."""
    n, parts, _ = values.shape
    books = [[values[k, p].tolist() for k in range(min(entries, n))] for p in range(parts)]
    nearest = lambda p, x: min(range(len(books[p])), key=lambda k: (sum((int(a) - b) ** 2 for a, b in zip(x, books[p][k], strict=True)), k))
    for turn in range(rounds + 1):
        codes = [[nearest(p, values[i, p]) for p in range(parts)] for i in range(n)]
        if turn < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    own = [values[i, p].tolist() for i in range(n) if codes[i][p] == k]
                    if own:
                        books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return books, codes


def by_trees(values, entries, rounds, block):
    books = values[:entries].transpose(1, 0, 2).astype(np.int64)
    trees = [(vector_codes.plant(values[k:k + block]), values[k:k + block]) for k in range(0, len(values), block)]
    for _ in range(rounds):
        sums, counts = (sum(x) for x in zip(*(vector_codes.owned(f, v, books, False)[:2] for f, v in trees), strict=True))
        books = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
    return books.tolist(), np.concatenate([vector_codes.owned(f, v, books, True)[2] for f, v in trees]).tolist()


@pytest.mark.parametrize("kind", ["clusters", "ties", "equal", "large", "single"])
def test_trees_equal_brute_force(kind):
    rng = np.random.default_rng(7)
    values = {"clusters": lambda: rng.integers(0, 6, (400, 1, 4)) * 3000 + rng.normal(0, 60, (400, 4, 4)).astype(int), "ties": lambda: rng.integers(-2, 3, (300, 3, 2)),
              "equal": lambda: np.full((90, 2, 3), -7), "large": lambda: rng.integers(-(1 << 26), 1 << 26, (120, 2, 2)), "single": lambda: rng.integers(0, 9, (1, 8, 8))}[kind]().astype(np.int32)
    for block in (1000, 70):
        assert by_trees(values, 16, 6, block) == plain_codes(values, 16, 6)


def test_balls_hold_their_points():
    rng = np.random.default_rng(8)
    values = (rng.integers(0, 4, (700, 1, 3)) * 900 + rng.integers(-50, 50, (700, 2, 3))).astype(np.int32)
    f = vector_codes.plant(values)

    def points_of(b):
        return f.points[f.first[b]:f.first[b] + f.count[b]].tolist() if f.left[b] < 0 else points_of(f.left[b]) + points_of(f.right[b])

    for b in range(len(f.part)):
        x = values[points_of(b), f.part[b]].astype(np.int64)
        assert len(x) == f.count[b] and x.sum(0).tolist() == f.total[b].tolist()
        assert np.sqrt(((x - x.mean(0)) ** 2).sum(1)).max() <= f.radius[b] * (1 + 1e-9) + 1e-6
    assert sorted(points_of(0)) == sorted(points_of(1)) == list(range(700)) and (f.count[f.left < 0] <= vector_codes.LEAF).all()
    # clusters far apart are owned as whole balls: few points are compared
    books = np.stack([np.stack([values[:, p][values[:, 0, 0] // 450 == g].mean(0) for g in (0, 2, 4, 6)]) for p in range(2)]).round().astype(np.int64)
    near = vector_codes.owned(f, values, books, True)[2]
    assert (near == ((values[:, :, None].astype(np.int64) - books) ** 2).sum(3).argmin(2)).all()


def test_codes_on_odd_tables(spark):
    rng = np.random.default_rng(9)
    nan, inf = float("nan"), float("inf")
    rows = [(int(i), rng.normal(0, 1, 16).astype(np.float32).tolist(), None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(200)]
    rows += [(rows[0][0], rows[1][1], 1), (None, rows[2][1], 2), (None, rows[2][1], 2), rows[3]]
    bad = [(900, None, 1), (901, [], 1), (-5, [nan] * 16, 1), (-6, [inf] + [0.0] * 15, 1), (-7, [None] + [0.0] * 15, 1), (902, [0.5] * 8, 1)]
    schema = "vec_id long, embedding array<float>, label int"
    df = spark.createDataFrame(rows + bad, schema).repartition(3).withColumns({c: F.lit("clash") for c in ("id", "v", "code", "error", "vectors", "part", "held", "label_error")})
    got = vector_codes.compress(df).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    values = np.floor(np.array([r[1] for r in order], float) * 4096).astype(np.int32).reshape(len(rows), 8, 2)
    books, codes = plain_codes(values, 16, 6)
    error = [sum((int(a) - b) ** 2 for p in range(8) for a, b in zip(values[i, p], books[p][codes[i][p]], strict=True)) for i in range(len(rows))]
    per = Counter()
    for r, e in zip(order, error, strict=True):
        per[r[2]] += e
    want = sorted(((r[0], "".join(f"{c:02x}" for c in codes[i]), error[i], per[r[2]]) for i, r in enumerate(order)), key=repr)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=repr) == want
    import hashlib
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}
    few = spark.createDataFrame(rows[:5], schema)
    assert [r["error"] for r in vector_codes.compress(few).collect()] == [0] * 5
    assert vector_codes.compress(few.limit(0)).count() == 0 and vector_codes.compress(spark.createDataFrame(bad[:2], schema)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress(few, parts=3)


def test_components_too_large_for_exact_distances_are_an_error():
    assert vector_codes.exact_kind(1 << 20, 64) is np.float64 and vector_codes.exact_kind(1 << 26, 64) is np.int64
    with pytest.raises(ValueError):
        vector_codes.exact_kind(1 << 31, 64)
