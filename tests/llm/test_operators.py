"""The corpus operators against brute force, and on nulls, empty texts, repeats, empty tables and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from switchboard.llm import (components, decontamination, language, licenses, mixing, ngram_join, quality, queries, rules, substrings, templates,
                             token_ids)
from switchboard.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, bucket long, key long, _extra string"


def table(spark, pairs):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", None, 0.5, 7, 1, 2, "x") for k, (i, t) in enumerate(pairs)], SCHEMA).repartition(3)


def prose(rng, n, kinds=400):
    return " ".join(f"w{int(kinds * rng.random() ** 2)}" for _ in range(n))


def corpus(seed=1):
    """Copies, near copies, shared passages, nulls, empty, very long and repeated texts."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    passage = prose(rng, 40)
    near = []
    for t in base[:12]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = f"new{rng.randrange(99)}"
            near.append(" ".join(v))
    texts = [*base, *near, *base[:5], *(f"{prose(rng, 30)} {passage} {prose(rng, 20)}" for _ in range(6)), *(f"{prose(rng, 9)}\n{passage}" for _ in range(4)),
             "", "   \t\n", None, "one", "one two", "One  TWO", "é ü ß", "a a a a a a a a a a a a a a a a", prose(rng, 6000), "x\x0by z  w"]
    rng.shuffle(texts)
    return [*enumerate(texts), (5, texts[5]), (None, texts[7]), (None, None)]


def found(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_join_equals_brute_force(spark, size, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 300)  # groups are compared block by block
    rows = corpus()
    sets = [shingles(t, size) for _, t in rows]
    linked = [[j for j, b in enumerate(sets) if j != i and a and b and 100 * len(a & b) >= percent * len(a | b)] for i, a in enumerate(sets)]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[i], *(group[j] for j in linked[i])]) for i in range(len(rows))]
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[group[k]] = min(names.get(group[k], i), i)
    want = sorted(((i, len(sets[k]), names.get(group[k]) if sets[k] else i, len(linked[k])) for k, (i, _) in enumerate(rows)), key=repr)
    assert found(ngram_join.ngram_jaccard_join(table(spark, rows), size, percent)) == want
    kept = [r["doc_id"] for r in ngram_join.one_per_component(table(spark, rows), size, percent).collect() if r["doc_id"] is not None]
    assert sorted(kept) == sorted({i for i, _, c, _ in want if i is not None and i == c})
    assert ngram_join.one_per_component(table(spark, rows)).columns == SCHEMA.replace(",", "").split()[::2]


def test_long_lists_in_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST", 4)
    rng = random.Random(12)
    rows = []
    for k in range(3):  # three groups of near copies of very different sizes with a common beginning
        whole = ("the same beginning of all of them " + prose(rng, 60, 3000)).split()
        for _ in range((60, 30, 5)[k]):
            words = list(whole)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(9)}"
            rows.append((len(rows), " ".join(words)))
    sets = [shingles(t, 3) for _, t in rows]
    linked = [[j for j, b in enumerate(sets) if j != i and 100 * len(a & b) >= 90 * len(a | b)] for i, a in enumerate(sets)]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[i], *(group[j] for j in linked[i])]) for i in range(len(rows))]
    want = sorted(((i, len(sets[i]), group[i], len(linked[i])) for i, _ in rows), key=repr)
    assert found(ngram_join.ngram_jaccard_join(table(spark, rows), 3, 90)) == want


def test_any_two_entries_of_a_cut_list_meet():
    rng = np.random.default_rng(5)
    key = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    value = np.full(50, 77, np.uint64)
    for blocks in (1, 2, 7):
        entry, bucket = ngram_join.block_pairs(value, key, np.full(50, blocks), 1000)
        assert np.bincount(entry).tolist() == [blocks] * 50
        places = [set(bucket[entry == k].tolist()) for k in range(50)]
        assert all(a & b for a in places for b in places)
        assert len(set().union(*places)) == blocks * (blocks + 1) // 2


def test_unlinked_texts_of_one_id_stay(spark):
    rng = random.Random(9)
    first, alone, other = (prose(rng, 60, 5000) for _ in range(3))
    near = "a " + first  # of the two texts of id 7 the smaller one, a near copy of id 1
    rows = [(1, first), (7, near), (7, alone), (8, other), (8, alone), (8, other), (9, ""), (9, None), (9, other + " end")]
    kept = ngram_join.one_per_component(table(spark, rows), 5, 80).select("doc_id", "text").collect()
    assert sorted((i, t or "") for i, t in kept) == sorted([(1, first), (7, alone), (8, other), (9, "")])
    assert near < alone


def test_sketches_lose_no_link():
    rng = np.random.default_rng(3)
    for percent, n in ((90, 40), (90, 700), (80, 90), (80, 2000)):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        out = int(ngram_join.most_differing(np.array(2 * len(a)), percent)) // 2
        b = np.sort(np.concatenate([a[out:], rng.integers(0, 1 << 63, out, dtype=np.uint64)]))
        far = np.sort(rng.integers(0, 1 << 63, len(a), dtype=np.uint64))
        size = np.array([len(a), len(b), len(far)])
        flat, words = ngram_join.sketches(np.repeat([0, 1, 2], size), np.concatenate([a, b, far]), size, percent)
        begin = np.cumsum(words) - words
        good = ngram_join.may_link(np.array([0, 0]), np.array([1, 2]), size, words, begin, flat, percent)
        assert good.tolist() == [True, False]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(3, 3), (None, 4)]
    name = {}
    for a, b in edges:
        if a is not None and a != b:
            x, y = name.get(a, {a}), name.get(b, {b})
            for n in x | y:
                name[n] = x | y
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(s) for n, s in name.items()}


def test_repeats_equal_brute_force(spark):
    rows = corpus(4)
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k:k + 13])] = min(first.get(tuple(w[k:k + 13]), i), i)
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k:k + 13])] < i:
                gone[k:k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    assert sum(r[2] for r in want) > 300
    assert found(substrings.remove_repeats(table(spark, rows))) == sorted(want, key=repr)


def test_decontamination_bears_substitutions(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, 20, 3000)) for k in range(6)] + [(7, "too short"), (8, None), (9, prose(random.Random(99), 1))]
    items.append((10, items[0][1].upper()))  # the same words under a larger id
    rows, want = [(0, None), (1, ""), (2, "tiny")], {}
    for k in range(40):
        w = items[k % 6][1].split()
        for _ in range(k % 4):  # up to three substitutions
            w[rng.randrange(3, 17)] = "other"
        rows.append((100 + k, f"{prose(rng, 30, 3000)} {', '.join(w)}! {prose(rng, 5, 3000)}"))
        equal = [x == y for x, y in zip(w, items[k % 6][1].split(), strict=True)]
        if k % 4 < 3:
            want[100 + k] = (k % 6, equal)
    rows += [(200 + k, prose(rng, 300, 3000)) for k in range(20)] + [(300, " ".join(items[2][1].split()[:8]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = {r["doc_id"]: r for r in decontamination.contaminated(table(spark, rows), benchmark).collect()}
    assert set(want) <= set(got) <= {100 + k for k in range(40)}
    assert all(got[i]["item_id"] == item for i, (item, _) in want.items())
    left = {r["doc_id"] for r in decontamination.without_benchmark(table(spark, rows), benchmark).collect()}
    assert left == {i for i, _ in rows} - set(got)
    assert decontamination.contaminated(table(spark, rows), benchmark.limit(0)).count() == 0


def test_masks_hit_every_passage_with_two_substitutions():
    from itertools import combinations

    places = [{o + p for p in mask} for mask in decontamination.MASKS for o in range(15 - decontamination.SPAN + 1)]
    assert all(any(not p & set(c) for p in places) for c in combinations(range(15), 2))
    assert all(max(m) == decontamination.SPAN - 1 and len(m) == 7 for m in decontamination.MASKS)


def test_benchmark_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(8)
    items = spark.createDataFrame([(k, prose(rng, 25, 3000)) for k in range(30)], "item_id long, text string")
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("some words before "), "text").alias("text"))
    whole = found(decontamination.contaminated(docs, items))
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 200)
    assert found(decontamination.contaminated(docs, items)) == whole and len(whole) == 30


def test_targets_equal_resharing(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 400), ("d", 0), ("e", 3), (None, 700), ("é", 5), ("B", 90)]
    rows = [(k, " ".join(["w"] * n), s) for k, (s, n) in enumerate(sizes)] + [(99, None, "a"), (None, "x y", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("clash"))
    got = mixing.copies_of(docs).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while True:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] > 2 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * size[s]
            left -= target[s]
        open_ -= over
    target.update(part)
    assert {r["source"]: r["_target"] for r in got} == pytest.approx(target)
    assert all(0 <= r["_copies"] <= 2 for r in got) and len(got) == len(rows)
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["_copies"] for r in got)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_copies_come_near_the_targets(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', 1 + int(id % 50)) AS text", "if(id % 3 = 0, 'hot', concat('s', id % 7)) AS source")
    per = mixing.copies_of(docs).groupBy("source").agg(F.sum(F.col("_size") * F.col("_copies")).alias("taken"), F.max("_target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.06 * r["target"] for r in per)


def plain_rules(text):
    """Base numbers and verdict of one text, word by word."""
    w = WORD.findall(text)
    grams = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    again = {j for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    chars, n, dup = sum(map(len, w)), len(w), len(lines) - len(set(lines))
    number = lambda pattern: len(re.findall(pattern, text))
    symbols, failed = number(r"[#*$%&|<>]"), n < 50 or 100 * len(again) > 50 * n
    bad = (chars < 3 * n or chars > 10 * n or 10 * symbols > n or 100 * number(r"[.,;:!?'\"()-]") > 15 * chars or 100 * number("[A-Z]") > 30 * chars
           or 100 * number("[0-9]") > 20 * chars or 2 * dup > len(lines) or 100 * max(Counter(w).values(), default=0) > 30 * n)
    return n, chars, symbols, dup, len(again), failed, not failed and not bad


def test_rules_equal_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["Harbour", "stone", "river", "über", "walked", "a", "the", "quiet", "lantern", "morning", "bridge", "çela"]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", "n"]) for _ in range(rng.randint(40, 160))) for _ in range(30)]
    texts += [t.upper() for t in texts[:3]] + [t.replace(" ", " # ") for t in texts[:3]] + [t.replace("a", "1") for t in texts[:3]] + [texts[0] + "\n" + texts[0]]
    texts += ["\n".join([texts[1], *["Menu here \r"] * 4, " \t"]), texts[2].replace(" ", "... "), " ".join(["word"] * 60)]
    rows = corpus(10) + [(1000 + k, t) for k, t in enumerate(texts)]
    want = sorted(((i, *plain_rules(t or "")) for i, t in rows), key=repr)
    assert {r[-1] for r in want} == {True, False}
    assert found(rules.apply_rules(table(spark, rows), sample=50)) == want
    assert found(rules.apply_rules(table(spark, rows), rules=rules.RULES[::-1], sample=5)) == want
    assert rules.apply_rules(table(spark, rows).limit(0)).count() == 0


def test_rules_are_ordered_by_rejections_per_cost(spark):
    def never(data, at):
        return np.zeros(len(at) - 1, bool)

    def always(data, at):
        return np.ones(len(at) - 1, bool)

    assert rules.ordered_rules(table(spark, corpus()), rules=(never, always), sample=20) == [always, never]
    seen = []

    def watch(data, at):
        seen.append(len(at) - 1)
        return never(data, at)

    data, at = W.text_bytes(pa.array(["a b", "c", "d"]))
    assert rules.cascade((always, watch), data, at, np.arange(3)).tolist() == [] and not seen
    assert rules.cascade((watch,), data, at, np.array([0, 2])).tolist() == [0, 2] and seen == [2]


def test_license_spans(spark):
    texts = ["Released under the MIT License.", "gnu  GENERAL-public\nlicense and Apache License, apache licence", "summit license", "cc by; cc bye", None, "",
             "Permission is herby granted, free of charge, to any person obtaning a copy", "mit license mit license", "the mité license"]
    spans = licenses.license_spans(table(spark, list(enumerate(texts))))
    got = {r["doc_id"]: r for r in licenses.license_summary(spans).collect()}
    base = {i: (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for i, r in got.items()}
    assert base == {0: (1, 3, 3, "mit"), 1: (2, 0, 5, "apache,gpl"), 2: (0, None, None, ""), 3: (1, 0, 0, "cc-by"), 4: (0, None, None, ""), 5: (0, None, None, ""),
                    6: (0, None, None, ""), 7: (2, 0, 2, "mit"), 8: (0, None, None, "")}
    assert got[6]["labels"] == "mit" and 0.9 < got[6]["score"] < 1 and got[0]["score"] == 1 and got[2]["score"] == 0
    assert [(s["label"], s["first_word"], s["last_word"], s["edits"]) for s in got[1]["spans"]] == [("gpl", 0, 3, 0), ("apache", 5, 6, 0), ("apache", 7, 8, 1)]


def test_pieces_find_every_edited_notice():
    rng = random.Random(12)
    scanner = licenses.Scanner(licenses.MORE)
    for k, notice in enumerate(licenses.MORE):
        for _ in range(30):
            text = list(notice.words)
            for _ in range(notice.edits):
                # inside a word, which stays one
                p = rng.choice([p for p in range(1, len(text) - 1) if " " not in text[p - 1:p + 2]])
                text[p:p + 1] = rng.choice([[], ["x"], [text[p], "y"]])
            whole = f"some words {''.join(text)} and more"
            assert any(n == k and e <= notice.edits for n, _, _, e in scanner.scan(" ".join(whole.split()))), whole


def test_languages(spark):
    rng = random.Random(13)
    syllables = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ein", "wer"], "cc": ["eau", "oux", "ité", "ien"]}
    talk = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    train = spark.createDataFrame([(talk(lang, 40), lang) for lang in syllables for _ in range(20)] + [("zzz", None), (None, "aa")], "text string, lang string")
    model = language.train(train)
    assert model.languages == ["aa", "bb", "cc"]
    rows = [(k, talk(lang, 30)) for k, lang in enumerate(syllables)] + [(3, f"{talk('aa', 60)} {talk('bb', 30)}"), (4, None), (5, "123 !!"), (6, ""), (7, "日本語"), (8, "é")]
    got = {r["doc_id"]: r for r in language.languages_of(table(spark, rows), model).collect()}
    assert [got[k]["lang_pred"] for k in range(4)] == ["aa", "bb", "cc", "aa"]
    assert [list(got[k]["languages"]) for k in range(3)] == [["aa"], ["bb"], ["cc"]]
    assert set(got[3]["languages"]) == {"aa", "bb"} and 0.55 < got[3]["score"] < 0.8
    assert [got[k]["lang_pred"] for k in (4, 5, 6)] == ["und"] * 3 and got[7]["lang_pred"] != "und" and got[8]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = language.train(train.limit(0))
    assert {r["lang_pred"] for r in language.languages_of(table(spark, rows), nothing).collect()} == {"und"}


def page(k, body, tail=""):
    return (f"<html><head><title>T{k}</title><script>var a='</p><p>no';</script></head><body><nav><a href='/{k}'>link{k}</a></nav>"
            f"<div class='cookie-notice'>We use cookies</div><article><h1>Head {k}</h1>{body}</article>{tail}<div id='comments'><p>nice {k}</p></div>"
            f"<footer>foot {k}</footer></body></html>")


def test_pages(spark):
    body = "<p>First  &amp; second<br>line</p><form>Mail <input></form><p>More <b>bold</b> t&eacute;xt &lt;tag&gt;"
    rows = [(k, f"https://a.example.com/{k}", page(k, body + f"<p>own {k}")) for k in range(12)]
    rows += [(50, "https://one.example.com", page(50, body)), (51, None, "plain words"), (52, "http://x.example.com", None), (53, "nonsense", ""),
             (54, "http://div.example.com/1", "<body><div id=menu>a b</div><div id=content><h2>Head</h2><p>Some long text here, quite long.<p>And more.</div></body>")]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "template": F.lit(1)})
    got = {r["page_id"]: r for r in templates.extract_pages(df).collect()}
    for k in range(12):
        assert got[k]["text"] == f"Head {k}\nFirst & second line\nMore bold téxt <tag>\nown {k}"
    assert got[50]["text"] == "Head 50\nFirst & second line\nMore bold téxt <tag>"
    assert got[51]["text"] == "plain words" and got[52]["text"] == got[53]["text"] == "" and got[54]["text"] == "Head\nSome long text here, quite long.\nAnd more."
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and templates.extract_pages(df).count() == len(rows)
    assert templates.extract_pages(df.limit(0)).count() == 0


WRAPPERS = [("<form id='aspnetForm'>", "</form>"), ("<div class='layout-sidebar'>", "</div>"), ("<div id='header-wrap'><div class='social-site'>", "</div></div>"),
            ("<header>", "</header>"), ("<main><div class='search-page'>", "</div></main>")]


def test_names_of_asides_around_and_in_articles(spark):
    """Article text stays whatever its wrappers and parts are named; asides of the template still go."""
    inner = ("<header class='entry-header'><h1>Head {k}</h1></header><div class='article-header'><p>By {k}</p></div><p>First {k}</p>"
             "<section id='related-work'><h2 class='social'>Related {k}</h2><p>Earlier {k}</p></section><div class='share-box'>Share {k}</div><p>Last {k}</p>"
             "<div id='comments'><article><p>nice {k}</p></article></div>")
    want = "Head {k}\nBy {k}\nFirst {k}\nRelated {k}\nEarlier {k}\nLast {k}"
    rows = []
    for w, (before, after) in enumerate(WRAPPERS):
        for k in range(10 * w, 10 * w + 10):
            rows.append((k, f"http://h{w}.example.com/{k}", f"<body><nav>n {k}</nav>{before}<article>{inner.format(k=k)}</article>{after}"
                         f"<aside><article>Teaser {k}</article></aside><footer>f {k}</footer></body>"))
    # no article element: a wrapper that holds most of the text is no aside
    rows += [(90, "http://w1.example.com", "<body><form id=f><div class=menu>a b</div><h1>Head</h1><p>Some long text here</form></body>"),
             (91, "http://w2.example.com", "<body><div class='page-with-sidebar'><p>Some long text here</p></div><div class=sidebar>c</div></body>"),
             (92, "http://w3.example.com", "<body><article><div class='notice'>Text of a page alone</div></article></body>")]
    got = {r["page_id"]: r["text"] for r in templates.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(10 * len(WRAPPERS)):
        assert got[k] == want.format(k=k), k
    assert got[90] == "Head\nSome long text here" and got[91] == "Some long text here" and got[92] == "Text of a page alone"


def test_template_is_the_shared_tokens(spark):
    rows = [(k, "http://a.example.com", page(k, f"<p>only {k}")) for k in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("a"))
    template = set(templates.host_templates(df).first()["template"])
    hashes = lambda *keys: set(templates.key_hash(list(keys)).view(np.int64).tolist())
    assert hashes("<nav", "<article", "</article", "=We use cookies") <= template and not hashes("=only 3", "=Head 3") & template


def test_all_slots_that_vary(spark):
    """Without an article element every varying slot is text, however the text is split; shared texts go on hosts of two pages, too."""
    rng = random.Random(5)
    post = ("<body><div class=top>Buy now</div><div class=post><h1>Head {k}</h1><div class=intro>{a}</div><div class=body>{b}</div></div>"
            "<div class=bottom>All rights reserved</div></body>")
    rows, want = [], {}
    for host, n in (("two", 2), ("many", 12)):
        for _ in range(n):
            k = len(rows)
            a, b = (" ".join(prose(rng, m, 4000).split()) for m in (20, 60))
            rows.append((k, f"http://{host}.example.com/{k}", post.format(k=k, a=a, b=b)))
            want[k] = f"Head {k}\n{a}\n{b}"
    # two pages that share a paragraph keep it; copies of one page keep their text
    for k in (100, 101):
        rows.append((k, f"http://near.example.com/{k}", f"<body><div class=top>Buy now</div><div class=post><p>Own {k}</p><p>In both</p></div></body>"))
        want[k] = f"Own {k}\nIn both"
        rows.append((k + 100, f"http://copy.example.com/{k}", "<body><form class=post><p>The same text</p></form></body>"))
        want[k + 100] = "The same text"
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in templates.extract_pages(df).collect()} == want


def test_classes_keep_their_order_and_nest(spark):
    """Tokens that every page has once, but in other orders, are no template; nor are classes that cross."""
    swapped = ["<div class=c><b class=x>{k}</b></div><i class=y>{k}</i>", "<i class=y>{k}</i><div class=c><b class=x>{k}</b></div>"]
    rows = [(k, "http://o.example.com", swapped[k % 2].format(k=k)) for k in range(4)]
    rows += [(k, "http://s.example.com", swapped[0].format(k=k)) for k in range(10, 14)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", templates.host_of(F.col("url")))
    got = {r["host"]: set(r["template"]) for r in templates.host_templates(df).collect()}
    hashes = set(templates.key_hash(["<div.c", "<b.x", "<i.y"]).view(np.int64).tolist())
    assert hashes <= got["s.example.com"] and not hashes & got["o.example.com"]
    assert templates.order_of([1, 2, 1, 2])[0] == [1, 2] and templates.order_of([1, 2, 2, 1]) is None
    # 0 encloses 1; 0 and 2 cross, and the smaller goes
    rank = [(3, 0), (2, -1), (2, -2)]
    assert templates.crossing([(0, 0), (1, 0), (1, 1), (0, 1), (0, 2)], {0: 3, 1: 2}, rank) == set()
    assert templates.crossing([(0, 0), (2, 0), (0, 1), (2, 1), (0, 2)], {0: 3, 2: 2}, rank) == {2}
    assert templates.crossing([(2, 0), (0, 0), (2, 1), (0, 1), (0, 2)], {0: 3, 2: 2}, rank) == {2}


def test_quality_model_learns_interactions():
    rng = np.random.default_rng(5)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (1, 0) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.95
    assert quality.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3
    assert (quality.fit(x, np.ones(3000)).score(x) > 0.99).all()


def test_quality_on_odd_tables(spark):
    rng = random.Random(3)
    good = [(k, prose(rng, 80)) for k in range(60)]
    bad = [(100 + k, " ".join(f"{w}###" for w in prose(rng, 80).split())) for k in range(60)]
    docs = table(spark, good + bad + [(300, None), (301, ""), (None, "x"), (0, good[0][1])])
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + bad] + [(None, 1, 0), (300, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.score_quality(docs, model)
    scores = {r["doc_id"]: r["score"] for r in got.collect()}
    assert got.count() == 124 and all(scores[i] > 0.7 for i, _ in good) and all(scores[i] < 0.3 for i, _ in bad)
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {i for i, _ in good}
    assert quality.score_quality(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0


def test_control_bytes_round_trip():
    rng = np.random.default_rng(1)
    n = np.array([1, 4, 5, 0, 17, 300])
    ranks = (2 ** rng.uniform(0, 32, int(n.sum()))).astype(np.uint32)
    control, data, size = token_ids.pack(ranks, n)
    assert token_ids.unpack(control, data, n).tolist() == ranks.tolist()
    assert len(control) == sum(-(-k // 4) for k in n) and size.sum() == len(data) < 4 * len(ranks)


def test_corpus_file_round_trip(spark, tmp_path, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    monkeypatch.setattr(token_ids, "BLOCK_IDS", 500)
    monkeypatch.setattr(token_ids, "SHARD_BYTES", 20_000)
    odd = ["It's the DOG's; we'll see: don't!?", "<|endoftext|> a<|startoftext|>b", "x'%s %'re 'T can't'", "naïve—café “quoted”. é K İstanbul ΣΑΣ", "a1b2 3.14 % é% %é", "日本 語。"]
    rows = corpus(11) + [(2000 + k, t) for k, t in enumerate(odd)]
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    for by_word in (True, False):
        folder = str(tmp_path / f"ids-{by_word}")
        token_ids.write_corpus(table(spark, rows), folder, queries.tokenizer_path(), end=2, by_word=by_word)
        got = token_ids.read_corpus(spark, folder).orderBy("start").collect()
        assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
        want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
        start = 0
        for r in got:
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes()))
            start += r["n_tokens"]
        ranks = [r["id"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()]
        seen = Counter(x for _, ids in want.elements() for x in ids)
        assert [seen[i] for i in ranks] == sorted((seen[i] for i in ranks), reverse=True)
    empty = str(tmp_path / "empty")
    token_ids.write_corpus(table(spark, rows).limit(0), empty, queries.tokenizer_path(), end=2)
    assert token_ids.read_corpus(spark, empty).count() == 0


def test_encoding_takes_little_memory_and_is_forgotten(spark):
    pytest.importorskip("tokenizers")
    import tracemalloc

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([f"call {k} was about the bridge. " * 20 for k in range(4000)])], ["text"])
    count = token_ids.count_ids(queries.tokenizer_path(), True, 2)
    tracemalloc.start()
    try:
        counted = next(count(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60 << 20 and counted.column(0).to_pylist()[-1] == -1
    known = token_ids.of_this_process(f"known {queries.tokenizer_path()}", token_ids.Known)
    assert len(known)
    assert list(token_ids.decoded(np.arange(9, dtype=np.uint32), False)(iter([]))) == [] and not len(known) and not known.used
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with token_ids.small_batches(spark):
        assert 0 < int(spark.conf.get(key)) <= token_ids.BATCH_ROWS
    assert spark.conf.get(key) == before


def test_the_library_gets_few_strings(monkeypatch):
    """New pieces of letters go to the library many in a string, and pieces that are found again are kept when there is no room for more."""
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    sent = []

    class Counting:
        def encode_batch_fast(self, strings, **options):
            sent.extend(strings)
            return library.encode_batch_fast(strings, **options)

    def check(text):
        data = np.frombuffer(text.encode(), np.uint8)
        ids, n = encoder.encode(data, np.array([0, len(data)]))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and n.tolist() == [len(want)]
        return data, want

    encoder = token_ids.Encoder(queries.tokenizer_path(), True)
    encoder.tokenizer = Counting()
    token_ids.forget_pieces()
    rng = random.Random(8)
    name = lambda: "".join(rng.choices("abcdefghijklmnoprstué", k=12))
    often = [name() for _ in range(300)]
    check(" ".join(often + [name() for _ in range(3000)]))
    assert 0 < len(sent) < 30
    # letters that the library takes apart or doesn't know as letters, and other pieces among them
    data, want = check("क़ख़ \u0958\u0959 İstanbul ﬁne ΣΑΣ ªº \u0345 日本語 x\u00a0y 3 a1 it's café. \U0001e900\U0001e922 \u1c89\u1c8a a\u1c89 e\u0301t\u0301 \ufb1d")
    assert encoder.count(data, np.array([0, len(data)]), 60_000).tolist() == np.bincount(want, minlength=60_000).tolist()
    assert not encoder.count(data[:0], np.array([0, 0]), 9).any()
    monkeypatch.setattr(token_ids, "KNOWN_PIECES", 1000)
    token_ids.forget_pieces()
    for k in range(20):
        sent.clear()
        check(" ".join(often + [name() for _ in range(100)]))
        assert len(token_ids.of_this_process(encoder.name, token_ids.Known)) <= 1000
        assert set(often) & {w for s in sent for w in s.split()} == (set() if k else set(often))
    token_ids.forget_pieces()


def test_span_hashes_tell_spans_apart():
    rng = np.random.default_rng(3)
    spans = [bytes([k]) * n for k in (0, 1, 97) for n in range(1, 140)] + [rng.bytes(n) for n in range(9, 140)]
    spans += [b"a" * 70 + b"b" + b"a" * n for n in range(9)] + [b"\0a", b"a\0"]
    places = [*range(len(spans)), *rng.permutation(len(spans))]
    data = np.frombuffer(b" ".join(spans[k] for k in places), np.uint8)
    size = np.array([len(spans[k]) for k in places])
    end = np.cumsum(size + 1) - 1
    hashes = token_ids.span_hashes(data, end - size, end)
    assert len(set(spans)) == len(set(hashes.tolist())) == len({(spans[k], h) for k, h in zip(places, hashes.tolist(), strict=True)})
    found, some, back = token_ids.distinct(hashes)
    assert found.tolist() == sorted(set(hashes.tolist())) and (found[back] == hashes).all() and (hashes[some] == found).all()
