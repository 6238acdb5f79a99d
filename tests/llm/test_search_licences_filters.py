"""Lexical search, licence scan and filter audit against brute force on small
tables, with nulls, empty and long texts, ties, repeated rows, empty tables
and extra columns."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmscope.llm import filteraudit, lexical, licences

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, rank int, n long, mask int, part string, item string, key int"  # extra columns with clashing names


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 2, 3, "x", "y", 4) for i, t, lang in rows], DOCS)


# ------------------------------------------------------------------ lexical search
def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t, _ in docs if terms(t)]
    n_docs, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        if i is not None:
            wanted[i] |= set(terms(t))
    out = []
    for item, own in wanted.items():
        found = []
        for i, c in held:
            m = 10 + 90 * c.total() * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=lambda x: x[:2])


def search_corpus(seed=4, n=700):
    rng = random.Random(seed)
    word = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(4000)] + ["É", "漢字", "Straße", "a1"]
    text = lambda size: rng.choice([" ", "-", "\x7f", "_"]).join(rng.choice(word) for _ in range(size))
    docs = [(i, text(rng.randint(1, 60)), "en") for i in range(n)]
    docs += [(1000 + i, docs[3][1], "en") for i in range(30)] + [(3, docs[3][1], "en"), (3, docs[4][1], "de"), (None, docs[3][1], None), (None, docs[5][1], None)]
    docs += [(2000, None, "en"), (2001, "", "en"), (2002, " -_! ", "en"), (2003, "w1 " * 40_000 + "rare", "en"), (2**63 - 1, docs[3][1].upper(), "en")]
    items = [(i, text(rng.randint(1, 30))) for i in range(60)] + [(100, docs[3][1]), (101, None), (102, ""), (103, "absent words"), (None, "w1"), (5, "w2 w3"), (104, "W1 w1"), (105, "rare")]
    return docs, items


@pytest.mark.parametrize("block_terms", [lexical.BLOCK_TERMS, 200])
def test_search_equals_brute_force(spark, block_terms):
    docs, items = search_corpus()
    benchmark = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, number int, block int")
    got = lexical.search(table(spark, docs), benchmark, 10, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got.collect()), key=lambda x: x[:2])
    assert rows == brute_search(docs, items, 10)


def test_search_of_empty_tables_and_text_ids(spark):
    docs, items = search_corpus(n=20)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(table(spark, docs).where("false"), benchmark).count() == 0
    assert lexical.search(table(spark, docs), benchmark.where("false")).count() == 0
    named = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical.search(table(spark, docs), named, 3).collect()), key=lambda x: (int(x[0]), x[1]))
    assert got == [(str(a), *rest) for a, *rest in brute_search(docs, items, 3)]


def test_node_pairs_are_pruned_without_loss():
    rng = np.random.default_rng(3)
    width, n, k = 300, 2000, 5
    weights = rng.integers(1, 9000, width)
    rows = [np.sort(rng.choice(width, rng.integers(1, 12), replace=False, p=(p := 1 / np.arange(1, width + 1)) / p.sum())) for _ in range(n)]
    impacts = [rng.integers(1, 1_000_000, len(r)) for r in rows]
    items = [sorted(rng.choice(width, 6, replace=False).tolist()) for _ in range(37)]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    best = lexical.Best(k, np.zeros(len(items), np.int64))
    scored = lexical.search_trees(lexical.Queries(items, weights), lexical.Documents(starts, np.concatenate(rows), np.concatenate(impacts), np.array([x.max() for x in impacts]), width), best, np.zeros(n, np.int64), np.arange(n))
    dense = np.zeros((n, width), np.int64)
    for i, (r, x) in enumerate(zip(rows, impacts)):
        dense[i, r] = x
    for i, own in enumerate(items):
        score = dense[:, own] @ weights[own]
        want = sorted((-s, d) for d, s in enumerate(score.tolist()) if s > 0)[:k]
        assert [(-s, d) for s, d in zip(best.top[i][0].tolist(), best.top[i][2].tolist())] == want
    assert scored < n * len(items) / 4  # whole batches are dropped


# ------------------------------------------------------------------ licences
def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_licences(texts, templates):
    docs = [words(t) for t in texts]
    idf = lambda w: math.log((len(docs) + 1) / (sum(w in d for d in docs) + 1))
    rare = []
    for t in templates:
        own = set(t.text.split())
        rare.append(set(sorted(own, key=lambda w: (-idf(w), w))[: max(licences.INDEX_LEAST, math.ceil(licences.INDEX_SHARE * len(own)))]))
    out = []
    for d in docs:
        named = [(i, label) for p, label in licences.PHRASES.items() for i in range(len(d)) if d[i : i + len(p.split())] == p.split()]
        found = []
        for t, index in zip(templates, rare):
            own = t.text.split()
            votes = Counter(i - q for i, w in enumerate(d) if w in index for q, x in enumerate(own) if x == w)
            for at, n in votes.items():
                keys = [k.split() for k in t.keys]
                spots = [next(q for q in range(len(own)) if own[q : q + len(k)] == k) for k in keys]
                near = lambda k, q: any(at + q + s >= 0 and d[at + q + s : at + q + s + len(k)] == k for s in range(-licences.DRIFT, licences.DRIFT + 1))  # noqa: B023, E731
                if n >= 2 and all(near(k, q) for k, q in zip(keys, spots)):
                    found.append((t.label, at, sum(0 <= at + q < len(d) and d[at + q] == w for q, w in enumerate(own)) / len(own)))
        out.append((len(d), sorted(named), sorted(found)))
    return out


def licence_texts():
    rng = random.Random(8)
    filler = lambda n: " ".join(rng.choice("the of to and is work file use person free lorem ipsum dolor é漢 42".split()) for _ in range(n))
    mit, gpl, bsd = licences.TEMPLATES[1].text, licences.TEMPLATES[5].text, licences.TEMPLATES[10].text
    texts = [filler(rng.randint(0, 80)) for _ in range(40)]
    texts += [f"{filler(20)}\n{t.text.upper()}. {filler(9)}" for t in licences.TEMPLATES]
    texts += [
        None, "", " ,;\x00 ", "MIT-License", "mit license mit license", "cc by cc by cc by", "ccby mit licenses",
        f"{mit} {filler(3)} {gpl}", bsd.replace("in source", "in the source"), bsd[:60], " ".join(reversed(bsd.split())), "GNU general PUBLIC license, apache License!",
        "İ mit license K", filler(30_000) + " " + gpl + " " + filler(10), "license " * 20_000, (mit + " ") * 200,
    ]
    return texts


def test_licences_equal_brute_force(spark):
    texts = licence_texts()
    docs = table(spark, [(i, t, "en") for i, t in enumerate(texts)])
    scanned = licences.scan(docs, licences.build_index(docs))
    rows = {r.doc_id: r for r in scanned.collect()}
    for i, (n, named, found) in enumerate(brute_licences(texts, licences.TEMPLATES)):
        r = rows[i]
        assert r.n_words == n and sorted(tuple(x) for x in r.named) == named, i
        assert sorted((x.label, x.start, round(x.share, 9)) for x in r.verified) == [(a, b, round(c, 9)) for a, b, c in found], i
    by_label = {t.label for t in licences.TEMPLATES}
    assert {x.label for r in rows.values() for x in r.verified} == by_label


def test_licence_report(spark):
    mit = licences.TEMPLATES[1].text
    rows = [(1, None, "en"), (1, "Released under the MIT License.", "en"), (2, f"x {mit}", None), (None, "a cc by b, cc by", "en"), (3, "nothing here", "en"), (4, "Licensed under CC BY-NC 4.0.", "en")]
    docs = table(spark, rows + [(5, "mit license", "en")] * 2)
    out = licences.report(licences.scan(docs, licences.build_index(docs)))
    got = [tuple(r) for r in out.collect()]
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert (1, 0, 0, None, None, "", "", 0.0) in got
    assert (1, 5, 1, 3, 3, "mit", "mit", 1.0) in got
    assert (2, len(mit.split()) + 1, 0, None, None, "", "mit", 1.0) in got
    assert (None, 6, 2, 1, 4, "cc-by", "cc-by", 0.5) in got
    assert (4, 7, 1, 2, 2, "cc-by", "cc-by,cc-by-nc", 1.0) in got
    assert got.count((5, 2, 1, 0, 0, "mit", "mit", 0.5)) == 2
    none = docs.where("false")
    assert licences.report(licences.scan(none, licences.build_index(none))).count() == 0
    assert licences.report(licences.scan(docs, [])).count() == len(got)


def test_licence_scan_uses_no_python_workers(spark):
    docs = table(spark, [(1, "mit license", "en")])
    plan = licences.report(licences.scan(docs, licences.build_index(docs)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# ------------------------------------------------------------------ filter audit
def brute_masks(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = defaultdict(Counter)
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        mask = ("A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t))
                + "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (i is not None and least[t] < i))
        out[lang or ""][mask, i in good, i in toxic] += 1
    return out


def brute_audit(docs, labels):
    rows = []
    for part, masks in brute_masks(docs, labels).items():
        own, shapley = [], Counter()
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                here = [(m, g, x, n) for (m, g, x), n in masks.items() if f in m and not set(order[: step - 1]) & set(m)]
                removed = sum(n for *_, n in here)
                kept = sum(n for (m, _, _), n in masks.items() if not set(order[:step]) & set(m))
                shapley[f] += removed
                own.append([part, "".join(order), step, kept, removed, sum(n for (m, _, _), n in masks.items() if f in m) - removed,
                            sum(n for (m, _, _), n in masks.items() if m == f), sum(n for _, g, _, n in here if g), sum(n for _, _, x, n in here if x)])
        rows += [(*r, shapley[r[1][r[2] - 1]]) for r in own]
    return sorted(rows)


def filter_corpus():
    rng = random.Random(6)
    docs = []
    for i in range(400):
        w = [rng.choice("ab cd ef gh ij kl mn é漢 op qr st uv".split()) + (str(rng.randint(0, 300)) if rng.random() < 0.9 else "") for _ in range(rng.choice([10, 199, 200, 250]))]
        if rng.random() < 0.3:
            w = w[:5] * (len(w) // 5)
        if rng.random() < 0.3:
            w = [x.upper() if rng.random() < 0.1 else x for x in w]
        if rng.random() < 0.2:
            w.append(rng.choice("#$%&*|!"))
        docs.append((i, rng.choice([" ", "\n", "\x0b", "\x1c "]).join(w), rng.choice(["en", "de", None, ""])))
    docs += [(rng.randint(0, 500), docs[rng.randint(0, 20)][1], rng.choice(["en", "fr"])) for _ in range(150)]
    docs += [(None, docs[0][1], "en"), (None, docs[0][1], None), (600, None, "en"), (601, "", "en"), (602, " ", "de"), (7, docs[7][1], "en"), (603, "word " * 30_000, "xx"), (604, "\x00é", "xx")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 0, 1])) for i in range(0, 500, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_filter_audit_equals_brute_force(spark):
    docs, labels = filter_corpus()
    known = spark.createDataFrame([(i, q, x, 7, 8) for i, q, x in labels], "doc_id long, quality int, toxic int, key int, n int")
    out = filteraudit.audit(filteraudit.failures(table(spark, docs), known))
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in out.collect()) == brute_audit(docs, labels)


def test_filter_audit_of_empty_tables(spark):
    docs, labels = filter_corpus()
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert filteraudit.audit(filteraudit.failures(table(spark, docs).where("false"), known)).count() == 0
    got = filteraudit.audit(filteraudit.failures(table(spark, docs[:50]), known.where("false"))).collect()
    assert sorted(tuple(r) for r in got) == brute_audit(docs[:50], [])


def test_intervals_cover_every_order_once():
    orders = list(permutations(range(5)))
    assert [filteraudit.lehmer_rank(o) for o in orders] == list(range(120))
    for mask in range(1, 32):
        step_of = {}
        for m, step, begin, end in filteraudit.intervals():
            if m == mask:
                for rank in range(begin, end):
                    assert rank not in step_of
                    step_of[rank] = step
        assert step_of == {r: 1 + next(s for s, f in enumerate(o) if mask >> f & 1) for r, o in enumerate(orders)}


@pytest.mark.parametrize("name", ["op11_search", "op12_licences", "op13_interaction"])
def test_queries_equal_their_sql(spark, name):
    from oracle_harness import compare

    from firmscope.llm.oracles import ORACLE
    from firmscope.llm.queries import QUERIES

    result = compare(QUERIES[name](spark, SF), ORACLE[name], SF)
    assert result["ok"], result


def test_licence_query_equals_brute_force(spark):
    from firmscope.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {}
    for (i, _), (n, named, found) in zip(docs, brute_licences([t for _, t in docs], licences.TEMPLATES)):
        base = {b for _, b in named}
        starts = [s for s, _ in named]
        score = max([x for *_, x in found] + [0.5] * bool(named), default=0.0)
        want[i] = (n, len(named), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x for x, *_ in found})), score)
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_licences"](spark, SF).collect()}
    assert got == want
