"""Every contract column of the queries over whole tables, the classifiers'
arithmetic, and what the span models add, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import DOCS, ODD, SF, brute_cut, brute_secrets, table

from firmscope.llm import langid, pii, quality, secretscan
from firmscope.llm.queries import QUERIES

MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def listed(spans, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in spans)


# ------------------------------------------------------------------ op1, op7
def brute_personal(t):
    t = t or ""
    digits = lambda v: re.sub("[^0-9]", "", v)

    def luhn(d):
        return sum((x - 9 if x > 9 else x) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0

    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_op1_columns(spark, texts):
    rows = QUERIES["op1_secrets"](spark, MID).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = [(k, a, b) for a, k, b in brute_secrets(texts[r.doc_id])]
        counts = Counter(k for k, _, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (counts[0], counts[1], counts[2])
        assert r.base_sha256 == sha(listed(base, secretscan.KINDS))
        every = r.spans.split(",") if r.spans else []
        assert [s for s in every if not s.startswith("random:")] == [s for s in listed(base, secretscan.KINDS).split(",") if s]
        assert [int(s.split(":")[1]) for s in every] == sorted(int(s.split(":")[1]) for s in every)
    assert sum(r.n_hex + r.n_assign + r.n_access for r in rows) == sum(len(brute_secrets(t)) for t in texts.values())


def test_op7_columns(spark, texts):
    rows = QUERIES["op7_pii"](spark, MID).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = brute_personal(texts[r.doc_id])
        counts = Counter(k for k, _, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in range(4))
        assert r.base_sha256 == sha(listed(base, pii.KINDS))
        own = [s for s in (r.spans.split(",") if r.spans else []) if not s.startswith(("email_like:", "number_like:"))]
        assert ",".join(own) == listed(base, pii.KINDS)
    assert any(r.n_email for r in rows) and any(r.n_ip for r in rows)


# what no training template writes: other brackets, words for the signs, other grouping
PLANTED_PII = [
    "write to ana.lopez <at> kern <dot> net today", "or ana_lopez{at}kern{dot}net there", "mail bo.lind (at) post.example for more", "reach m-ruiz@ host.example now",
    "phone 030 123 4567 89 please", "tel 0049-30-1234567 in Berlin", "call (030) 1234-5678 soon", "fax 212/555/0187 or", "card 5500 0000/0000 0004 used", "visa 4012-8888.8888-1881 there", "mobile 0171.555.0199 works",
]
ORDINARY = ["between 10.5 and 12.75 per cent", "isbn 978-3-16-148410 is", "room 4.02.117 upstairs", "on 3/12/1998 at noon", "score 3-2, 4-1, 5-0 in", "he paid 12 500 000 for", "see page 12-14, 18-20 of", "version 10.2.33-4 came", "look @ the map. Then go"]


def test_what_the_boosted_trees_add_on_planted_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = pii.fit(pii.labelled_proposals(docs))
    rows = {r.doc_id: r for r in pii.scan(table(spark, list(enumerate(PLANTED_PII + ORDINARY))), model).collect()}
    more = [len(rows[i].spans) > len(rows[i].base) for i in range(len(rows))]
    recall, wrong = np.mean(more[: len(PLANTED_PII)]), np.mean(more[len(PLANTED_PII) :])
    print(f"pii: planted spans of other forms found {recall:.2f}, ordinary texts marked {wrong:.2f}, thresholds {model.thresholds}")
    assert wrong <= 0.35 and recall >= 0.3


def planted_secrets(n=300, seed=12):
    rng = random.Random(seed)
    letters, digits = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    # alphabets and joints that no digest of the training sample has
    forms = [lambda: "".join(rng.choice(letters) for _ in range(32)), lambda: "".join(rng.choice(letters[:26] + digits) for _ in range(36)), lambda: "sk_live_" + "".join(rng.choice(letters + digits) for _ in range(24)),
             lambda: "-".join("".join(rng.choice(letters[26:] + digits) for _ in range(5)) for _ in range(5)), lambda: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(24))]
    names = "user account service handler request response client server manager factory builder index table query result value option default config message".split()
    plain = [lambda: "_".join(rng.choice(names) for _ in range(5)), lambda: "".join(rng.choice(names).title() for _ in range(4)), lambda: "/".join(rng.choice(names) for _ in range(4)), lambda: "-".join(rng.choice(names) for _ in range(4))]
    return [rng.choice(forms)() for _ in range(n)], [rng.choice(plain)() + "Value" for _ in range(n)]


def test_what_the_markov_models_add_on_planted_tokens(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    ratios = secretscan.train(secretscan.labelled_sample(docs))
    secrets, plain = planted_secrets()
    rows = {r.doc_id: r for r in secretscan.scan(table(spark, [(i, f"see {t} there") for i, t in enumerate(secrets + plain)]), ratios).collect()}
    found = [len(rows[i].spans) > 0 for i in range(len(rows))]
    recall, wrong = np.mean(found[: len(secrets)]), np.mean(found[len(secrets) :])
    print(f"secrets: planted keys of other forms found {recall:.2f}, identifiers marked {wrong:.2f}")
    assert recall > 0.7 and wrong < 0.1


# ------------------------------------------------------------------ op2
def test_op2_columns(spark, texts):
    rows = QUERIES["op2_quality"](spark, MID).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_quality_scores_follow_from_ratios_and_weights(spark):
    """Ratios by counting, the optimum of the hinge loss by its conditions, and scores by hand."""
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 60, rng.integers(1, 15))) for _ in range(120)]
    labels = np.array([int((r < 30).mean() + rng.normal(0, 0.2) > 0.5) for r in rows])
    ratios = quality.log_count_ratios(rows, labels)
    size = 1 << quality.BITS
    for wanted, sign in ((1, 1), (0, -1)):
        counts = Counter(int(s) for r, y in zip(rows, labels) if y == wanted for s in r)
        total = sum(counts.values()) + size
        log_p = {s: np.log((counts[s] + 1) / total) for s in range(70)}
        if sign == 1:
            good = log_p
    np.testing.assert_allclose([ratios[s] for s in range(70)], [good[s] - log_p[s] for s in range(70)], rtol=1e-12)
    values = [quality.scaled(ratios[r]) for r in rows]
    cost = np.full(len(rows), 1.0)
    w, b = quality.dual_coordinate_descent(rows, values, labels, cost, epochs=3000, tolerance=1e-10)
    y = np.where(labels == 1, 1.0, -1.0)

    def loss(w, b):
        margins = np.array([w[r] @ v + b for r, v in zip(rows, values)])
        return 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - y * margins)).sum()

    best = loss(w, b)
    for _ in range(200):
        step = np.zeros(size)
        step[:60] = rng.normal(0, 10.0 ** rng.integers(-4, 1), 60)
        assert loss(w + step, b + rng.normal(0, 0.01)) >= best - 1e-6
    model = quality.fit_rows(rows, labels)
    text = "some words and more words, 12 of them"
    slots = quality.indicators(text)
    x = model.ratios[slots] / np.sqrt((model.ratios[slots] ** 2).sum() + quality.DAMPING)
    assert model.score(text) == pytest.approx(1 / (1 + np.exp(-(model.slope * (model.weights[slots] @ x + model.intercept) + model.shift))))


def test_quality_fit_holds_no_second_copy_of_its_rows():
    """Counting goes by few rows at a time; the order of the rows follows from hash, label and content."""
    import tracemalloc

    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(1 << quality.BITS, 4000, replace=False)).astype(np.int32) for _ in range(1200)]
    labels = np.arange(len(rows)) % 2
    tracemalloc.start()
    quality.log_count_ratios(rows, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 18e6  # the rows of one label take 19.2 MB as whole numbers
    few = [np.array(x, np.int32) for x in ([5], [4], [4, 9], [1], [], [4])]
    at, label = np.array([7, 7, 7, -2, 7, 7]), np.array([1, 0, 0, 1, 0, 1])
    keys = [(int(a), int(y), r.tobytes()) for a, y, r in zip(at, label, few)]
    assert quality.settled(at, label, few) == sorted(range(6), key=keys.__getitem__)


# ------------------------------------------------------------------ op6
def brute_profile(texts, size):
    counts = Counter()
    for t in texts:
        for word in re.findall(r"[^\W\d_]+", t.lower()):
            padded = f" {word} "
            counts.update(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n].strip() and not (n > 1 and " " in padded[i + 1 : i + n - 1]) and padded[i : i + n] != " ")
    code = lambda g: sum((1 if c == " " else ord(c)) << (21 * i) for i, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:size]


def test_op6_columns_and_out_of_place_distances(spark):
    rows = {r.doc_id: r for r in QUERIES["op6_langid"](spark, SF).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(rows) == set(docs)
    taught = {}
    for i, d in docs.items():
        if d.lang is not None and not held(i):
            taught.setdefault(d.lang, []).append(d.text)
    profiles = {lang: brute_profile(t, langid.PROFILE_SIZE) for lang, t in taught.items()}
    for i, d in docs.items():
        own = brute_profile([d.text], langid.PROFILE_SIZE)
        away = {}
        for lang, p in profiles.items():
            place = {g: r for r, g in enumerate(p)}
            away[lang] = sum(abs(place[g] - r) if g in place else langid.PROFILE_SIZE for r, g in enumerate(own))
        best = min(sorted(away), key=away.get)
        r = rows[i]
        assert r.held_out == held(i) and r.lang_pred == best and r.score == pytest.approx(1 - away[best] / (langid.PROFILE_SIZE * len(own)))


# ------------------------------------------------------------------ op9
def test_op9_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # a common line of 20 bytes between different neighbours, in every document
    rng = random.Random(2)
    junk = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    more = [(10_000 + i, f"{junk(40)}\n-- read the terms --\n{junk(40)}" + (docs.first().text if i % 9 == 0 else "")) for i in range(150)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame([*more, (20_000, None)], "doc_id long, text string"))
    every.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in QUERIES["op9_suffix"](spark, str(tmp_path)).collect()}
    want = brute_cut([(r.doc_id, r.text) for r in every.collect()])
    assert set(rows) == {i for i, *_ in want}
    for i, n, spans, kept in want:
        r = rows[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, sum(b - a for a, b in spans), len(spans), sha(kept))


# ------------------------------------------------------------------ the pipeline on odd tables
def test_pipeline_stages_on_odd_and_empty_tables(spark):
    import corpus_pipeline as C

    kind = "doc_id long, text string, lang string, source string, n_chars int, key int, row string, text_hash long"  # extra columns with clashing names
    odd = [(None if i == "null" else i, t, None, None, len(t or ""), 1, "r", 2) for i, t in ODD]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, kind)
        for name, stage in C.STAGES:
            out = stage(spark, docs, SF)
            if name != "tokens":
                assert out.columns == C.COLUMNS, name
            n = out.count()
            assert n <= len(rows) and (rows or n == 0)
    assert DOCS


def test_word_counts_and_ascii_lower_case(spark):
    from firmscope.llm import decontaminate
    from firmscope.llm.shared import ascii_lower

    texts = [None, "", " -- ", "A", "a B9 c", "É x", "Straße-İK \x00 Ünï_c0de", "ONE two\nTHREE" * 50, "漢 😀 A"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    for i, low, n, made in df.select("i", ascii_lower(F.col("t")), decontaminate.word_count(F.col("t")), F.size(decontaminate.words(F.col("t")))).collect():
        t = texts[i]
        assert low == (None if t is None else lower(t))
        assert n == made == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or "")))


def test_long_text_teaches_by_a_bounded_part_of_the_whole():
    slots = np.arange(100_000)
    own = quality.teaching(slots)
    assert len(own) == quality.ROW_INDICATORS and len(set(own.tolist())) == len(own) and (np.diff(own) > 0).all()
    # from all over, and the same ones each time
    assert np.histogram(own, 10, (0, 100_000))[0].min() > quality.ROW_INDICATORS / 20 and (own == quality.teaching(slots)).all()
    assert (quality.teaching(slots[:50]) == slots[:50]).all()
