"""Operators 11 to 13 against brute force, on random and hostile rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from cladeworks.llm import lexical, periodic, queries, toxicity
from tests.llm.fixtures import DOCS, docs

SMALL = "/root/testdata/sf0.001"


def brute_runs(words, least=12):
    """(start, end, period) of all maximal stretches, by trying every period at every place."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in found.items())


def random_words(rng):
    n, letters, words = rng.choice([0, 1, 11, 12, 13, 40, 150, 300]), rng.choice([1, 2, 3, 6, 1000]), []
    if rng.random() < 0.4:
        return [str(rng.randrange(letters)).encode() for _ in range(n)]
    while len(words) < n:
        part = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 5, 6, 7, 8, 9, 15, 16, 17, 33, 64]))]
        words += part * rng.randint(1, 6) + part[: rng.randint(0, len(part))] + [rng.randrange(letters) for _ in range(rng.randint(0, 5))]
    return [str(w).encode() for w in words]


@pytest.mark.parametrize("seed", range(6))
def test_runs_on_a_shared_grammar_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(12):
        texts = [random_words(rng) for _ in range(rng.randint(1, 6))]
        for words, found in zip(texts, periodic.Batch(texts).runs(12)):
            assert [tuple(r) for r in found.tolist()] == brute_runs(words)


def test_runs_of_fibonacci_words_and_one_word_over_and_over():
    short, long = [b"a"], [b"a", b"b"]
    while len(long) < 600:
        short, long = long, long + short
    texts = [long, [b"a"] * 5000, [b"a", b"b", b"a"] * 700]
    fib, ones, threes = periodic.Batch(texts).runs(12)
    assert [tuple(r) for r in fib.tolist()] == brute_runs(long)
    assert ones.tolist() == [[0, 5000, 1]] and threes.tolist() == [[0, 2100, 3]]


def test_without_rules_nothing_is_lost_and_with_rules_the_boundaries_shrink(monkeypatch):
    """The runs come from the boundaries of the grammar: both its rules and the symbols that are left find their part."""
    words = [str(w).encode() for w in ([7, 8, 9] * 40 + list(range(100, 160))) * 3]
    whole = periodic.Batch([words]).runs(12)[0].tolist()
    monkeypatch.setattr(periodic, "ROUNDS", 0)
    assert periodic.Batch([words]).runs(12)[0].tolist() == whole
    monkeypatch.undo()
    monkeypatch.setattr(periodic, "across", lambda *a: (periodic.np.empty(0, "int64"),) * 4)
    assert periodic.Batch([words]).runs(12)[0].tolist() == []


def looped_words(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected_digests(doc_id, text):
    words = looped_words(doc_id, text)
    runs = brute_runs(words)
    drop = {i for s, e, q in runs for i in range(s + q, e)}
    top = min(((s - e, s, q) for s, e, q in runs), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    four = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *four, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_periodic_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 6000").select("doc_id", "text")
    got = {tuple(r) for r in queries.op11_periodic_runs(spark, SMALL).collect()}
    for r in rows.collect():
        assert expected_digests(r.doc_id, r.text) in got
    assert len(got) == 200 and sum(r[1] > 0 for r in got) > 5


def test_periodic_runs_on_hostile_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns, an empty table."""
    rows = [*DOCS, (100, "go round " * 30, "en"), (100, "go round " * 30, "en"), (101, "x" * 2_000_000, "en"), (102, "word " * 200_000, "en")]
    got = sorted(periodic.periodic_runs(docs(spark, rows)).collect(), key=str)
    assert len(got) == len(rows)
    want = {(i, tuple(brute_runs((t or "").encode().split()))) for i, t, _ in rows if len(t or "") < 20_000}
    found = {(r.doc_id, tuple((x.start, x.start + x.length, x.period) for x in r.runs)) for r in got}
    assert want <= found and (102, ((0, 200_000, 1),)) in found
    assert {r.text for r in got if r.doc_id in (100, 102)} == {"go round", "word"}
    assert periodic.periodic_runs(docs(spark, []), together=1).collect() == []
    assert {(r.doc_id, r.text) for r in periodic.periodic_runs(docs(spark, rows), together=1).collect()} == {(r.doc_id, r.text) for r in got}
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs(spark), least=5)


# --- toxicity


def test_held_out_toxic_texts_are_caught_and_clean_ones_left_alone(spark):
    found = queries.op12_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = found.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 100 and sum((r.toxic == 1) == (r.predicted == 1) for r in rows) > 0.95 * len(rows)
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.02 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows) and found.count() == 1000


FILLER = [f"filler{i}" for i in range(60)]


def biased_texts(n=600):
    """Insults stand beside some groups' names far more often than neutral words do."""
    rng, texts, toxic = random.Random(5), [], []
    for i in range(n):
        bad = i % 3 == 0
        words = rng.choices(FILLER, k=12)
        if bad:
            words.insert(3, rng.choice(["vile", "filth"] if rng.random() < 0.6 else FILLER))
        if rng.random() < (0.7 if bad else 0.08):
            words.insert(5, rng.choice(["muslim", "gay", "women"]))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, toxic


def test_the_counterfactual_term_lowers_false_alarms_on_neutral_mentions():
    texts, toxic = biased_texts()
    plain, fair = toxicity.fit(texts, toxic, counterfactual=0.0), toxicity.fit(texts, toxic, counterfactual=20.0)
    rng = random.Random(9)
    gaps = []
    for _ in range(60):
        neutral = " ".join(rng.choices(FILLER, k=12))
        gaps.append([model.judge(f"{neutral} muslim", {}) - model.judge(neutral, {}) for model in (plain, fair)])
    assert sum(g[1] for g in gaps) < 0.5 * sum(g[0] for g in gaps)
    swaps = [abs(model.judge("filler1 muslim", {}) - model.judge("filler1 hindu", {})) for model in (plain, fair)]
    assert swaps[1] < 0.3 * swaps[0]
    assert fair.judge("filler1 filler2 vile filler3", {}) > 0.85 > fair.judge("filler1 filler2 filler3", {})


def test_a_swap_stays_within_a_kind_and_comes_round():
    words = "a muslim and two women met".split()
    assert toxicity.swapped(words, 1) == "a jewish and two men met".split() and toxicity.swapped(words, 0) == "a and two met".split()
    for terms in toxicity.IDENTITY_TERMS.values():
        for w in terms:
            assert {toxicity.swapped([w], t)[0] for t in range(1, len(terms) + 1)} == set(terms)
            assert toxicity.swapped([w], len(terms)) == [w]


def test_the_fit_ends_where_the_loss_has_no_slope():
    """The optimality conditions of both L1 terms, by finite differences of the loss."""
    texts, toxic = biased_texts(90)
    model = toxicity.fit(texts, toxic, counterfactual=3.0, sparsity=2e-3, steps=3000)
    found = [dict(zip(*toxicity.features(toxicity.words_of(t)))) for t in texts]
    pairs = [toxicity.difference(toxicity.features(toxicity.swapped(toxicity.words_of(t), k)), toxicity.features(toxicity.words_of(t))) for t in texts for k in (0, 1, 2, 3) if any(w in toxicity.KIND for w in t.split())]
    n1 = sum(toxic)

    def loss(weights):
        value = 0.0
        for f, y in zip(found, toxic):
            z = model.offset + sum(weights.get(int(k), 0.0) * v for k, v in f.items())
            value += (0.5 / n1 if y else 0.5 / (len(texts) - n1)) * (math.log1p(math.exp(z)) - y * z)
        return value + 3.0 * sum(sum(weights.get(int(k), 0.0) * v for k, v in zip(*p)) ** 2 for p in pairs) / len(pairs)

    for feature, w in list(model.weights.items())[:12]:
        up, down = dict(model.weights), dict(model.weights)
        up[feature], down[feature] = w + 1e-5, w - 1e-5
        slope = (loss(up) - loss(down)) / 2e-5
        assert slope == pytest.approx(-2e-3 if w > 0 else 1e-2, abs=4e-4)


def test_toxicity_on_hostile_rows(spark):
    model = toxicity.fit(*biased_texts(90))
    rows = [*DOCS, (200, "vile " + "filler1 " * 100_000, "en"), (200, "vile " + "filler1 " * 100_000, "en")]
    got = toxicity.score(docs(spark, rows), model).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    for r in got:
        assert any(r.score == pytest.approx(1 / (1 + math.exp(-model.judge(t, {})))) for i, t, _ in rows if i == r.doc_id)
    assert toxicity.score(docs(spark, []), model).collect() == []
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(14)] + [(None, 1, "x"), (3, None, "x"), (4, 7, "x")], "doc_id long, toxic int, text string")
    for own, marks in ((docs(spark, []), labels), (docs(spark), labels.where("false"))):
        none = toxicity.train(own, marks)
        assert none.weights == {} and none.offset == -1.0
    assert toxicity.fit(["a", "b"], [1, 1]).offset > 0
    assert isinstance(toxicity.train(docs(spark), labels, longest=100).offset, float)
    first, again = toxicity.train(docs(spark), labels, sample=6), toxicity.train(docs(spark).repartition(5), labels, sample=6)
    assert first == again


# --- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_search(rows, items, k=20):
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in rows]
    n, total = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(x for _, t in terms for x in set(t))
    out = []
    for item, text in items:
        scored = []
        for doc, own in terms:
            tf = Counter(own)
            score = 0
            for x in TERM.findall((text or "").translate(LOWER)):
                if tf[x]:
                    m = 100 - 25 + (25 * len(own) * n) // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1000000000 * tf[x]) // (1000 * tf[x] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


ITEMS = [(1, "the cat word12 Ünïcode"), (2, None), (3, ""), (4, "sat SAT sat mat"), (5, "zzz nowhere"), (6, "word3 word17 word200"), (6, "mat"), (None, "here no id"), (7, "!!! ???")]


@pytest.mark.parametrize("block_terms", [1 << 17, 3])
@pytest.mark.parametrize("k", [2, 20])
def test_search_equals_brute_force_on_hostile_rows(spark, k, block_terms):
    items = spark.createDataFrame([(*i, 1, 2) for i in ITEMS], "item_id long, text string, score int, terms int")
    rows = [*DOCS, *((300 - i, "a class of copies: the cat", "en") for i in range(40)), (400, "the " * 50_000 + "cat", "en")]
    got = sorted((tuple(r) for r in lexical.search(docs(spark, rows), items, k, block_terms=block_terms).collect()), key=str)
    assert got == brute_search([r[:2] for r in rows], ITEMS, k)


def test_search_without_documents_or_items(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(docs(spark, []), items).collect() == []
    assert lexical.search(docs(spark, [(1, None, None), (2, "", None)]), items).collect() == []
    assert lexical.search(docs(spark), items.where("false")).collect() == []


def test_terms_of_long_texts_are_counted_in_pieces(monkeypatch):
    text = "Äh x-y X 1_2 " * 3000
    whole = lexical.count_terms(text.encode())
    monkeypatch.setattr(lexical, "PIECE", 17)
    assert lexical.count_terms(text.encode()) == whole == Counter(t.encode() for t in TERM.findall(text.translate(LOWER)))


def test_equal_bags_are_scored_once(spark):
    rows = spark.createDataFrame([(i, f"the cat sat {'x' * (i % 3)} y") for i in range(300)], "doc_id long, text string")
    bags = lexical.bags(rows, {b"cat": 0, b"sat": 1}, "doc_id", "text")
    assert bags.count() == 300 and bags.select("n", "terms", "tfs").distinct().count() == 2
