"""Document operators against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cladeworks.llm import bpe_duckdb, components, exact_dedup, language_cnn, line_templates, packing, phrase_automata, simhash
from tests.llm.fixtures import COPY, DOCS, SCHEMA, docs

public_tokenizers = pytest.importorskip("public_tokenizers")
PLAIN = [(i, t) for i, t, _ in DOCS]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def table(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("content_hash", [exact_dedup.md5_128, lambda t: F.length(t), lambda t: F.lit(0)])
def test_exact_duplicates(spark, keep, content_hash):
    groups = defaultdict(list)
    for i, t in PLAIN:
        groups[lower(t)].append(i)
    best = {t: {"min": min, "max": max}[keep]([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    want = [(i, best[lower(t)], len(groups[lower(t)]), i == best[lower(t)], hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in PLAIN]
    assert table(exact_dedup.exact_duplicates(docs(spark), keep=keep, content_hash=content_hash)) == sorted(want, key=repr)


def test_exact_filter(spark, empty):
    kept = exact_dedup.drop_exact_duplicates(docs(spark))
    assert kept.columns == docs(spark).columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 3, 5, 7, 8, 9, 10, 11, 12, 13]
    assert kept.where("doc_id IS NULL").count() == 2
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0
    shared = spark.createDataFrame([(5, "text one"), (5, "another text"), (5, "TEXT one"), (6, "third"), (7, "another text"), (3, "Third")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text.lower()) for r in exact_dedup.drop_exact_duplicates(shared).collect()) == [(3, "third"), (5, "another text"), (5, "text one")]


def brute_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) > width else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_components(prints, radius):
    root = {i: i for i, _ in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in prints:
        for b, y in prints:
            if (x ^ y).bit_count() <= radius and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i, _ in prints}


def test_simhash(spark, empty):
    named = [(i, t) for i, t in PLAIN if i is not None]
    prints = [(i, brute_fingerprint(t, 4)) for i, t in named]
    of = brute_components(prints, 4)
    want = sorted((i, f"{p:016x}", of[i]) for i, p in prints)
    got = simhash.near_duplicates(docs(spark))
    assert sorted(map(tuple, got.where("doc_id IS NOT NULL").collect())) == want
    assert got.count() == len(PLAIN)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("chunk", [3, 4096])
def test_simhash_links_lose_nothing(spark, chunk):
    rng = np.random.default_rng(1)
    prints = set()
    for base in rng.integers(0, 2**63, 12).tolist():
        for _ in range(14):
            x = base
            for bit in rng.choice(64, rng.integers(0, 4), replace=False).tolist():
                x ^= 1 << bit
            prints.add(x - (1 << 64) if x >> 63 else x)
            base = x if rng.random() < 0.5 else base
    prints = sorted(prints)
    want = brute_components([(p, p & (2**64 - 1)) for p in prints], 4)
    df = simhash.with_pivots(spark.createDataFrame([(p,) for p in prints], "fp long"))
    for blocks in (6, 7, 8):
        got = {r.node: r.root for r in components.connected_components(simhash.links(df, 4, blocks, chunk)).collect()}
        assert {p: got.get(p, p) for p in prints} == want
    assert [simhash.blocks_for(n, 4) for n in (0, 1 << 22, 1 << 23, 1 << 30)] == [6, 6, 7, 8]


def test_components_of_a_long_chain(spark):
    got = components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def brute_repeats(rows, width):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - width + 1) if i is not None else ():
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - width + 1) if i is not None else ():
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_rows_without_an_id_and_of_one_id_are_dealt_to_many_tasks(spark):
    """A third of all rows has no id and one text, a third one id and texts that share passages among them and with the rest."""
    rng = random.Random(4)
    shared = [" ".join(rng.choices("abcdefgh", k=9)) for _ in range(6)]
    text = lambda: " ".join(rng.choice([*shared, rng.choice("xyzuvw"), rng.choice("xyzuvw")]) for _ in range(6))
    rows = [(None, shared[0] + " " + shared[1])] * 40 + [(7, text()) for _ in range(40)] + [(i, text()) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for shard_chars in (300, 10**6):
        assert table(phrase_automata.remove_repeats(df, width=6, shard_chars=shard_chars)) == brute_repeats(rows, 6)
    kept = phrase_automata.without_repeats(df.withColumn("rest", F.lit(1)), width=6)
    assert kept.columns == ["doc_id", "text", "rest"] and kept.where("doc_id IS NULL").select("text").distinct().count() == 1 and kept.where("doc_id IS NULL").count() == 40


@pytest.mark.parametrize("shard_chars", [300, 2_000_000])
@pytest.mark.parametrize("width", [6, 13])
def test_repeated_passages(spark, empty, shard_chars, width):
    extra = [(100 + k, " ".join(f"w{(k * 5 + j) % 23}" for j in range(30 + k))) for k in range(25)]
    rows = PLAIN + extra
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert table(phrase_automata.remove_repeats(df, width=width, shard_chars=shard_chars)) == brute_repeats(rows, width)
    assert phrase_automata.remove_repeats(empty).count() == 0


def by_hand(rows, width, shards, buckets=5, common=()):
    """The four steps without Spark: (doc_id, mask) of every row."""
    import pyarrow as pa
    import pyarrow.compute as pc

    tables = [pa.table([pa.array([i for i, _ in some], pa.int64()), pa.array([t for _, t in some], pa.string())], names=["doc_id", "text"]) for some in (rows[k::shards] for k in range(shards))]
    sent = pa.concat_tables([phrase_automata.windows_sent(phrase_automata.Texts(t), k, width, 5, buckets, np.array(common, np.uint64)) for k, t in enumerate(tables)])
    asked = pa.concat_tables([phrase_automata.requests(sent.filter(pc.equal(sent["bucket"], b))) for b in range(buckets)])
    found = pa.concat_tables([phrase_automata.passages_sent(phrase_automata.Texts(t), asked.filter(pc.equal(asked["shard"], k)), width) for k, t in enumerate(tables)])
    out = []
    for k, table in enumerate(tables):
        texts = phrase_automata.Texts(table)
        out += zip(texts.ids, phrase_automata.Passages(found.filter(pc.equal(found["shard"], k)), width).removed(texts))
    return sorted(((i, [] if m is None else m.tolist()) for i, m in out), key=repr)


REPEATING = [(100 + k, " ".join(f"w{(k * 5 + j) % 23}" for j in range(30 + k))) for k in range(12)] + [(1, "only once " * 3), (2, " ".join(f"z{j}" for j in range(40)))]


def test_common_words_change_nothing():
    words = [xxhash.xxh64_intdigest(f"w{k}".encode()) for k in range(23)]
    common = phrase_automata.run_hashes(np.array(words * 2, np.uint64), 5).tolist()
    want = by_hand(REPEATING, 13, 3)
    assert by_hand(REPEATING, 13, 3, common=common[:9]) == by_hand(REPEATING, 13, 3, common=common) == want
    assert sum(map(sum, (m for _, m in want))) == sum(n for i, _, n, _ in brute_repeats(REPEATING, 13))


def test_only_the_automaton_removes_words(monkeypatch):
    monkeypatch.setattr(phrase_automata.Passages, "hits", lambda self, texts: (np.empty(0, np.int64), np.empty(0, np.int64)))
    assert not any(any(m) for _, m in by_hand(REPEATING, 13, 3))


def test_colliding_hashes_remove_no_word_wrongly(monkeypatch):
    want = by_hand(REPEATING, 13, 3)
    monkeypatch.setattr(phrase_automata, "run_hashes", lambda words, count: words[: max(0, len(words) - count + 1)] % np.uint64(3) * np.uint64(2))
    got = by_hand(REPEATING, 13, 3)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(not a or b for (_, x), (_, y) in zip(got, want) for a, b in zip(x, y))


def test_repeats_are_cut_out_of_texts(spark):
    shared = " ".join(f"s{i}" for i in range(55))
    rows = [(1, f"begin {shared} end", 5), (2, f"other\n{shared}\n tail  here", 6), (3, shared, 7), (4, "clean  text\n", 12), (None, shared, 1)]
    got = {r.doc_id: (r.text, r.n_chars) for r in phrase_automata.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_chars int")).collect()}
    odd = spark.createDataFrame([(1, shared, "n", None, 3), (2, shared, "n", "b", 4), (2, "clean", None, "c", 5)], ["doc_id", "text", "shard", "a b", "rest"])
    kept = phrase_automata.without_repeats(odd)
    assert kept.columns == odd.columns and sorted(map(tuple, kept.collect()), key=repr) == [(1, shared, "n", None, 3), (2, "clean", None, "c", 5)]
    assert phrase_automata.without_repeats(odd.limit(0)).count() == 0
    assert got == {1: (rows[0][1], 5), 2: ("other\ntail  here", 16), 4: ("clean  text\n", 12), None: (shared, 1)}


def test_byte_bpe(spark, empty):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe_duckdb.read_ranks(path)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in PLAIN:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert table(bpe_duckdb.encode_decode(docs(spark), path, public_tokenizers.PATTERN)) == sorted(want, key=repr)
    assert bpe_duckdb.encode_decode(empty, path, public_tokenizers.PATTERN).count() == 0


def test_packing(spark, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in PLAIN if i not in (6, None)] + [(20, "a <|endoftext|> b   c \n d  e")]
    full = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = full[r.doc_id][r.start : r.start + r.length]
        assert r.ids == ids and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.doc_tokens == len(full[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, ids in full.items():
        assert [s for s, _ in sorted(pieces[i])] == [sum(n for _, n in sorted(pieces[i])[:k]) for k in range(len(pieces[i]))] and sum(n for _, n in pieces[i]) == len(ids)
    for parts in sequences.values():
        total = sum(n for _, n in parts)
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
        assert total <= 2048 and total & (total - 1) == 0
    twice = [(5, "the same words"), (5, "the same words"), (None, "no id"), (None, "no id")]
    packed = packing.pack(spark.createDataFrame(twice, "doc_id long, text string"), path, with_ids=True).collect()
    one, other = ([*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in ("the same words", "no id"))
    assert sorted(x for r in packed for x in r.ids) == sorted(2 * one + 2 * other) and sum(r.length for r in packed if r.doc_id == 5) == 2 * len(one)
    assert packing.pack(docs(spark), path).select("doc_id").distinct().count() == 15
    assert packing.pack(empty, path).count() == 0


def test_hilbert_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    order = packing.hilbert(grid, bits=3)
    assert sorted(order.tolist()) == list(range(512))
    walk = grid[np.argsort(order)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_language(spark, empty):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    network = language_cnn.train(df.where(~language_cnn.held_out()).select("doc_id", "text", "lang"), sample=500)
    found = language_cnn.predict(df, network).join(df.select("doc_id", "lang"), "doc_id").where(language_cnn.held_out() & F.col("lang").isNotNull())
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language_cnn.predict(docs(spark), network).collect()}
    assert language_cnn.judge(network, ["½ ² Ⅳ", "é"])[0] == ["und", language_cnn.judge(network, ["é"])[0][0]]
    assert odd[3] == odd[4] == odd[11] == ("und", 0.0) and all(0 <= s <= 1 for _, s in odd.values())
    assert language_cnn.predict(empty, network).count() == 0
    assert language_cnn.train(empty).labels == []
    assert {r.lang_pred for r in language_cnn.predict(docs(spark), language_cnn.train(empty)).collect()} == {"und"}


def test_line_templates(spark, empty):
    rows = [(i, f"{'abcdefghij'[i] * 3} opening words here {i}\nCopyright (c) 20{10 + i} Example Corp number {i}\n\nlast words of {'abcdefghij'[i]}") for i in range(8)] + [(8, None), (9, ""), (None, "Copyright (c) 2001 Example Corp number 9\nkept line alone")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    for i in range(8):
        assert got[i] == (4, 1, f"{'abcdefghij'[i] * 3} opening words here {i}\n\nlast words of {'abcdefghij'[i]}")
    assert got[8] == got[9] == (0, 0, "")
    assert got[None] == (2, 1, "kept line alone")
    assert line_templates.drop_templates(empty).count() == 0


def test_line_templates_do_not_depend_on_how_full_the_tree_is(spark):
    rng = np.random.default_rng(4)
    notice, login = "the page you are reading is printed by its owner alone", "from the house {} came in and to the town {} went they at noon"
    rows = [(i, f"{notice}\n{login.format('n' + 'abcdefgh'[i], 't' + 'hgfedcba'[i])}\nown {i} x") for i in range(8)]
    rows += [(100 + k, "the page you " + " ".join(rng.choice(["are", "is", "of", "by", "to", "page", "alone", "its"], 8))) for k in range(600)]
    got = {r.doc_id: r.kept_text for r in line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert all(got[i] == "" or got[i] == f"own {i} x" for i in range(8))
    assert sum(t == "" for i, t in got.items() if i >= 100) < 60


def test_line_templates_on_hostile_rows_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import pyarrow as pa

    rows = PLAIN + [(50 + k, f"a\tb  c d{k}\x0be f\ng h\n g  h \nlong {'tail ' * 3000}{k}") for k in range(7)] + [(50, "a b c d e f"), (50, "other")]
    con = duckdb.connect()
    con.register("documents", pa.table([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], names=["doc_id", "text"]))
    want = con.sql(line_templates.ORACLE).fetchall()
    got = line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(r.n_dropped for r in got) >= 21


def test_line_templates_mask_texts_once(spark, monkeypatch):
    plans, write = [], line_templates.written
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(line_templates, "written", lambda df, name: (plans.append(plan(df)), write(df, name))[1])
    plans.append(plan(line_templates.drop_templates(docs(spark))))
    masking = [line for p in plans for line in p.splitlines() if "RLIKE" in line]
    assert len(masking) == 1 and masking[0].count("RLIKE") == 1


def test_line_templates_spaces_at_the_ends_of_lines_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import pyarrow as pa

    odd = " \n\t\n  a notice of the owner 7\t\n\x0ba  notice of\rthe owner x8y \n\n1\n 22\n3 \nünd ü٣ <*> é9é\t\n"
    rows = [(k, odd + f"own{k} line {'abcdef'[k]}\n a notice of the owner {k}" + "\n" * k) for k in range(6)] + [(6, " "), (7, "\n"), (8, "1"), (9, "a" * 200_000 + " 1"), (10, " \n "), (11, None), (0, "1\n1\n1")]
    con = duckdb.connect()
    con.register("documents", pa.table([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], names=["doc_id", "text"]))
    want = con.sql(line_templates.ORACLE).fetchall()
    got = line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r.n_dropped for r in got if r.doc_id == 1} == {6}  # the line of fields after its opening has nothing constant


def test_line_templates_read_long_lines_in_one_go(spark):
    import time

    line = " ".join(f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}" for k in range(30_000))
    rows = [(k, f"{line} {'abcdef'[k]} {k}\nown {'abcdef'[k]}") for k in range(6)]
    began = time.time()
    got = {r.doc_id: (r.n_dropped, r.kept_text) for r in line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert got == {k: (1, f"own {'abcdef'[k]}") for k in range(6)}
    assert time.time() - began < 60


def test_long_words_are_encoded_as_any(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_duckdb.read_ranks(path), special_tokens={})
    coder = bpe_duckdb.Coder(bpe_duckdb.read_ranks(path), public_tokenizers.PATTERN)
    rng = np.random.default_rng(3)
    texts = ["a" * 5000, "=" * 3001, " " * 999 + "x", "ab" * 2000, "é" * 500, *("".join(rng.choice(list("abcde"), 700)) for _ in range(10)), *("".join(rng.choice(["the", "ing", "a", "ion"], 200)) for _ in range(10))]
    texts += ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n)) for n in (1, 2, 81, 1000, 100_000)]
    assert [x.tolist() for x in coder.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_atoms_do_not_change_ids():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = packing.Encoder(path)
    rng = np.random.default_rng(5)
    odd = ["a\nb", "a \nb", "a\n b", "x.\nY z", " .\n", "..", "a.. b", "it's. don't,", "é.,ñ, z.", "12. 3,", "_., a_. b", "end.\n\n next", "", "\0 a\0", "x\x1c y\x85 z"]
    odd += ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z.", "<|endoftext |>"]
    odd += ["".join(rng.choice(list("ab .,\n\t'é1_\x85"), int(rng.integers(1, 30)))) for _ in range(3000)]
    assert encoder.encode(odd) == [encoder._raw([t])[0] for t in odd]
