"""Page and vector operators, near groups and the pipeline against brute force."""

import base64
import hashlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from cladeworks.llm import ann_forest, html_main, near_groups, simhash, warc_zstd
from tests.llm.fixtures import SCHEMA, docs

NAV = '<div class="x"><ul><li><a href="/a">Home</a></li><li>News today</li></ul></div>'


def page(i, body):
    return f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var a='</p><p>no';</script></head><body>{NAV}<header>Site</header>{body}<div id='cookie-notice'>Accept</div><footer>&copy; x</footer>"


CASES = [
    (1, "http://h.example/1", page(1, "<article><header><h1>Head &amp; line</h1></header><p>One\n two<br>three<p><b>Four</b> five<aside>side</aside><div class='comments'><p>nice!</p></div></article>"), "Head & line\n\nOne two three\n\nFour five"),
    (2, "http://h.example/2", None, ""), (3, None, "", ""),
    (4, "http://h.example/4", "<article><p>cut of", "cut of"),
    (5, "http://h.example/5", "<main><h2>A</h2><ul><li>x<li>y</ul><form><p>mail</p></form><div class='ad-box'>buy</div><table><tr><td>1<td>2</table></main>", "A\n\nx\n\ny\n\n1\n\n2"),
    (6, "bad url", "plain &lt;text&gt; &#233;&nbsp;here", "plain <text> é here"),
    (7, "http://h.example/7", "<article class='post'><p>Body</p></article><article class='comment'><p>Reader</p></article>", "Body"),
]


def test_main_text(spark):
    filler = [(100 + i, f"http://h.example/{i}", page(i, f"<p>Story {i} goes here</p><p>Second {i}</p>"), f"Story {i} goes here\n\nSecond {i}") for i in range(30)]
    alone = (200, "http://single.example/", page(0, "<p>Only page</p>"), "Home\n\nNews today\n\nOnly page")
    rows = [*CASES, *filler, alone, alone]
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h, _ in rows], "page_id long, url string, html string, text string, host string")
    got = html_main.main_text(df).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == sorted((i, t, len(t)) for i, _, _, t in rows)
    assert html_main.main_text(df.limit(0)).count() == 0


def test_every_page_of_the_small_table_is_read(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = html_main.main_text(pages)
    assert got.count() == pages.count() and got.where("text = '' OR text LIKE '%<p>%'").count() == 0


def neutral(i):
    """A page without an article or a telling name: only counting can find its menu, notice and foot."""
    menu = "".join(f"<li><a href='/{i}{k}'>word{i * k}</a></li>" for k in range(5))
    notice = f"<div class='q9'>Sentence number {i * 31} of a kind</div>" * (1 + i % 2)
    return f"<body><div class='k1'><ul>{menu}</ul></div><div class='w2'><div class='z3'><h2>Story {i}</h2><p>{'text of it ' * (20 + i)}</p><ul><li>point {i}</ul></div></div>{notice}<div class='r7'><span>made by {i}</span></div>"


def test_templates_alone_find_what_is_not_content(spark):
    rows = [(i, f"http://n.example/{i}", neutral(i)) for i in range(30)] + [(99, "http://few.example/", neutral(3))]
    got = {r.page_id: r for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(30):
        assert got[i].text == f"Story {i}\n\n{' '.join(['text of it'] * (20 + i))}\n\npoint {i}"
        assert (got[i].n_templates, got[i].n_kinds) == (3 + i % 2, 0)
    assert "made by 3" in got[99].text and got[99].n_templates == 0


def test_evidence_counts_against_brute_force(spark):
    rows = [(f"http://h{i % 3}.example/{i}", neutral(i) if i % 4 else page(i, f"<article><p>A {i}</p></article>")) for i in range(40)] + [(None, neutral(1)), ("no host", neutral(1))]
    df = spark.createDataFrame(rows, "url string, html string").withColumn("host", html_main.host_of(F.col("url")))
    want = {}
    for url, html in rows[:40]:
        for key, share in [((0, 0), 0.0), *html_main.evidence(html_main.parse(html)).items()]:
            want.setdefault((url[7:17], *key), []).append(share)
    got = {(r["host"], r["kind"], r["hash"]): (r["pages"], r["share"]) for r in html_main.evidence_counts(df).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(abs(s - sum(want[k]) / len(want[k])) < 1e-9 for k, (_, s) in got.items())


def test_odd_pages_are_read_to_their_end(spark):
    deep = "<b>" * 5000 + "<div>" * 3000 + "deep<script>var x=1</script><nav>menu</nav>"
    rows = [(1, "http://a/", "<article><p>a<![foo[x]]>b<![CDATA[c]]>d<![endif]-->e"), (2, "http://a/", deep), (None, None, "<article>same</article><article>same</article>"), (3, "http://a/", "<![" + "x" * 10), (4, "http://a/", "<p>" + "long " * 300_000)]
    got = {r.page_id: r.text for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].startswith("a") and got[1].endswith("e") and got[2] == "deep" and got[None] == "same\n\nsame" and len(got[4]) == 1_499_999


def test_no_page_crashes():
    rng = np.random.default_rng(8)
    pieces = ["<", ">", "</", "<!", "<![", "]>", "<!--", "-->", "p", "div", " class='a'", "article", "<p>", "</div>", "<br/>", "&am", "&#x;", "\x00", "\"", "x y", "<script>", "</script>", "<?", "<svg/>", "<title>", "<textarea>", "=", "<!DOCTYPE", "[endif]"]
    for _ in range(3000):
        root = html_main.parse("".join(rng.choice(pieces, int(rng.integers(1, 25)))))
        html_main.extract(root, set(), {k for _, k in html_main.evidence(root)}, set())


@pytest.mark.parametrize("least", [0, 10])
def test_warc_round_trip(spark, least):
    rows = [(5, "http://a/ b\r\nX: y", "<p>same</p>"), (3, None, "<p>same</p>"), (9, "http://ü/", "<p>same</p>"), (1, "u", None), (2, "u", ""), (None, "u", "<p>same</p>"), (7, "u", "other é" * 20000), (4, "u", "12345"), (6, "u", "12345"), (6, "u", "12345")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, first int, payload int").repartition(3)
    got = warc_zstd.round_trip(df, min_revisit_bytes=least).collect()
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = min(j for j, _, g in rows if (g or "") == (h or "") and j is not None)
        revisit = len(data) >= least and i != same
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", same if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert warc_zstd.round_trip(df.limit(0)).count() == 0


def test_payloads_with_one_digest_stay_apart(spark, tmp_path):
    rows = [(1, "u", "one text"), (2, "u", "two text"), (3, "u", "one text"), (1, "u", "another")]
    folder = f"file://{tmp_path}/archives"
    manifest = warc_zstd.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, content_hash=lambda p: F.lit(b"x"))
    got = warc_zstd.read_archives(spark, folder, manifest, with_payload=True).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to, bytes(r.payload)) for r in got) == [(1, "response", None, b"another"), (1, "response", None, b"one text"), (2, "response", None, b"two text"), (3, "revisit", 1, b"")]


def test_archive_layout():
    records = [warc_zstd.warc_record(i, f"http://a/{i}", b"<html>text of page %d</html>" % i * 30, "D", None, False) for i in range(200)]
    data = warc_zstd.archive(records)
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and len(data) < sum(map(len, records)) / 3
    assert len(list(warc_zstd.records_of(data))) == 200
    with pytest.raises(ValueError):
        list(warc_zstd.records_of(data[:-3]))


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[400:460] = x[3]
    x[0] = 0
    x[1, 2] = np.nan
    return x


@pytest.mark.parametrize("sample", [20_000, 150])
def test_nearest(spark, vectors, sample):
    rows = [(i, v.tolist(), 1, 2.0) for i, v in enumerate(vectors)] + [(5000, None, 1, 2.0), (5001, [1.0, None], 1, 2.0), (5002, [1.0], 1, 2.0), (None, vectors[5].tolist(), 1, 2.0), (7, vectors[7].tolist(), 1, 2.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf int, score double").repartition(3)
    got = ann_forest.nearest(df, df.where("vec_id % 20 = 0"), k=20, bin_rows=300, sample=sample).collect()
    good = [i for i in range(1500) if i > 1]
    x = vectors.astype(np.float64)
    hits = total = 0
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {q for q in range(0, 1500, 20) if q > 1}
    for q, mine in found.items():
        mine.sort()
        assert [r for r, _, _ in mine] == list(range(1, 21)) and len({v for _, v, _ in mine}) == 20
        assert all(abs(s - float((x[v] * x[q]).sum())) < 1e-9 for _, v, s in mine)
        assert [(-s, v) for _, v, s in mine] == sorted((-s, v) for _, v, s in mine)
        scores = x[good] @ x[q]
        best = [good[i] for i in np.lexsort((good, -scores)) if good[i] != q][:20]
        hits += len({v for _, v, _ in mine} & set(best))
        total += 20
    assert hits / total >= 0.9
    assert ann_forest.nearest(df, df.where("vec_id % 20 = 0"), visit=0, sample=sample).count() == 0, "rows come from the forest alone"
    assert ann_forest.nearest(df.limit(0), df.limit(0)).count() == 0
    assert ann_forest.nearest(df.where("vec_id IN (20, 21)"), df.where("vec_id = 20")).count() == 1


def test_a_repeated_id_takes_one_place(spark):
    rng = np.random.default_rng(6)
    rows = [(7, (np.ones(8) + rng.normal(0, 1e-3, 8)).tolist()) for _ in range(60)] + [(i, (np.ones(8) * (1 - i / 1000)).tolist()) for i in range(20, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r.vec_id for r in ann_forest.nearest(df, df.where("vec_id = 40"), k=5, visit=4096).orderBy("rank").collect()]
    assert got == [7, 20, 21, 22, 23]


def brute_groups(rows, least=0.8):
    sets = [(i, set(simhash.shingle_hashes(t, 5).tolist())) for i, t in rows]
    return {(a, b) for a, s in sets for b, t in sets if a < b and s and t and len(s & t) >= least * len(s | t)}


def test_near_groups(spark):
    rng = np.random.default_rng(4)
    rows = []
    for base in range(40):
        words = [f"w{int(x)}" for x in rng.integers(0, 5000, 220)]
        rows.append((base * 10, " ".join(words)))
        for k in range(1, 4):
            changed = list(words)
            for at in rng.choice(220, k * 2, replace=False):
                changed[at] = f"new{int(rng.integers(0, 9999))}"
            rows.append((base * 10 + k, " ".join(changed)))
    links = brute_groups(rows)
    got = dict(near_groups.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert all(got[i] // 10 == i // 10 for i in got), "clean documents are left alone"
    assert sum(got[a] == got[b] for a, b in links) >= 0.95 * len(links)
    kept = near_groups.drop_near_duplicates(docs(spark)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 3, 4, 5, 8, 9, 10, 11, 12, 13] and len(kept) == 12
    words = rows[0][1]
    again = spark.createDataFrame([(5, words), (5, "quite another text that stands under the same number as that one"), (3, words + " end"), (5, words)], "doc_id long, text string")
    assert sorted((r.doc_id, len(r.text)) for r in near_groups.drop_near_duplicates(again).collect()) == [(3, len(words) + 4), (5, 64)]
    assert near_groups.drop_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_groups_keep_different_texts_with_equal_fingerprints(spark):
    line = "all rights are reserved here "
    rows = [(i, line * 100 + " ".join(f"own{i}x{k}" for k in range(500))) for i in range(6)] + [(6, " ".join(["a b c d e"] + [f"z{k}" for k in range(40)]))]
    assert len({simhash.fingerprint(simhash.shingle_hashes(t, 5)) for _, t in rows[:6]}) == 1
    assert dict(near_groups.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == {i: i for i in range(7)}


def test_near_groups_find_every_link(spark):
    rng = np.random.default_rng(9)
    rows = []
    for base in range(300):
        n = int(rng.choice([12, 30, 60, 150, 400]))
        words = [f"w{int(x)}" for x in rng.integers(0, 10**6, n)]
        cut = int(0.2 * (n - 4))  # so many shingles less leave a similarity of just 0.8
        rows += [(2 * base, " ".join(words)), (2 * base + 1, " ".join(words[: n - cut] if base % 2 else words[cut:]))]
    line = " ".join(f"l{k}" for k in range(300))
    rows += [(600, line), (601, " ".join([line] * 60)), (602, line + " and")]
    links = brute_groups(rows)
    assert len(links) > 250
    got = dict(near_groups.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    root = {i: i for i, _ in rows}
    for a, b in sorted(links):
        low, high = sorted((root[a], root[b]))
        root = {i: low if r == high else r for i, r in root.items()}
    assert got == root


def test_pipeline(spark):
    columns = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").columns
    now, sizes = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "/root/testdata/sf0.001")
        if name != "packing":
            assert now.columns == columns
        sizes.append(now.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id").distinct().count() == sizes[3]


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op7_repeated_passages", "op9_line_templates"])
def test_sql(spark, name):
    con = duckdb.connect()
    where = "/root/testdata/sf0.001"
    for file in os.listdir(where):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{where}/{file}'")
    want, got = con.sql(entry.oracle_sql()[name]).to_arrow_table(), entry.queries()[name](spark, where).toArrow()
    names = sorted(want.column_names)
    assert names == sorted(got.column_names)
    assert sorted(map(repr, zip(*(want.column(n).to_pylist() for n in names)))) == sorted(map(repr, zip(*(got.column(n).to_pylist() for n in names))))


def test_pipeline_on_hostile_and_empty_tables(spark, tmp_path):
    """All five stages in a row: nothing crashes, every document that is left is packed whole, and an empty table gives nothing."""
    import corpus_pipeline
    from tests.llm.fixtures import DOCS, docs

    for name, rows in (("hostile", [*DOCS, (20, "long " * 60_000, "en")]), ("empty", [])):
        where = f"file://{tmp_path}/{name}"
        docs(spark, rows).write.parquet(f"{where}/documents.parquet")
        got = corpus_pipeline.run(spark, where).collect()
        pieces = {}
        for r in got:
            pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
        assert {d for d, _ in pieces} <= {i for i, _, _ in rows} and bool(got) == bool(rows)
        for (doc, tokens), parts in pieces.items():
            if doc is not None:
                at = 0
                for start, length in sorted(parts):
                    assert start == at
                    at += length
                assert at == tokens
        if rows:
            assert not {1, 2} <= {d for d, _ in pieces} and not {5, 6} <= {d for d, _ in pieces}
