"""Every operator's query against brute force, an exact round trip, or held-out accuracy."""

import hashlib
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from fleetlens.llm import (byte_bpe, catalog, dedup, fingerprints, jaccard_join, licenses, main_text, packing,
                           pitman_yor, toxicity, warc)
from fleetlens.llm.components import components
from tests.check_oracle import connect, differences, type_differences
from tests.llm import brute

BYTES, WORD_BPE = (public_tokenizers.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"))


@pytest.mark.parametrize("name", list(catalog.ORACLE))
def test_sql(name, query, sf):
    df, want = query(name), connect(sf).sql(catalog.ORACLE[name])
    assert type_differences(df, want) is None
    assert differences(df.toPandas(), want.df()) is None


# ---- 1: archives -------------------------------------------------------------------------

def test_archive_is_a_zip_that_others_read(spark, sf, tmp_path):
    import gzip
    import zipfile

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    made = warc.write_archives(pages, f"file://{tmp_path}/a").collect()
    n = 0
    for row in made:
        with zipfile.ZipFile(row["path"].removeprefix("file://")) as z:
            assert z.testzip() is None
            assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
            n += gzip.decompress(z.read(warc.DATA_NAME)).count(b"WARC/1.1\r\n")
    assert n == pages.count()


def test_directory_without_zip64_and_with_comment(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "z", "w") as z:
        z.writestr("a", b"abc")
        z.writestr("b/c", b"defg")
        z.comment = b"note"
    with open(tmp_path / "z", "rb") as f:
        members = warc.central_directory(f, (tmp_path / "z").stat().st_size)
        assert {k: warc.read_range(f, *v) for k, v in members.items()} == {"a": b"abc", "b/c": b"defg"}
    with zipfile.ZipFile(tmp_path / "d", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"abc" * 100)
    with open(tmp_path / "d", "rb") as f, pytest.raises(ValueError, match="compressed"):
        warc.central_directory(f, (tmp_path / "d").stat().st_size)


def test_archive_edges(spark, tmp_path):
    long = "y" * 1000
    rows = [(1, "http://a b\n", long), (2, None, long), (3, "u", None), (4, "u", ""), (5, "u", "x" * 999),
            (6, "u", "x" * 999), (7, "é", "é" * 500), (8, "u", "é" * 500), (8, "u", "é" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/b"))
    have = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got.collect())
    assert have == [(1, "revisit", 2, 1000), (2, "response", None, 1000), (3, "response", None, 0),
                    (4, "response", None, 0), (5, "response", None, 999), (6, "response", None, 999),
                    (7, "revisit", 8, 1000), (8, "response", None, 1000), (8, "response", None, 1000)]
    payloads = {r["page_id"]: bytes(r["payload"]) for r in got.collect()}
    assert payloads[2] == long.encode() and payloads[1] == b"" and payloads[5] == b"x" * 999
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(none, f"file://{tmp_path}/c")).count() == 0


# ---- 2: packing --------------------------------------------------------------------------

def check_packing(rows, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = []
    for i, t in texts:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start:start + 4096]
            want.append((i, piece, start, len(part), zlib.crc32(part.tobytes())))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by_sequence), -(-sum(r["length"] for r in rows) // 4096)


def test_packing(query, documents):
    used, least = check_packing(query("op2_packing").collect(), documents)
    assert used <= least + 2


def test_packing_edges(odd, empty):
    rows = packing.pack(odd, WORD_BPE).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert packing.pack(empty, WORD_BPE).count() == 0
    ids = packing.sequences(packing.pack(odd, WORD_BPE, with_ids=True)).collect()
    assert sum(len(r["ids"]) for r in ids) == 4 * sum(r["length"] for r in rows)


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(4097, np.int64)
    lengths = np.minimum(np.exp(rng.normal(6, 1.5, 3000)).astype(int) + 1, 4096)
    if seed == 3:
        lengths = np.full(1000, 1366)       # three do not fit
    np.add.at(counts, lengths, 1)
    plan = packing.Plan(counts)
    length = np.repeat(np.arange(4097), counts)
    rank = np.concatenate([np.arange(c) for c in counts])
    sequence, offset = plan.find(length, rank)
    order = np.lexsort((offset, sequence))
    s, o, n = sequence[order], offset[order], length[order]
    new = np.append(True, s[1:] != s[:-1])
    assert (o[new] == 0).all() and (o[1:][~new[1:]] == (o + n)[:-1][~new[1:]]).all() and (o + n).max() <= 4096
    least = 500 if seed == 3 else -(-int(length.sum()) // 4096)
    assert plan.sequences <= 1.02 * least + 2


# ---- 3: Jaccard join ---------------------------------------------------------------------

def by_id(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_jaccard(query, documents):
    assert by_id(query("op3_jaccard_join")) == brute.components(documents)


def family(rng, n, edits, base, size=60):
    words = [f"b{base}_{i}" for i in range(size)]
    out = []
    for _ in range(n):
        w = list(words)
        for at in rng.choice(size, rng.integers(0, edits + 1), replace=False):
            w[at] = f"e{rng.integers(0, 40)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("similar", [80, 55])
def test_jaccard_on_families_of_near_copies(spark, similar):
    rng = np.random.default_rng(5)
    texts = [t for b in range(6) for t in family(rng, 70, 6, b)] + [f"line in common of all {i} {i + 1}" for i in range(60)]
    docs = [(int(i), t) for i, t in enumerate(rng.permutation(texts))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert by_id(jaccard_join.jaccard_components(frame, similar)) == brute.components(docs, similar)


def test_jaccard_blocks_and_rings_find_all(spark, monkeypatch):
    """Regions that pivots do not solve: small limits force rings and blocks."""
    monkeypatch.setattr(jaccard_join, "RING_REGION", 8)
    monkeypatch.setattr(jaccard_join, "SMALL_REGION", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    rng = np.random.default_rng(6)
    docs = [(i, t) for i, t in enumerate(family(rng, 120, 5, 0, 40))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert by_id(jaccard_join.jaccard_components(frame)) == brute.components(docs)


def test_jaccard_edges(odd, empty):
    rows = jaccard_join.jaccard_components(odd).collect()
    assert len(rows) == 18
    known = [(r["doc_id"], r["text"] or "") for r in odd.collect() if r["doc_id"] is not None]
    want = brute.components(known)
    assert all(want[r["doc_id"]] == (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None)
    assert sorted(r["n_shingles"] for r in rows if r["doc_id"] is None) == [0, 1]
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert jaccard_join.jaccard_components(empty).count() == 0
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 7 not in ids and 8 not in ids and ids.count(6) == 2 and ids.count(None) == 2 and {2, 3, 4} <= set(ids)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 150)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 150: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 4: fingerprints ---------------------------------------------------------------------

def test_fingerprints(query, documents):
    rows = {r["doc_id"]: r for r in query("op4_fingerprints").collect()}
    order = sorted(documents, reverse=True)
    seen = {}
    for n, (i, text) in enumerate(order):
        after, cut = order[(n + 1) % len(order)][1], len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert seen.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        plain, changed, following = fingerprints.fingerprint_sketches([text, edited, after])
        assert r["fingerprint"] == fingerprints.written(plain)
        assert r["near_edited"] == fingerprints.likeness(plain, changed)
        assert r["near_next"] == fingerprints.likeness(plain, following)
    assert len(rows) == len(documents)
    assert np.mean([r["near_edited"] for r in rows.values()]) > 0.5
    assert np.mean([r["near_next"] for r in rows.values()]) < 0.05


def test_equal_substrings_have_equal_phrases():
    rng = np.random.default_rng(2)
    core = "".join(rng.choice(list("abcdefgh "), 2000))
    for before in ("", "x", "aaaa", "some words before"):
        a, b = (np.frombuffer((p + core).encode("utf-32-le"), np.uint32).astype(np.uint64) for p in ("", before))
        for _ in range(3):
            a, _ = fingerprints.phrases(a, np.zeros(len(a), int))
            b, _ = fingerprints.phrases(b, np.zeros(len(b), int))
            assert set(a[12:]) <= set(b)


def test_fingerprint_edges(odd, empty, spark):
    rows = fingerprints.fingerprints_with_edits(odd).collect()
    assert len(rows) == 18
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (2, 3)} == {""}
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    assert fingerprints.fingerprints_with_edits(empty).count() == 0
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    assert fingerprints.fingerprints_with_edits(one).head()["near_next"] == 1.0
    assert fingerprints.fingerprints(odd).count() == 18


# ---- 5: toxicity -------------------------------------------------------------------------

def test_toxicity_is_right_on_unseen_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.filter("doc_id % 4 = 1")
    chain = catalog.toxicity_chain(docs, labels.filter("doc_id % 4 <> 1"))
    scored = toxicity.score(docs.join(held.select("doc_id"), "doc_id"), chain)
    rows = scored.join(held, "doc_id").select("p_toxic", "toxic").collect()
    called = [(r["p_toxic"] >= 0.5, r["toxic"] == 1) for r in rows]
    right = sum(a and b for a, b in called)
    assert right / sum(a for a, _ in called) > 0.97 and right / sum(b for _, b in called) > 0.9


def test_toxicity_edges(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = catalog.toxicity_chain(odd, none)
    assert {r["p_toxic"] for r in toxicity.score(odd, chain).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (5, None, 1), (9, 1, None), (9, 1, 0), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    chain = catalog.toxicity_chain(odd, labels)
    assert toxicity.score(odd, chain).count() == 18
    assert toxicity.score(empty, chain).count() == 0
    kept = toxicity.keep_clean(odd, chain)
    assert kept.columns == odd.columns and kept.count() <= 18


def test_later_models_see_earlier_categories(spark):
    rows = [(i, ("alpha " if i % 2 else "") + ("beta " if i % 3 else "") + f"w{i % 17}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("first"),
                         ((F.col("doc_id") % 2) * F.when(F.col("doc_id") % 3 > 0, 1).otherwise(0)).cast("int").alias("second"))
    chain = toxicity.fit_chain(docs, labels, {"first": F.col("first"), "second": F.col("second")})
    assert len(chain.models[1].weights) == len(chain.models[1].columns) + 1 and chain.models[1].weights[-1] != 0
    p = chain.probabilities(["alpha beta", "alpha", "beta", ""])
    assert (p > 0.5).tolist() == [[True, True], [True, False], [False, False], [False, False]]


# ---- 6: licences -------------------------------------------------------------------------

def test_licenses_against_all_stretches():
    rng = np.random.default_rng(3)
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    for _ in range(60):
        name = rng.choice([n for n in licenses.TEMPLATES if "notice" not in n])
        words = licenses.TEMPLATES[name].split()
        for _ in range(rng.integers(0, 3)):
            at = rng.integers(0, len(words))
            words[at:at + 1] = [["changed"], [], [words[at], "added"]][rng.integers(0, 3)]
        text = " ".join(["lead", *words, "trail"])
        found = scanner.matches(text)
        want = any(brute.dice_matches(text, t, 0.8) for t in licenses.TEMPLATES.values())
        assert bool(found) == want, text


def test_licenses(query, documents):
    rows = {r["doc_id"]: r for r in query("op6_licenses").collect()}
    lines = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    for i, text in documents:
        want = next((n for line, n in lines.items() if line in text), None)
        assert rows[i]["license"] == want
        assert all(text[m["start"]:m["end"]].lower() in text.lower() and m["score"] >= 0.9 for m in rows[i]["matches"])


def test_license_edges(odd, empty):
    rows = licenses.scan(odd).collect()
    assert [r["doc_id"] for r in rows if r["license"]] == [13] and len(rows) == 18
    assert licenses.scan(empty).count() == 0
    text = " ".join(licenses.TEMPLATES["MIT notice"].split())
    assert [m[0] for m in licenses.Scanner(licenses.TEMPLATES, 0.9).matches(f"a. {text} b. {text}")] == ["MIT notice"] * 2


# ---- 7: exact duplicates -----------------------------------------------------------------

def test_dedup_edges(odd, empty):
    rows = dedup.exact_duplicates(odd).collect()
    keep = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"], r["kept"]) for r in rows}
    by = {k[0]: v for k, v in keep.items()}
    assert len(rows) == 18 and by[5] == (1, 3, False) and by[1] == (1, 3, True) and by[6] == (6, 2, True)
    assert by[2] == (2, 3, True) and by[3] == (2, 3, False) and by[4][1] == 1
    assert all(not r["kept"] for r in rows if r["doc_id"] is None)
    assert dedup.exact_duplicates(empty).count() == 0
    left = dedup.deduplicate(odd)
    assert left.columns == odd.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
    assert dedup.deduplicate(empty).count() == 0


def test_dedup_of_a_hot_group(spark):
    rows = [(i, "same  text" if i % 3 == 0 else f"text {i}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in dedup.exact_duplicates(docs, salts=4).collect()}
    assert got == {i: (0, 2000) if i % 3 == 0 else (i, 1) for i in range(6000)}


# ---- 8: byte-level BPE -------------------------------------------------------------------

@pytest.fixture(scope="module")
def reference_encoding():
    import base64

    import tiktoken

    with open(BYTES, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(query, documents, reference_encoding):
    want = []
    for i, t in documents:
        ids = reference_encoding.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, query("op8_byte_bpe").collect())) == sorted(want)


def test_byte_bpe_on_random_texts(reference_encoding):
    rng = np.random.default_rng(8)
    letters = np.array(list("abcstmdrevl'''    \n\t\r\x0b\x85\xa01290,.;!$%é漢😀́​²Ⅷ"))
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)]
    texts += ["a" * 300, "!" * 400, " " * 70, "'s", " 's", "\n's", "x's'd'll re's"]
    vocab = byte_bpe.vocabulary(BYTES)
    ids, starts, ends = vocab.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[ends[i]:ends[i + 1]].tolist() == reference_encoding.encode_ordinary(t), repr(t)
        assert vocab.decode(ids[ends[i]:ends[i + 1]]).tobytes() == t.encode()


def test_byte_bpe_edges(odd, empty, reference_encoding):
    rows = byte_bpe.encode(odd, BYTES).collect()
    texts = sorted(len(reference_encoding.encode_ordinary(r["text"] or "")) for r in odd.collect())
    assert sorted(r["n_tokens"] for r in rows) == texts
    assert byte_bpe.decode(byte_bpe.encode(empty, BYTES), BYTES).count() == 0


# ---- 9: language model -------------------------------------------------------------------

def test_language_model(query, documents):
    rows = query("op9_lm_scores").collect()
    want = brute.unigram_scores(documents)
    assert len(rows) == len(documents)
    for r in rows:
        held, n, known, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    unseen = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen) + 0.1 * sum(r["n_tokens"] for r in unseen)


def test_seating_matches_the_exact_distribution():
    """Tables of one dish with three customers, against enumeration of all seatings."""
    d, strength, base = 0.3, 1.5, 0.2
    # weights of the partitions of three customers into 1, 2, 3 tables
    w = np.array([(1 - d) * (2 - d) * base, 3 * (1 - d) * (strength + d) * base**2,
                  (strength + d) * (strength + 2 * d) * base**3])
    exact = (w * [1, 2, 3]).sum() / w.sum()
    n = 4000
    tables, opened = pitman_yor.seat(np.arange(n), np.full(n, 3), np.full(n, base), d, strength, 1, 3, 6)
    assert tables.mean() == pytest.approx(exact, abs=0.02)
    assert np.allclose(tables, opened)


def test_class_probabilities_sum_to_one(spark):
    pairs = spark.createDataFrame([(u, v, 1 + (u * v) % 700) for u in range(0, 40) for v in range(0, 60)], "u int, v int, c long")
    model = pitman_yor.class_model(pairs)
    assert np.allclose((10.0 ** model.astype(float)).sum(1), 1, atol=1e-4)
    assert model[39, 59] > model[39, 200]


def test_language_model_edges(odd, empty):
    rows = pitman_yor.score_documents(odd).collect()
    assert len(rows) == 18 and all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)} == {1}
    assert pitman_yor.score_documents(empty).count() == 0
    assert pitman_yor.perplexity(pitman_yor.score_documents(odd)).count() <= 2


# ---- 10: main text -----------------------------------------------------------------------

def test_main_text(query, spark, sf):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = query("op10_main_text").collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|<footer)", pages[r["page_id"]], re.S)[1]
        plain = re.sub(r"</?(p|h1|br)>", " ", re.sub(r"</?b>", "", article))
        assert r["text"] == " ".join(html.unescape(plain).split()) and r["n_chars"] == len(r["text"])


ARTICLE = "<p>One, two, three, and some more words to make it long.</p><p>Short.</p><ul><li>a</li><li>b &amp; c</li></ul>"


@pytest.mark.parametrize("page", [
    f'<body><header><p>The site, with, many, commas, in, its, header line</p></header><article>{ARTICLE}</article></body>',
    f'<body><nav><a href="/">Home page of the site</a></nav><div id="content">{ARTICLE}</div><footer>Foot, of, the page</footer>',
    f'<div class="sidebar"><p>Side, side, side, and more text, more than the article has, by far, yes.</p></div><main>{ARTICLE}</main>',
    f'<article>{ARTICLE}<div class="ad">Buy, buy, buy now and here</div><script>var a = "<p>x</p>";</script></article>',
    f'<article>{ARTICLE}</article><section id="comments"><p>I like this, very much, thank you, really, a lot</p></section>',
    f'<article>{ARTICLE}<form><p>Name, address, and all else we want to know</p></form><style>p {{}}</style></article>',
    f'<div class="cookie-notice"><p>We use cookies, many, many of them, everywhere.</p></div><article>{ARTICLE}<!-- <p>no</p> --></article>',
    f'<div class="site-widget">{ARTICLE}</div>',
    f'<div class="page-header"><p>Header, header, header, and a long line of it.</p></div><div>{ARTICLE}</div>',
    f'<body><div><div class="post-body">{ARTICLE}</div></div><aside><p>Aside, aside, and aside, with long text.</p></aside>',
])
def test_main_text_of_layouts(page):
    assert main_text.main_text(page) == "One, two, three, and some more words to make it long. Short. a b & c"


def test_main_text_edges(spark):
    assert main_text.main_text("<b>" * 30_000 + "deep") == "deep"
    assert main_text.main_text("a &lt;b&gt;&nbsp; c") == "a <b> c"
    assert main_text.main_text("<p>un<b>closed<p>next <i>one") == "unclosed next one"
    rows = [(1, None, None), (None, "u", ""), (3, "u", "<nav>x</nav>"), (3, "u", "<nav>x</nav>"), (4, "u", "<p>t</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(r["text"] for r in main_text.extract(pages).collect()) == ["", "", "", "", "t"]
    assert main_text.extract(pages.limit(0)).count() == 0
