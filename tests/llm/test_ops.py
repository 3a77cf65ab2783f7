"""The corpus operators on small tables: odd rows, round trips and brute force."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelspark.llm import bm25, decontam, langid, maglev, neardup, orc_tokens, packing, quality, urlfilter, warc
from panelspark.llm.common import shared_folder
from panelspark.llm.components import connected_components, rooted
from panelspark.llm.tokens import PieceEncoder

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, term string, rejected string"
BASE = " ".join(f"word{k}" for k in range(60))
LONG = " ".join(f"tok{k % 977}" for k in range(30_000))
ROWS = [
    (1, BASE, "en", "s", 1, 0, "x", "y"),
    (2, BASE, None, None, None, None, None, None),
    (3, BASE + " more", "en", "s", 1, 0, "x", "y"),
    (4, None, "en", "s", 1, 0, "x", "y"),
    (5, "", "de", "s", 1, 0, "x", "y"),
    (6, " \n\t ", "de", "s", 1, 0, "x", "y"),
    (7, "Été à la plage", "fr", "s", 1, 0, "x", "y"),
    (8, LONG, "en", "s", 1, 0, "x", "y"),
    (9, "12 34 !!", "en", "s", 1, 0, "x", "y"),
    (9, "12 34 !!", "en", "s", 1, 0, "x", "y"),
    (None, "no id here at all", "en", "s", 1, 0, "x", "y"),
    (11, "ab  cd\n ef", "en", "s", 1, 0, "x", "y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return (row["doc_id"] is None, row["doc_id"] or 0)


def test_piece_encoder_equals_the_tokenizer():
    texts = [r[1] for r in ROWS] + ["a\n b", "Don't  STOP now's", "é ́é x", "日本 語 12 3,4", "<|endoftext|> a <|startoftext|>b", "word!! word? (a) |a", "İ K ﬁ ſ", "x\x1cy \x85 q", " lead", "trail ", "!'s 's. 2's", "a“b” c’s — d… x", "×é÷ İ"]
    rng = np.random.default_rng(3)
    alphabet = [*"abZ 12 .,'<|\n\t  éÀßİ×́  日αſ\x1c$=", "'s", "\n\n", "  "]
    texts += ["".join(rng.choice(alphabet, rng.integers(1, 30))) for _ in range(5000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
        for most in (0, 3, 10_000):
            own = PieceEncoder(path, most)
            for _ in range(2):
                got = [ids[a:b].tolist() for _, ids, edges in own.encode(pa.array(texts), 5000) for a, b in zip(edges[:-1], edges[1:])]
                assert got == want


def test_token_orc(spark, docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = sorted(orc_tokens.token_orc(spark, docs, path).collect(), key=lambda r: r["start"])
    assert len(got) == len(ROWS) and got[0]["doc_id"] is None
    tokenizer, start = Tokenizer.from_file(path), 0
    for (doc_id, text, *_), row in zip(sorted(ROWS, key=lambda r: -1 if r[0] is None else r[0]), got):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(row) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert orc_tokens.token_orc(spark, none, path).count() == 0
    folder = shared_folder(spark, "t.orc")
    orc_tokens.write_orc(docs, path, 2, folder)
    # Every row has its ordinal in its file.
    files = orc_tokens.read_orc(spark, folder).groupBy("part").agg(F.sort_array(F.collect_list("ordinal")).alias("o")).collect()
    assert all(r["o"] == list(range(len(r["o"]))) for r in files)
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in orc_tokens.read_orc(spark, folder).filter("doc_id = 7")._jdf.queryExecution().toString()


def _reader_options(spark):
    return spark._jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration())


def test_orc_files_have_bloom_filters_and_skip_rows(spark, tmp_path):
    rows = spark.createDataFrame([(7 * k, f"text number {k}") for k in range(30_000)], "doc_id long, text string").coalesce(1)
    folder = "file://" + str(tmp_path / "t.orc")
    orc_tokens.write_orc(rows, public_tokenizers.path("word_bpe_49k.json"), 2, folder, row_index_stride=1000)
    jvm = spark._jvm
    names = [str(p) for p in sorted((tmp_path / "t.orc").glob("*.orc"))]
    kinds, entries = set(), 0
    for name in names:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(name), _reader_options(spark))
        stripes = reader.rows()
        for k in range(reader.getStripes().size()):
            footer = stripes.readStripeFooter(reader.getStripes().get(k))
            column = reader.getSchema().findSubtype("doc_id").getId()
            kinds |= {(s.getKind().toString()) for s in footer.getStreamsList() if s.getColumn() == column}
            entries += -(-reader.getStripes().get(k).getNumberOfRows() // reader.getRowIndexStride())
        stripes.close()
    assert "BLOOM_FILTER_UTF8" in kinds and "ROW_INDEX" in kinds and entries >= 30
    # A value between the ids lies within a row group's bounds, so only its Bloom filter can rule it out; a lookup of a
    # value that is there reads one row group of 1000 rows.
    def rows_read(condition):
        found = orc_tokens.read_orc(spark, folder).filter(condition).select("doc_id")
        n = found.count()
        plan = found._jdf.queryExecution().executedPlan()
        found.collect()
        metrics = [m for m in (plan.collectLeaves().apply(k) for k in range(plan.collectLeaves().size()))]
        return n, sum(leaf.metrics().apply("numOutputRows").value() for leaf in metrics)

    n, read = rows_read("doc_id = 70007")
    assert n == 1 and 0 < read <= 1024
    n, read = rows_read("doc_id = 70008")
    assert n == 0 and read <= 1024


def test_bm25_equals_brute_force(docs, none):
    rows = [(r[0], r[1]) for r in ROWS if r[0] is not None]
    own = docs.filter("doc_id is not null")
    got = sorted(tuple(r) for r in bm25.search(own, own.filter("doc_id % 2 = 1"), 3).collect())
    want = sorted(brute.bm25(rows, [r for r in rows if r[0] % 2], 3))
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    assert bm25.search(docs, docs, 2).filter("doc_id is null").count() >= 1
    assert bm25.search(none, none).count() == 0


def _texts_of_topics(n, seed):
    """Texts of five topics with common words, some of them copies of others."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        topic, size = k % 5, int(rng.integers(5, 60))
        own = [f"t{topic}w{min(int(rng.exponential(12)), 60)}" if rng.random() < 0.7 else f"c{rng.integers(8)}" for _ in range(size)]
        rows.append((k, rows[k - 7][1] if k > 10 and rng.random() < 0.2 else " ".join(own)))
    return rows


def test_bm25_over_several_shards_equals_brute_force(spark):
    rows = [*_texts_of_topics(700, 3), (700, "c1 " * 70_000 + "t1w1"), (701, None), (702, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in bm25.search(table, table.filter("doc_id % 10 = 0"), 7, postings=2500).collect())
    want = sorted(brute.bm25(rows, [r for r in rows if r[0] % 10 == 0], 7))
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])


@pytest.mark.parametrize("dense, long, block", [(1, 0.01, 16), (8_000_000, 0.01, 4), (8_000_000, 0.0, 16), (20_000, 0.05, 64)])
def test_pruning_loses_no_hit(monkeypatch, dense, long, block):
    for name, value in (("DENSE", dense), ("LONG", long), ("BLOCK", block)):
        monkeypatch.setattr(bm25, name, value)
    rows = _texts_of_topics(1500, 4)
    found = [(t, c, n) for _, own, sizes in bm25._terms(pa.array([t for _, t in rows])) for (t, c), n in zip(own, sizes.tolist())]
    sizes = np.array([n for *_, n in found], dtype=np.float64)
    columns = [[0] * len(rows), [i for i, _ in rows], sizes.astype(int).tolist(), [t.tobytes() for t, _, _ in found], [c.astype(np.uint16).tobytes() for _, c, _ in found]]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["shard", "doc_id", "size", "terms", "counts"])
    index = bm25.ShardIndex(iter([batch.slice(0, 600), batch.slice(600)]), sizes.mean())
    frequency = dict(zip(*(x.tolist() for x in np.unique(np.concatenate([t for t, _, _ in found]), return_counts=True))))
    queries = [(t, c * np.log1p((1500 - np.array([frequency[x] for x in t.tolist()]) + 0.5) / (np.array([frequency[x] for x in t.tolist()]) + 0.5))) for t, c, _ in found[::25]]
    plainly = index.search(queries, 5)
    limited = index.search(queries, 5, np.array([s[2] if len(s) > 2 else 0.0 for _, s in plainly]))
    assert all(a.tolist() == b[: len(a)].tolist() and len(a) >= min(3, len(b)) for (a, _), (b, _) in zip(limited, plainly))
    for (terms, weights), (ids, scores) in zip(queries, plainly):
        weight = dict(zip(terms.tolist(), weights.tolist()))
        plain = [round(sum(weight.get(x, 0.0) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / sizes.mean())) for x, n in zip(t.tolist(), c.tolist())), 9) for t, c, size in found]
        best = sorted((-x, i) for i, x in enumerate(plain) if x > 0)[:5]
        assert ids.tolist() == [i for _, i in best] and np.allclose(scores, [-x for x, _ in best])
    assert index.reached <= index.scored < index.open if block == 4 else index.reached <= index.open


def test_bm25_scores_only_blocks_that_a_query_can_reach():
    rng = np.random.default_rng(7)
    texts = [" ".join(f"{'ab'[k % 2]}{w}" for w in rng.integers(0, 60, 40)) for k in range(1024)]  # two languages without a common word
    found = [(t, c) for _, own, _ in bm25._terms(pa.array(texts)) for t, c in own]
    sizes = np.full(len(texts), 40)
    packed = [pa.array([x.tobytes() for x in part], pa.binary()) for part in ([t for t, _ in found], [c.astype(np.uint16) for _, c in found])]
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(1024, np.int32)), pa.array(np.arange(1024)), pa.array(sizes), *packed], names=["shard", "doc_id", "size", "terms", "counts"])
    index = bm25.ShardIndex(iter([batch]), 40.0)
    queries = [(t, c.astype(np.float64)) for t, c in found[:60]]
    got = index.search(queries, 5)
    # Both languages are asked for together; queries that stand in one batch needn't share their blocks.
    assert index.scored <= 0.6 * index.open
    for (terms, weights), (ids, scores) in zip(queries, got):
        of = dict(zip(terms.tolist(), weights.tolist()))
        plain = [round(sum(of.get(t, 0) * n * 2.2 / (n + 1.2) for t, n in zip(own.tolist(), counts.tolist())), 9) for own, counts in found]
        want = sorted((-s, k) for k, s in enumerate(plain) if s > 0)[:5]
        assert ids.tolist() == [k for _, k in want] and np.allclose(scores, [-s for s, _ in want])


def test_language_id(docs, none):
    model = langid.fit(docs)
    got = sorted(langid.predict(docs, model).collect(), key=key)
    assert len(got) == len(ROWS) and all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (4, 5, 6, 9))
    assert {r["lang_pred"] for r in got if r["doc_id"] == 7} == {"fr"} and got[0]["term"] == "x"
    assert langid.predict(none, model).count() == 0
    with pytest.raises(ValueError):
        langid.fit(none)


def test_prediction_equals_a_plain_centroid_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs.filter("doc_id % 2 = 0"), per_lang=40)
    rows = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    kinds = {c: (c if "a" <= c <= "z" else c.lower() if "A" <= c <= "Z" else "0" if c.isdigit() else " ") for c in map(chr, range(128))}
    for r in docs.limit(40).collect():
        if not any(ch.isalpha() for ch in r.text or ""):
            continue
        raw = bytes(ord(kinds[chr(b)]) if b < 128 else b for b in r.text.encode())
        counts = np.zeros(langid.DIMS)
        for k in range(len(raw) - 1):
            pair = raw[k] * 256 + raw[k + 1]
            if pair != 32 * 257:
                counts[(pair * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
            if k + 2 < len(raw):
                counts[((pair * 256 + raw[k + 2]) * 0x85EBCA77 & 0xFFFFFFFF) >> 20] += 1
        v = np.log1p(counts) * model.idf
        v /= np.linalg.norm(v)
        best = max(range(len(model.langs)), key=lambda k: float(v @ model.centroids[k]))
        assert rows[r.doc_id].lang_pred == model.langs[best] and abs(rows[r.doc_id].score - float(v @ model.centroids[best])) < 1e-3


def test_texts_of_no_learned_language_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.filter("doc_id % 5 != 0"))
    foreign = ["Это обычный русский текст о погоде и людях, которые живут в большом городе. " * 5, "Αυτό είναι ένα ελληνικό κείμενο για τον καιρό και τους ανθρώπους. " * 5, "今日は天気がいいですね。" * 20, "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQgZW5jb2RlZA== " * 8]
    rows = spark.createDataFrame(list(enumerate(foreign)), "doc_id long, text string")
    assert langid.predict(rows, model).filter("not rejected").count() == 0
    own = langid.predict(docs.filter("doc_id % 5 = 0"), model)
    assert own.filter("lang_pred != 'und' and rejected").count() == 0 and own.filter("lang_pred != lang").count() <= 2


def test_copies_do_not_fill_the_language_sample(spark):
    rng = np.random.default_rng(3)
    texts = [(" ".join(f"{lang}{rng.integers(300)}" for _ in range(40)), lang) for lang in ("en", "de") for _ in range(12)]
    once = spark.createDataFrame(texts, "text string, lang string")
    copied = once.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(30)))).repartition(5)
    want, got = (langid.fit(rows, per_lang=50) for rows in (once, copied))
    assert np.allclose(got.idf, want.idf) and np.allclose(got.centroids, want.centroids) and np.allclose(got.least, want.least)


def test_maglev(spark, docs, none):
    names = [f"s{k}" for k in range(7)]
    table = maglev.lookup_table(names, 1009)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = maglev.lookup_table(names[:-1], 1009)
    assert np.mean([a == b for a, b in zip(table, fewer) if a != 6]) > 0.8
    got = maglev.place(docs.withColumn("shard", F.lit(1)), "doc_id", names, 1009).collect()
    assert len(got) == len(ROWS) and [r["shard"] for r in got if r["doc_id"] is None] == [None]
    assert len({r["shard"] for r in got if r["doc_id"] == 9}) == 1 and maglev.place(none, "doc_id", names).count() == 0
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            maglev.lookup_table(bad)
    with pytest.raises(ValueError):
        maglev.lookup_table(["a"], 1000)


def test_lookup_table_equals_a_plain_fill():
    names, size = [f"shard {k}" for k in range(5)], 101
    number = lambda name, salt: int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)
    wishes = {n: iter([(number(n, "offset") + j * (number(n, "step") % (size - 1) + 1)) % size for j in range(size)]) for n in names}
    held = {}
    while len(held) < size:
        for k, n in enumerate(names):
            slot = next((x for x in wishes[n] if x not in held), None)
            if slot is not None and len(held) < size:
                held[slot] = k
    assert maglev.lookup_table(names, size) == [held[x] for x in range(size)]


def test_warc(spark):
    rows = [(1, "http://a/é b", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "ü" * 100_000), (None, "u", "same"), (6, "u", "x"), (6, "u", "x"), *((k, "u", f"<p>{k} filler text number {k % 7}</p>" * 20) for k in range(10, 60))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(warc.round_trip(spark, pages).collect(), key=lambda r: (r["page_id"] or 0, r["record_type"]))
    assert len(got) == len(rows)
    for r in got:
        payloads = {p or "" for i, _, p in rows if i == r["page_id"]}
        assert r["payload_bytes"] in {len(p.encode()) for p in payloads} and r["payload_digest"] in {warc.payload_digest(p.encode()) for p in payloads}
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got}
    assert {(None, "revisit", 2), (1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (6, "response", None), (6, "revisit", 6)} <= kinds
    nameless = spark.createDataFrame([(None, "u", "z", "s")] * 3, "page_id long, url string, html string, sha string")
    assert sorted((r["record_type"], r["refers_to"]) for r in warc.round_trip(spark, nameless).collect()) == [("response", None), ("revisit", None), ("revisit", None)]
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_warc_files_that_end_early_are_refused(spark):
    pages = spark.createDataFrame([(k, "u", f"page {k}" * 50) for k in range(30)], "page_id long, url string, html string").coalesce(1)
    folder = shared_folder(spark, "w")
    files = warc.write(pages, folder, b"").cache()
    name = files.first()["file"]
    whole = open(name, "rb").read()
    with open(name, "rb") as stream:
        held = list(warc.records(stream))
    assert len(held) == files.first()["records"]
    last = len(zstandard.ZstdCompressor(level=warc.LEVEL, write_checksum=True).compress(held[-1]))
    for cut in (10, last):  # within the last record; before it
        open(name, "wb").write(whole[:-cut])
        with pytest.raises(Exception, match="were written|within a record"):
            warc.read(spark, folder, files).count()


def test_packing(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(packing.cut_pieces(docs, path, 2)).collect()
    tokenizer, want = Tokenizer.from_file(path), []
    for doc_id, text, *_ in ROWS:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)]
        want += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(packing.cut_pieces(none, path, 2)).count() == 0


def test_packing_reaches_its_bound(spark):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1024, 3000)
    pieces = spark.createDataFrame([(k, k, 0, 0, int(n), 0) for k, n in enumerate(lengths)], "piece_key long, doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack(pieces, per_partition=400).cache()
    used, bound = packing.certificate(packed)
    assert packed.count() == 3000 and bound <= used <= 1.03 * bound
    assert packing.lower_bound(np.bincount([600] * 5, minlength=1025), 1024) == 5


def test_url_rules(spark):
    rules = urlfilter.rule_table(spark, [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "example.net/de/8"), ("allow", "net/de/")])
    urls = [("http://EXAMPLE.com/en/71?x", "example.com/en/7", "allow"), ("https://a.b.com/en/", "com/en/", "block"), ("x://com/en", None, "allow"), (None, None, "allow"), ("example.com/en/7", None, "allow"), ("http://example.net/de/8#f", "example.net/de/8", "block"), ("http://notcom/en/", None, "allow"), ("http://n.net/de/8", "net/de/", "allow"), ("://", None, "allow")]
    pages = spark.createDataFrame([(k % 5, u) for k, (u, _, _) in enumerate(urls)], "page_id long, url string")
    got = sorted((r["page_id"], r["rule"] or "", r["verdict"]) for r in urlfilter.judge(pages, rules).collect())
    assert got == sorted((k % 5, rule or "", verdict) for k, (_, rule, verdict) in enumerate(urls))
    assert urlfilter.judge(pages, rules.limit(0)).filter("verdict = 'allow'").count() == len(urls) and urlfilter.judge(pages.limit(0), rules).count() == 0


def test_decontamination(spark, docs, none):
    items = [(1, " ".join(f"WORD{k}," for k in range(20, 40))), (2, "la plage"), (3, None), (4, "!!"), (5, "absent words"), (10, "12 34")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r for r in decontam.decontaminate(docs, benchmark).collect()), key=key)
    assert len(got) == len(ROWS)
    for r, (doc_id, text, *_) in zip(got, sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0))):
        words, hit, names = brute.words(text), set(), set()
        for item, t in items:
            own = brute.words(t)
            for at in range(max(1, len(own) - 12) if own else 0):
                run = own[at : at + 13]
                for k in range(len(words) - len(run) + 1):
                    if words[k : k + len(run)] == run:
                        hit |= set(range(k, k + len(run)))
                        names.add(item)
        assert (r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) == (doc_id, len(words), len(hit), len(names))
    assert decontam.decontaminate(none, benchmark).count() == 0
    assert decontam.decontaminate(docs, benchmark.limit(0)).filter("contaminated").count() == 0
    assert {(r["doc_id"], r["item_id"]) for r in decontam.proximity(docs, benchmark.filter("item_id in (1, 2)")).collect()} >= {(1, "1"), (7, "2")}


def test_proximity_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    spread = ["x"] * 120
    spread[95], spread[100], spread[106], spread[109] = "a", "r", "a", "b"
    texts = [(1, " ".join(spread)), (None, "q r a b"), (2, None)]
    texts += [(k, " ".join(rng.choice(["a", "b", "r", *"uvwxyz"], 150, p=[0.1, 0.06, 0.03] + [0.135] * 6))) for k in range(3, 9)]
    texts += [texts[-1], (8, "r b a")]
    items = [(1, "r a b"), (2, "a a b"), (3, "r"), (4, "a missing")]
    want = set()
    for doc_id, text in texts:
        words = brute.words(text)
        for item, t in items:
            own, reach = set(brute.words(t)), len(brute.words(t)) + 8
            for last in range(len(words)):
                places = [max((p for p in range(last + 1) if words[p] == w), default=-1) for w in own]
                if words[last] in own and min(places) >= 0 and last - min(places) < reach:
                    want.add((doc_id, str(item), min(places), last))
    docs, benchmark = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontam.proximity(docs, benchmark).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {(1, "1", 100, 109), (None, "1", 1, 3)} <= want


def test_near_duplicates(spark, docs, none):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    want = brute.near_duplicates([(r[0], r[1]) for r in ROWS if r[0] is not None])
    assert [g for g in got if g[0] is not None] == sorted(((i, *want[i]) for i, *_ in ROWS if i is not None))
    assert got[-1] == (None, 1, None) and neardup.near_duplicates(none).count() == 0


def test_near_duplicates_of_a_wide_group(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(400):
        text = list(base)
        for at in rng.choice(150, rng.integers(0, 5), replace=False):
            text[at] = f"v{rng.integers(10**6)}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(f"z{rng.integers(10**6)}" for _ in range(50))) for i in range(50)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute.near_duplicates(rows).items()}


def test_isolated_pairs_meet_below_wide_nodes(spark):
    rng = np.random.default_rng(11)
    n = 12_000
    left = rng.integers(0, 1 << 32, (n, neardup.TOKENS), dtype=np.uint32)
    right = np.where(rng.random(left.shape) < 0.75, left, rng.integers(0, 1 << 32, left.shape, dtype=np.uint32))
    reps = [(2 * k + side, bytearray(x[k].tobytes())) for k in range(n) for side, x in enumerate((left, right))]
    table = spark.createDataFrame(reps, "rep long, tokens binary").repartition(4)
    nodes = neardup._walk(table, 1, True).select("node", "rep").distinct()
    # Every node of the first level counts as wide, down to where its children hold no pair but this one.
    found = neardup.narrowed_nodes(neardup.open_nodes(nodes, None), None, table, [], most_work=2).toPandas()
    met = found.assign(pair=found.rep // 2).drop_duplicates().groupby(["pair", "node"]).size()
    missed = n - met[met == 2].reset_index().pair.nunique()
    assert missed <= 6  # about 1 expected


@pytest.mark.parametrize("block, small, most_work", [(16, 4, 1 << 21), (64, 24, 2000)])
def test_blocks_lose_no_link(spark, monkeypatch, block, small, most_work):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "MOST_WORK", most_work)
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for i in range(300):  # most pairs lie about 0.75, some groups only hang together by one link
        text = list(base)
        for at in rng.choice(90, rng.integers(1, 6), replace=False):
            text[at] = f"v{rng.integers(10**6)}"
        rows.append((i, " ".join(text)))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), least_estimate=0).collect()}
    want = {i: c for i, (_, c) in brute.near_duplicates(rows).items()}
    assert got == want and 10 < len(set(want.values())) < 290


def test_sketches_of_long_texts_tell_them_apart():
    rng = np.random.default_rng(4)
    for n in (100, 500, 2000):
        common = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        own = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2)]
        cut = 6 * n // 7  # 6 of 8 shingles in common: 0.75
        near = [np.concatenate((common[:cut], x[: n - cut])) for x in own]
        sketch = neardup._bytes(neardup._minwise([*own, *near]))
        agree = neardup._agreement(sketch[[0, 2]], sketch[[1, 3]])
        assert agree[0] < 0.1 and abs(agree[1] - 0.75) < 0.15


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    for one_task in (0, 1000):
        got = dict(map(tuple, connected_components(edges, one_task=one_task).collect()))
        assert got == {k: 0 for k in range(61)} | {k: 100 for k in (100, 101, 102)}
    assert connected_components(edges.limit(0)).count() == 0
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3000, (2, 2000))
    nodes, roots = rooted(a, b)
    plain = {int(x): int(x) for x in nodes}
    for _ in range(60):
        for x, y in zip(a.tolist(), b.tolist()):
            plain[x] = plain[y] = min(plain[x], plain[y])
    assert dict(zip(nodes.tolist(), roots.tolist())) == plain


def test_compiled_rules_equal_the_rules(spark, docs):
    rng = np.random.default_rng(5)
    names, rules = quality.STATISTICS, []
    for _ in range(60):
        tests, start = [], int(rng.integers(3))
        for depth in range(int(rng.integers(1, 4))):
            tests.append((names[(start + depth) % 4], bool(rng.integers(2)), float(rng.integers(1, 4))))
        rules.append(quality.Rule(tuple(tests), float(rng.normal())))
    model = quality.RuleEnsemble(0.25, tuple(rules))
    got = quality.with_statistics(docs.select("text")).select("__statistics.*", model.score("__statistics").alias("score")).toPandas()
    x = got[list(names)].to_numpy()
    want = 1 / (1 + np.exp(-(0.25 + sum(r.weight * r.holds(x) for r in rules))))
    assert np.allclose(got["score"], want) and len(set(want.round(6))) > 3
    assert np.allclose(docs.select(quality.RuleEnsemble(-1.0, ()).score("none").alias("s")).toPandas()["s"], 1 / (1 + np.e))


def test_conflicting_labels_and_repeated_ids_are_settled(spark):
    texts = [("Good plain sentences of many different words, number %d. " % k) * 2 if k % 2 else "spam spam spam " * (3 + k % 9) for k in range(120)]
    rows = [*enumerate(texts), *((k, "another text of that id") for k in range(0, 120, 6))]
    labels = [*((k, k % 2) for k in range(120)), *((k, 1) for k in range(0, 120, 10)), (None, 0), (3, None)]
    models = []
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        marks = spark.createDataFrame(labels, "doc_id long, quality int").repartition(parts)
        models.append(quality.fit(docs, marks))
    assert models[0] == models[1]


def test_quality_rules(spark, docs, none):
    rng = np.random.default_rng(2)
    texts = [("Good plain sentences of many different words, number %d. " % k) * 2 if k % 2 else "spam spam spam spam " * int(rng.integers(3, 20)) for k in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = quality.fit(rows, rows.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))
    assert quality.scored(rows, model).filter("predicted = doc_id % 2").count() > 195
    got = quality.scored(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got) and quality.scored(none, model).count() == 0
    with pytest.raises(ValueError):
        quality.fit(rows, rows.selectExpr("doc_id", "1 as quality"))
