"""The pipeline's stages on the smallest table and on odd rows, each against a plain version."""

import tracemalloc
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from panelspark.llm import langid, quality, queries
from panelspark.llm.common import stored, text_chunks
from tokenizers import Tokenizer

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_stages_keep_the_columns_and_shrink(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    counts = [s.count() for s in steps[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert {r[0] for r in steps[-1].select("doc_id").distinct().collect()} == {r[0] for r in steps[-2].select("doc_id").collect()}


def test_clashing_columns_survive(spark, steps):
    odd = steps[0].withColumnsRenamed({"lang": "score", "source": "rejected", "n_chars": "predicted"})
    for k in (0, 1, 3):
        assert corpus_pipeline.STAGES[k][1](spark, odd, SF).columns == odd.columns
    assert corpus_pipeline.STAGES[0][1](spark, odd, SF).count() == steps[1].count()


def test_every_query_has_the_contracted_columns(spark):
    first = {
        "op1": ["doc_id", "start", "n_tokens", "ids_crc32"], "op3": ["doc_id", "held_out", "lang_pred", "score"], "op5": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        "op6": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"], "op7": ["page_id", "host", "path", "rule", "verdict"],
        "op8": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], "op9": ["doc_id", "n_shingles", "component_id", "kept"], "op10": ["doc_id", "held_out", "score", "predicted"],
    }
    for name, query in queries.queries().items():
        want = first.get(name.split("_")[0])
        if want:
            assert query(spark, SF).columns[: len(want)] == want


def _clean(spark, texts):
    """Whether benchmark windows cover less than a twentieth of each text's words."""
    runs = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        own = brute.words(r.text)
        runs |= {tuple(own[k : k + 13]) for k in range(max(1, len(own) - 12)) if own}
    out = []
    for text in texts:
        words = brute.words(text)
        hit = {p for n in {len(x) for x in runs} for k in range(len(words) - n + 1) if tuple(words[k : k + n]) in runs for p in range(k, k + n)}
        out.append(not hit or 20 * len(hit) < len(words))
    return out


def test_near_dedup_and_decontamination_keep_what_plain_versions_keep(spark, steps):
    rows = [(r.doc_id, r.text) for r in steps[2].select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted({i for i, (_, c) in brute.near_duplicates(rows).items() if i == c})
    rows = [(r.doc_id, r.text) for r in steps[3].select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in steps[4].collect()) == sorted(i for (i, t), x in zip(rows, _clean(spark, [t for _, t in rows])) if x)


def _measured(texts, measure):
    return [x for _, raw, offsets in text_chunks(pa.array(texts, type=pa.string())) for x in measure(raw, offsets)]


def _good(spark, texts, sf=SF):
    model = queries.fitted_quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    x = np.array(_measured(texts, quality.statistics)).reshape(-1, len(quality.STATISTICS))
    return (sum((r.weight * r.holds(x) for r in model.rules), np.full(len(x), model.intercept)) >= 0).tolist()


def _known(spark, texts, sf=SF):
    model = queries.fitted_languages(spark.read.parquet(f"{sf}/documents.parquet"))
    far = _measured(texts, lambda raw, offsets: model.nearest(langid.vectors(raw, offsets))[2])
    return [any(c.isalpha() for c in t or "") and not x for t, x in zip(texts, far)]


def test_quality_and_language_keep_what_plain_versions_keep(spark):
    sf = "/root/testdata/sf0.01"  # at 0.001 the labels are too few for rules
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, plain in ((0, _good), (1, _known)):
        rows = docs.select("doc_id", "text").collect()
        kept = plain(spark, [r.text for r in rows], sf)
        docs = stored(corpus_pipeline.STAGES[k][1](spark, docs, sf), "stage")
        want = sorted(r.doc_id for r, x in zip(rows, kept) if x)
        assert sorted(r.doc_id for r in docs.collect()) == want and 0 < len(want) <= len(rows)
    assert len(want) < 1000


def _packed(rows):
    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, queries.END_ID], "<u4")
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        out += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]
    return sorted(out, key=str)


def test_packing_has_every_piece(steps):
    rows = [(r.doc_id, r.text) for r in steps[-2].select("doc_id", "text").collect()]
    assert sorted((tuple(r)[:5] for r in steps[-1].collect()), key=str) == _packed(rows)


@pytest.fixture(scope="module")
def odd(spark, steps):
    """Null and empty texts and ids, repeated rows, a long text; columns whose names the operators use themselves."""
    plain = [(r.doc_id, r.text) for r in steps[1].select("doc_id", "text").limit(30).collect()]
    rows = [*plain, plain[0], (plain[1][0], plain[2][1]), (plain[3][0], "some other text of this id that stands alone here"), (10**9, None), (10**9 + 1, ""), (10**9 + 1, ""), (10**9 + 2, " \n"), (None, plain[4][1]), (None, None), (10**9 + 3, " ".join(f"tok{k % 977}" for k in range(20_000)))]
    return spark.createDataFrame([(t, i, k % 3, f"n{k % 3}", 1.5, None) for k, (i, t) in enumerate(rows)], "text string, doc_id long, rep int, component string, score double, `c0` string").repartition(3)


def _own(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_stages_on_odd_rows(spark, odd):
    rows = _own(odd)
    texts = [t for _, t in rows]
    quality_kept, language_kept, near_kept, clean = (stage(spark, odd, SF) for _, stage in corpus_pipeline.STAGES[:4])
    assert all(x.columns == odd.columns for x in (quality_kept, language_kept, near_kept, clean))
    assert _own(quality_kept) == [r for r, x in zip(rows, _good(spark, texts)) if x]
    assert _own(language_kept) == [r for r, x in zip(rows, _known(spark, texts)) if x]
    # Rows of one id are one document: it stays or goes with all its texts, of which each stays once.
    ids = sorted({i for i, _ in rows if i is not None})
    sets = {i: {brute.shingles(t) for j, t in rows if j == i} - {frozenset()} for i in ids}
    parent = {i: i for i in ids}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i in ids:
        for j in ids:
            if i < j and any(100 * len(a & b) >= 75 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = [r for r in rows if r[0] is None] + [(i, t) for i, t in {r for r in rows if r[0] is not None} if root(i) == i]
    assert _own(near_kept) == sorted(want, key=str)
    assert _own(clean) == [r for r, x in zip(rows, _clean(spark, texts)) if x]
    packed = corpus_pipeline.STAGES[4][1](spark, odd, SF).collect()
    assert sorted((tuple(r)[:5] for r in packed), key=str) == _packed(rows)


def test_stages_on_an_empty_table(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_read_few_long_texts_at_once(spark, stage):
    for name in ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.unset(name)
    docs = stored(spark.range(1000).selectExpr("id AS doc_id", "repeat('one two ', 10 + id % 7) AS text", "'en' AS lang", "'x' AS source").coalesce(1), "docs")
    stage(spark, docs, SF)
    # The reader's batches of the table: 4096 texts of 100 KB in one don't fit an executor's heap.
    read = docs.select("text")
    plan = read._jdf.queryExecution().executedPlan()
    plan.execute().count()
    while plan.metrics().get("numInputBatches").isEmpty():
        plan = plan.children().apply(0)
    assert plan.metrics().apply("numInputBatches").value() >= 1000 // 128


def test_a_long_text_is_counted_whole_in_bounded_memory(monkeypatch):
    raw = np.random.default_rng(4).choice(np.frombuffer(b"aeiou rstlnm  AZ19.\n", dtype=np.uint8), 8 << 20)
    offsets = np.array([0, len(raw)])
    tracemalloc.start()
    got = langid.vectors(raw, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20  # at once they took over 400 MB
    monkeypatch.setattr(langid, "PIECE", len(raw))
    assert (got == langid.vectors(raw, offsets)).all()
    # Several texts, with edges of pieces at, before and behind their ends.
    short, offsets = raw[:40], np.array([0, 0, 1, 3, 12, 13, 40])
    want = langid.vectors(short, offsets)
    for size in range(1, 15):
        monkeypatch.setattr(langid, "PIECE", size)
        assert (langid.vectors(short, offsets) == want).all()
