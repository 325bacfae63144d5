"""The pipeline against plain Python, stage by stage, each on the rows that the stage before it kept."""

import zlib
from collections import defaultdict

import corpus_pipeline
from tests.llm import cases, test_near, test_secrets, test_tokens
from voxweave.llm import language
from voxweave.llm.tables import saved, table

SF = "/root/testdata/sf0.001"


def as_rows(df):
    return {r.doc_id: r for r in df.collect()}


def leaks(text, items):
    have = test_near.shingles(text)
    return any(s and 100 * len(s & have) >= 75 * len(s) for s in items)


def redact(text):
    spans = sorted((a, b) for a, _, b in [*test_secrets.base(text), *test_secrets.extra(text, test_secrets.base(text))])
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[REDACTED]"
        at = max(at, b)
    return out + text[at:]


def test_stages_against_plain_versions(spark):
    documents = table(spark, SF, "documents")
    docs, before = documents, as_rows(documents)
    model = language.fit(documents)
    items = [test_near.shingles(r.text) for r in table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, SF))
        assert docs.columns == documents.columns
        after = as_rows(docs)
        if name == "language ID":
            predicted = dict(zip(before, model.predict([r.text or "" for r in before.values()])))
            want = {k for k, p in predicted.items() if p[0] != "und" and p[1] >= 0.5}
        elif name == "n-gram Jaccard join":
            want = {doc for doc, _, least in test_near.brute([(r.doc_id, r.text) for r in before.values()]) if doc == least}
        elif name == "benchmark decontamination":
            want = {k for k, r in before.items() if not leaks(r.text, items)}
        else:
            want = set(before)
            assert all(after[k].text == redact(before[k].text) and after[k].n_chars == len(after[k].text) for k in want)
        assert set(after) == want, name
        if name != "secret scans":
            assert all(after[k] == before[k] for k in after)
        before = after
    test_tokens.check_packing(docs, corpus_pipeline.STAGES[-1][1](spark, docs, SF))
    pieces = corpus_pipeline.run(spark, SF)
    lengths = defaultdict(int)
    for r in pieces.collect():
        lengths[r.doc_id] += r.length
    want = {k: len(test_tokens.whole("byte_bpe_50k.json", r.text, 0)) for k, r in before.items()}
    assert lengths == want and zlib.crc32(b"") == 0


def test_awkward_rows(spark):
    docs = cases.frame(spark, extra=True)
    for frame in (docs, docs.union(docs), cases.empty(spark)):
        now = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = saved(stage(spark, now, SF))
            assert now.columns == corpus_pipeline.COLUMNS
        corpus_pipeline.STAGES[-1][1](spark, now, SF).count()


def test_leaks_without_ids(spark, tmp_path):
    item = "one two three four five six seven"
    spark.createDataFrame([(1, item), (None, "red green blue black white grey")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [(None, "x " + item), (None, "clean without an id"), (None, None), (1, "a " + item), (1, "clean with the same id"), (2, "so red green blue black white grey"), (3, "clean")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts], cases.SCHEMA)
    kept = corpus_pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id) == [(1, "clean with the same id"), (3, "clean")]
    assert {r.text for r in kept.collect() if r.doc_id is None} == {"clean without an id", None}


def test_one_row_of_each_group(spark):
    a = " ".join(f"a{k}" for k in range(60))
    b = " ".join(f"b{k}" for k in range(60))
    c = " ".join(f"c{k}" for k in range(60))
    texts = [(None, a), (None, a + " end"), (7, a), (None, b), (None, b + " end"), (None, b), (5, c), (5, c), (5, "alone with the id of others"), (9, "alone too as it seems"), (None, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts], cases.SCHEMA)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()]
    assert len(kept) == 6 and (7, a) in kept and kept.count((5, c)) == 1
    assert sum(1 for k, t in kept if t and t.startswith("b")) == 1 and (None, None) in kept
    assert {(5, texts[8][1]), (9, texts[9][1])} <= set(kept)
    twice = corpus_pipeline.one_of_each_group(spark, docs.filter("text is not null").union(docs.filter("text is not null")), SF)
    assert twice.count() == 5
