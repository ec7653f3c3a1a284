"""The pipeline against the same steps done plainly."""

import re

import corpus_pipeline
from conftest import SF
from test_operators import base_spans

from blockweave.llm import labelled, sentencepiece_scan, toxicity


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert set(docs.columns) <= set(out.columns)
    rows = {r["doc_id"]: r for r in out.collect()}
    model = toxicity.train(labelled.training_rows(docs, spark.read.parquet(f"{SF}/labels.parquet"), "toxic"))
    c = toxicity.Compressors(model)
    left = {r["doc_id"]: r["text"] for r in docs.collect() if c.scores([r["text"].lower().encode()])[0] < 0.7}
    sets = {}
    for i, t in left.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 85 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    left = {i: t for i, t in left.items() if find(i) == i}
    bare = lambda t: re.sub(r"[^0-9a-zA-Z\x80-\U0010ffff]+", " ", t).lower().strip()
    bench = [bare(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(b in bare(t) for b in bench)}
    assert set(rows) == set(left)
    p = sentencepiece_scan.Pieces(sentencepiece_scan.model())
    for i, t in left.items():
        assert ("[SECRET]" in rows[i]["text"]) == bool(base_spans(t)) or "[SECRET]" in t
        assert rows[i]["ids"] == p.sp.encode(rows[i]["text"])
        assert rows[i]["n_chars"] == len(rows[i]["text"])


def test_odd_rows_and_empty_tables(spark, tmp_path):
    item = " ".join(f"item{k}" for k in range(30)) + "."
    long = " ".join(f"w{k % 5000}" for k in range(120_000))
    rows = [(1, "plain words of a clean text, some more of them here"), (2, "plain words of a clean text, some more of them here"), (3, None), (4, ""), (5, None), (None, "no id at all but text"), (6, "before " + item + " after"), (7, "password = hunter22 is here"), (8, long), (9, long + " and an end"), (10, "same row"), (10, "same row")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, spans string, kept string, ids string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x", "y", "z") for i, t in rows], schema)
    for name, table in (("some", docs), ("none", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/some")
    assert set(out.columns) == set(docs.columns)
    got = sorted(((r["doc_id"], r["text"] and r["text"][:30]) for r in out.collect()), key=repr)
    want = [(1, rows[0][1][:30]), (3, None), (4, ""), (5, None), (None, "no id at all but text"), (7, "[SECRET] is here"), (8, long[:30]), (10, "same row"), (10, "same row")]
    assert got == sorted(want, key=repr)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
