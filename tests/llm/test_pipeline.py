"""The pipeline, stage by stage, against plain Python over the same rows."""

import re

import corpus_pipeline
from test_pipeline_parts import brute_components, check_packing

SF_DIR = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    columns, tables = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        tables.append(docs.collect())
        assert name == "packing" or docs.columns == columns
    first, lines, near, clean, packed = tables
    given = {r["doc_id"]: r["text"] for r in first}
    assert len(first) >= 0.99 * spark.read.parquet(f"{SF_DIR}/documents.parquet").count()

    key = lambda line: lower(line.strip(BLANKS))
    holders = {}
    for doc_id, text in given.items():
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc_id)
    shared = {k: min(ids) for k, ids in holders.items() if len(k) >= 10 and len(ids) > 1}
    for r in lines:
        kept = [x for x in (given[r["doc_id"]] or "").split("\n") if shared.get(key(x), r["doc_id"]) == r["doc_id"]]
        assert r["text"] == "\n".join(kept) and r["n_chars"] == len(r["text"])

    groups = brute_components([(r["doc_id"], r["text"]) for r in lines])
    assert {r["doc_id"] for r in near} == {c for _, _, c in groups}

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for text in bench:
        words = word.findall(lower(text))
        n = min(10, len(words))
        windows |= {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
    for r in near:
        words = word.findall(lower(r["text"]))
        hit = any(tuple(words[k : k + n]) in windows for n in {len(w) for w in windows} for k in range(len(words) - n + 1))
        assert hit != (r["doc_id"] in {c["doc_id"] for c in clean})

    sequences, pieces = check_packing(packed, 4096)
    assert set(pieces) == {r["doc_id"] for r in clean}
    assert len(sequences) <= -(-sum(r["length"] for r in packed) // 4096) + 1
    assert corpus_pipeline.run(spark, SF_DIR).count() == len(packed)
