"""The stages of the corpus pipeline against plain versions of their decisions."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from courtside.llm import linedup, mixing, packing, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], SF).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        seen.append(out)
    raw, good, cut, single, mix, packed = ([r.asDict() for r in df.collect()] for df in seen)

    scores = {r.doc_id: r.predicted for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in good} == {i for i, p in scores.items() if p}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in {r["doc_id"] for r in good} for i in clean) >= 0.99 * len(clean)
    assert any(labels.get(r["doc_id"]) == 0 and zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in raw if not scores[r["doc_id"]])

    gone = {r.doc_id: r.gone for r in linedup.repeated_lines(seen[1]).collect()}
    texts = {r["doc_id"]: r["text"] for r in good}
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, [])) for i, t in texts.items()}
    assert {r["doc_id"]: r["text"] for r in cut} == {i: t for i, t in want.items() if t.split() or not gone.get(i)}
    assert all(r["n_chars"] == len(r["text"]) for r in cut)

    assert {r["doc_id"] for r in single} <= {r["doc_id"] for r in cut} and len({r["text"] for r in single}) == len(single)

    taken = {r.doc_id: (r["size"], r.taken) for r in mixing.mix_plan(seen[3]).collect()}
    assert Counter(r["doc_id"] for r in mix) == Counter({i: int(n / s + 0.5) for i, (s, n) in taken.items() if s and int(n / s + 0.5)})

    words = Counter()
    for r in packed:
        words[r["doc_id"]] += r["words"]
    assert words == sum((Counter({r["doc_id"]: len(r["text"].split())}) for r in mix), Counter())
    fill = Counter()
    for r in packed:
        fill[r["bin_id"]] += r["words"]
    assert max(fill.values()) <= packing.CAPACITY


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def folder(spark, tmp_path, rows, labels):
    """A data set of its own: documents with columns that clash with the stages' inner ones."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, kind).withColumns({c: F.lit(11) for c in ("row", "size", "score", "t1", "_t1", "plan", "gone", "rest", "k", "times", "bin_id")})
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    return f"file://{tmp_path}", docs


def test_stages_on_nulls_repeats_and_clashing_columns(spark, tmp_path):
    texts = [f"sentence {i} is about item {i * 7} and place {i * 13} of the year {1900 + i}" for i in range(60)]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3]] + [(None, "a text without an id that stands alone here", "en", "a", 10), (None, None, None, None, None), (100, None, "en", "a", 0), (101, "", "en", None, 0), (102, " \n ", "en", "b", 3), (103, texts[5] + " tail", "en", "b", 90), (104, "word " * 50_000, "en", "a", 250_000)]
    labels = [(i, int(i % 10 != 0), 0) for i in range(40)] + [(None, 1, 0), (500, None, 0)]
    sf, docs = folder(spark, tmp_path, rows, labels)
    seen = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen, sf).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.where("row <> 11 or t1 <> 11 or bin_id <> 11").count() == 0
        if k == 2:  # one row of each text, whatever repeats it
            kept = [r.text for r in out.collect() if r.doc_id is not None]
            assert len(set(kept)) == len(kept)
        seen = out
    packed = seen.collect()
    assert packed and corpus_pipeline.run(spark, sf).count() == len(packed)
    assert {r["doc_id"] for r in packed} <= {r[0] for r in rows}
    assert None in {r["doc_id"] for r in packed} and 104 in {r["doc_id"] for r in packed}  # nothing goes for want of an id, or for its length


def test_run_on_empty_tables(spark, tmp_path):
    sf, _ = folder(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_run_without_labels(spark, tmp_path):
    sf, _ = folder(spark, tmp_path, [(1, "one two three", "en", "a", 13), (2, "four five six", "en", "b", 13)], [])
    assert corpus_pipeline.run(spark, sf).count() > 0
