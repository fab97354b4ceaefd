import hashlib

import corpus_pipeline
from pyspark.sql import functions as F

from sievelight.llm.queries import word_bpe_path


def test_stages_on_a_small_corpus(spark, tmp_path):
    import tokenizers

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    plain = [f"plain words number {i} of the quiet river text {i * 7} and {i * 13} stones {i * 29} lie there {i}" for i in range(40)]
    rows = [(i, t) for i, t in enumerate(plain)]
    toxic = [(100 + i, plain[i] + " you horrible moron you") for i in range(30)]
    rows += toxic + [(200, plain[0]), (201, "so " + item + " it goes"), (202, "the password = hunter2hunter2 is here now"), (203, None), (204, "")]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(i, 1, 1) for i, _ in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            assert ids == {i for i, _ in rows if not 100 <= i < 130}
        elif name == "near_dedup":
            assert 0 in ids and 200 not in ids and len(ids & {203, 204}) == 1 and {201, 202} <= ids
        elif name == "decontamination":
            assert 201 not in ids and 202 in ids
        elif name == "secret_scan":
            text = {r.doc_id: r.text for r in docs.collect()}
            assert text[202] == "the [REDACTED] is here now" and text[1] == plain[1]
    library = tokenizers.Tokenizer.from_file(word_bpe_path())
    for r in docs.collect():
        want = library.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.token_ids == want and r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def small_corpus(spark, folder):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    plain = [f"plain words number {i} of the quiet river text {i * 7} and {i * 13} stones {i * 29} lie there {i}" for i in range(30)]
    toxic = [(100 + i, plain[i] + " you horrible moron you") for i in range(20)]
    rows = [*enumerate(plain), *toxic]
    spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return item, plain


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that stages use themselves.
CLASH = ("fp", "label", "score", "predicted", "blob", "spans", "hit_blob", "dirty_id", "component_id", "term", "w", "pos", "text_hash", "ids")


def test_every_stage_takes_odd_rows(spark, tmp_path):
    item, plain = small_corpus(spark, tmp_path)
    long = " ".join(f"w{i % 977} of {i}" for i in range(120_000))
    odd = [(1, plain[1]), (1, plain[1]), (1, plain[2]), (None, "nothing but a row without an id"), (None, "password = hunter2hunter2"), (7, None), (8, ""), (9, long), (10, long + " token=abcdefgh"), (11, f"so {item} it goes"), (12, f"{long} {item}"), (13, "you horrible moron you"), (14, f"{long} you horrible moron you"), (15, "\x00 é😀 \x0b")]
    docs = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in odd], DOCS).withColumns({c: F.lit("mine") for c in CLASH})
    gone = {"toxicity": {13, 14}, "decontamination": {11, 12}}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        if name == "bpe":
            assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in odd) and all(r.n_tokens == len(r.token_ids) for r in rows)
            assert {r.n_tokens for r in rows if r.doc_id in (7, 8)} == {0}
            continue
        assert out.columns == docs.columns and all(r[c] == "mine" for r in rows for c in CLASH)
        kept = {(r.doc_id, r.text) for r in rows}
        if name in gone:
            assert kept == {(i, t) for i, t in odd if i not in gone[name]}
        elif name == "near_dedup":
            assert {(None, odd[3][1]), (15, odd[13][1])} <= kept and len([r for r in rows if r.text == plain[1]]) == 1 and len([i for i, _ in kept if i in (7, 8)]) == 1
        else:
            found = {(str(r.doc_id), r.text, r.n_chars) for r in rows}
            assert ("None", "[REDACTED]", 10) in found and ("10", long + " [REDACTED]", len(long) + 11) in found and len(rows) == len(odd)
            assert {(r.doc_id, r.text) for r in rows if r.doc_id not in (None, 10)} == {(i, t) for i, t in odd if i not in (None, 10)}


def test_every_stage_takes_an_empty_table(spark, tmp_path):
    small_corpus(spark, tmp_path)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame([], DOCS), str(tmp_path))
        assert out.count() == 0 and (name == "bpe" or out.columns == [f.split()[0] for f in DOCS.split(", ")])
