import zlib

import brute
import corpus_pipeline as C
import numpy as np
from tokenizers import Tokenizer

from matchloom.llm.tables import DOCUMENT_COLUMNS, documents

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs, seen = documents(spark, SF), {}
    for name, stage in C.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == DOCUMENT_COLUMNS
    text = lambda df: list(zip(df.doc_id.tolist(), df.text.tolist(), strict=True))

    raw = documents(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    clean = set(labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id)
    first = seen["quality_classifier"]
    assert set(first.doc_id) <= set(raw.doc_id) and len(set(first.doc_id) & clean) >= 0.99 * len(set(raw.doc_id) & clean)

    groups = brute.near_duplicates(text(first), 5, 80)
    assert sorted(seen["near_dedup"].doc_id) == sorted(i for i, g in groups.items() if g[2])

    kept = text(seen["near_dedup"])
    found = brute.repeats(kept, 50)
    want = {i: found[i][2] if found[i][1] else t for i, t in kept if found[i][2] or not found[i][1]}
    assert dict(text(seen["substring_dedup"])) == want
    assert all(len(t) == n for t, n in zip(seen["substring_dedup"].text, seen["substring_dedup"].n_chars, strict=True))

    mixed = seen["source_mixing"]
    assert set(mixed.doc_id) <= set(want) and dict(text(mixed)).items() <= want.items()

    whole = Tokenizer.from_file(C.TOKENIZER)
    ids = {i: np.array(whole.encode(t, add_special_tokens=False).ids + [2], "<u4") for i, t in set(text(mixed))}
    packed = seen["packing"]
    assert packed.length.sum() == sum(len(ids[i]) for i in mixed.doc_id)
    for r in packed.itertuples():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert packed.groupby("sequence_id").length.sum().max() <= 4096


def test_stages_with_nulls_repeats_and_empty_tables(spark, tmp_path):
    long_text = " ".join(f"word{i}" for i in range(120))
    texts = [long_text, long_text, None, "", "x", long_text + " and more", "a b c d e f", None]
    rows = [(None if i == 4 else i % 6, t, "en", None, None if t is None else len(t), "extra") for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string")
    spark.createDataFrame([(0, 1, 0), (1, None, 1), (99, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for start, most in ((table, 6), (table.limit(0), 0)):
        docs = start
        for name, stage in C.STAGES:
            stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{name}{most}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{most}"))
            ids = [r.doc_id for r in docs.select("doc_id").collect()]
            assert None not in ids and set(ids) <= set(range(6)) and (most or not ids), name
            if name == "near_dedup" and most:
                # of the rows under one id the least text counts, and a null is the least
                assert {r.doc_id: r.text for r in docs.collect()} == {0: "a b c d e f", 1: None, 2: None, 3: "", 5: long_text + " and more"}
            if name != "packing":
                assert docs.columns == DOCUMENT_COLUMNS


def test_run(spark):
    assert C.run(spark, SF).count() > 0 and C.ORACLE_SQL is None
