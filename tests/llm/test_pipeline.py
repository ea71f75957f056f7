"""The pipeline on documents with planted cases, each stage against what it must drop."""

from __future__ import annotations

import random

import corpus_pipeline
from evidentia.llm import registry


def test_pipeline_drops_what_is_planted(spark, tmp_path):
    rng = random.Random(11)
    pool = [f"term{k}" for k in range(500)]

    def prose(n=50):
        return " ".join(rng.choice(pool) for _ in range(n))

    rows, labels, kinds = [], [], {}
    for k in range(240):
        kind = ("clean", "toxic", "junk", "clean")[k % 4]
        text = prose()
        if kind == "toxic":
            text += " vilewordus snotterus " + prose(10)
        if kind == "junk":
            text = " ".join(w.upper() + "$$$" for w in text.split())
        rows.append((k, text, "en", "s", len(text)))
        labels.append((k, int(kind != "junk"), int(kind == "toxic")))
        kinds[k] = kind
    item = prose(25)
    rows += [(300, rows[0][1], "en", "s", 0), (301, rows[0][1].replace("term", "TERM"), "en", "s", 0), (302, prose(30) + " " + item + " " + prose(30), "en", "s", 0), (303, None, "en", "s", 0), (304, None, None, None, None)]
    for name, made, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, item)], "item_id long, text string")):
        spark.createDataFrame(made, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        names = docs.columns
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert docs.columns == names
            kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    good = {k for k, kind in kinds.items() if kind == "clean"}
    assert good <= kept[0] and not {k for k, kind in kinds.items() if kind == "toxic"} & kept[0]
    assert good <= kept[1] and not {k for k, kind in kinds.items() if kind == "junk"} & kept[1]
    assert good <= kept[2] and not {300, 301, 304} & kept[2]
    assert 302 not in kept[3] and good <= kept[3]
    pieces = docs.collect()
    assert {p.doc_id for p in pieces} == kept[3] and all(p.offset + p.length <= 1024 for p in pieces)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)


def test_registries():
    assert len(registry.queries()) == 13 and set(registry.oracle_sql()) == {"op2_decontamination", "op7_warc", "op11_conversation_repair", "op13_centroids"}
    assert list(corpus_pipeline.queries()) == ["pipeline"]
