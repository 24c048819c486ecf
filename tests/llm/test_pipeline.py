"""The pipeline's stages, each against what its operator says of its input."""

import numpy as np
import pytest

pytest.importorskip("cuemill.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F

from cuemill.llm import decontamination, packing, queries, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.read(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.keep(stage(spark, docs, SF), name)
        kept[name] = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept[name] <= {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "simhash_near_dedup":
            groups = simhash.near_duplicates(docs).select("component_id").distinct().count()
            assert out.count() == groups == simhash.near_duplicates(out).select("component_id").distinct().count()
        if name == "decontamination":
            clean = decontamination.find_contamination(docs, queries.read(spark, SF, "benchmark")).where(F.size("spans") == 0)
            assert kept[name] == {r.doc_id for r in clean.collect()}
        if name != "packing":
            assert out.columns == columns
            docs = out
    whole = packing.pack(docs, queries.tokenizer_path(queries.PACK_VOCABULARY))
    assert out.agg(F.sum("length")).first() == whole.agg(F.sum("length")).first()
    assert kept["packing"] == kept["decontamination"]


def small_docs(spark, rows):
    """Documents with columns named like some that the operators use or add."""
    full = [(k, t, "en", len(t or ""), 7, "mine") for k, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, n_chars long, n_removed int, lang_pred string")


def test_line_dedup_stage_against_all_pairs(spark):
    draw = np.random.default_rng(3)
    word = [f"w{k}" for k in range(40)]
    base = [[word[k] for k in draw.integers(0, 40, 12)] for _ in range(25)]

    def line():
        own = list(base[draw.integers(0, 25)])
        for _ in range(draw.integers(0, 3)):
            own[draw.integers(0, 12)] = word[draw.integers(0, 40)]
        return " ".join(own)

    rows = [(k, "\n".join([line() for _ in range(draw.integers(1, 4))] + [""] * (k % 2))) for k in range(60)] + [(100, None), (101, ""), (102, "W1  w2\tw3 w4 w5"), (103, "w1  w2\tw3 w4 w5"), (104, "alone " * 20_000)]
    earlier, want = [], {}
    for k, text in rows:
        lines = (text or "").split("\n")
        left = []
        for one in lines:
            own = {w.lower() for w in one.split()}
            if not own or not any(9 * len(own & x) >= 4 * (len(own) + len(x)) for x in earlier):
                left.append(one)
            if own:
                earlier.append(own)
        if len(left) == len(lines) or left:
            want[k] = text if text is None else "\n".join(left)
    out = corpus_pipeline.dedup_lines(spark, small_docs(spark, rows), SF)
    assert out.columns == ["doc_id", "text", "lang", "n_chars", "n_removed", "lang_pred"]
    found = out.collect()
    assert {r.doc_id: r.text for r in found} == want and 103 not in want and len(want) > 10
    assert all(r.n_removed == 7 and (r.text is None or r.n_chars == len(r.text)) for r in found)
    assert corpus_pipeline.dedup_lines(spark, small_docs(spark, []), SF).count() == 0


def test_language_stage_drops_what_has_no_language(spark):
    docs = queries.read(spark, SF, "documents").select("doc_id", "text", "lang").where("text is not null")
    odd = spark.createDataFrame([(900001, None, None), (900002, "", None), (900003, "12 34 -- 5", None), (900003, "12 34 -- 5", None)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.union(odd), SF).collect()}
    wordy = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text)}
    assert kept <= wordy and len(kept) >= 0.95 * len(wordy)


def test_simhash_stage_against_all_pairs(spark):
    draw = np.random.default_rng(5)
    texts = [" ".join(f"t{x}" for x in draw.integers(0, 500, 400)) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(50 + k, t if k % 2 else t + " tail") for k, t in enumerate(texts)] + [(90, None), (91, "")]
    docs = small_docs(spark, rows)
    marks = {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(docs, shingle=5).collect()}
    root = {k: k for k in marks}
    for _ in marks:
        for a in marks:
            for b in marks:
                if (marks[a] ^ marks[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    kept = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, SF).collect()}
    assert kept == set(root.values()) and {50 + k for k in range(1, 12, 2)}.isdisjoint(kept) and 91 not in kept and 90 in kept
