import re

import corpus_pipeline as cp
from barloom.llm.common import read_table

from .conftest import ODD
from .test_filters import brute_lines, brute_scan
from .test_setsketch import brute


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = read_table(spark, sf_dir, "documents")
    columns = docs.columns
    stage = dict(cp.STAGES)
    kept = {}
    for name, f in cp.STAGES:
        kept[name + " in"] = docs
        out = f(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == columns
    assert list(stage) == ["quality_classifier", "line_dedup", "near_dedup", "benchmark_decontamination", "best_fit_packing"]

    rows = [(r.doc_id, r.text, r.source) for r in kept["line_dedup in"].collect()]
    want = {d: t for d, t, n in brute_lines(rows, 5) if n == 0 or (t and re.sub(" ", "", t))}
    assert {r.doc_id: r.text for r in kept["line_dedup"].collect()} == want
    rows = [(r.doc_id, r.text) for r in kept["near_dedup in"].collect()]
    assert {r.doc_id for r in kept["near_dedup"].collect()} == {d for d, _, c in brute(rows, 5) if d == c}
    rows = [(r.doc_id, r.text) for r in kept["benchmark_decontamination in"].collect()]
    items = [(r.item_id, r.text) for r in read_table(spark, sf_dir, "benchmark").collect()]
    assert {r.doc_id for r in kept["benchmark_decontamination"].collect()} == {d for d, w, h, _ in brute_scan(rows, items) if not (h and 20 * h >= w)}
    packed = kept["best_fit_packing"].collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept["benchmark_decontamination"].collect()}
    assert len({r.sequence_id for r in packed}) <= 1.02 * sum(r.length for r in packed) / 2048 + 1


def test_odd_rows_pass_every_stage(spark, docs, sf_dir):
    for rows in (ODD, []):
        table = docs(rows) if rows else docs(ODD).limit(0)
        for name, f in cp.STAGES:
            out = f(spark, table, sf_dir)
            assert out.count() <= max(len(rows) * 200, 0)
            if name != "best_fit_packing":
                assert out.columns == table.columns
