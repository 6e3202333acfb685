"""Every stage of the pipeline against a plain version on the smallest tables."""

import corpus_pipeline as P
from tests.llm.test_operators import check_packing, targets_by_hand, union
from tests.llm.test_production import dedup
from tests.llm.test_setsketch import set_by_hand
from wavecairn.llm import linededup, simhash

SF = "/root/testdata/sf0.001"


def table(df):
    return [r.asDict() for r in df.collect()]


def test_stages(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    names = docs.columns
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        before, docs = table(docs), spark.read.parquet(f"{tmp_path}/{k}")
        kept.append((before, table(docs)))
        if k < 4:
            assert docs.columns == names
    (raw, known), (_, lines), (_, single), (_, mixed), (_, packed) = kept
    # A clean document stays; what goes has no letters or is in no learned language.
    assert len(known) >= 0.97 * len(raw) and {r["doc_id"] for r in known} <= {r["doc_id"] for r in raw}
    assert {r["doc_id"]: r["text"] for r in lines} == dedup([(r["doc_id"], r["text"]) for r in known], linededup.PRODUCTION)
    prints = {r["doc_id"]: simhash.fingerprint((r["text"] or "").encode(), 5) for r in lines}
    sets = {r["doc_id"]: set_by_hand(r["text"]) for r in lines}
    cell = union([(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 12], prints)
    near = lambda a, b: not sets[a] | sets[b] or 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    group = union([(a, b) for a in sets for b in sets if a < b and cell[a] == cell[b] and near(a, b)], sets)
    assert {r["doc_id"] for r in single} == set(group.values()) and len(single) == len(set(group.values()))
    size = lambda r: len((r["text"] or "").split())
    sizes, taken = {}, {}
    for r in single:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r)
    for r in mixed:
        taken[r["source"]] = taken.get(r["source"], 0) + size(r)
    for s, want in targets_by_hand(sizes).items():
        assert abs(taken.get(s, 0) - want) <= max(size(r) for r in single if r["source"] == s)
    assert sorted(r["doc_id"] for r in packed if r["piece"] == 0) == sorted(r["doc_id"] for r in mixed)
    check_packing(packed)


def test_run_returns_the_last_stage(spark):
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(P.run(spark, SF).columns)


def test_stages_at_the_edges(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows and an empty table, stage by stage."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (None, "a b c d e f", "fr", "b", 11), (4, " \n\t", None, "a", 3), (5, "one two\nthree", "en", None, 13),
        (5, "one two\nthree", "en", None, 13), (5, "another text of this id", "en", "a", 23), (6, "word " * 20_000, "en", "a", 100_000), (7, "日本 é", "de", "ñ", 4),
    ]
    kind = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame(rows, kind)
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        assert k == 4 or out.columns == docs.columns
        found = table(out)
        if k == 1:
            assert len(found) == len(rows) and sum(r["text"] is None for r in found) == 1
        if k == 2:
            assert sorted(str(r["doc_id"]) for r in found) == ["1", "5", "5", "6", "7", "None"]
        if k == 4:
            assert len([r for r in found if r["piece"] == 0]) == len(rows)
            check_packing(found)
        assert table(stage(spark, docs.limit(0), SF)) == []
