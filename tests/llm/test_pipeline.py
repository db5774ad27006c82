import re
import zlib

import numpy as np
import public_tokenizers
from test_decontaminate import brute as brute_hits
from test_lines import brute as brute_lines
from tokenizers import Tokenizer

import corpus_pipeline
from attestor.llm import langid
from attestor.llm.shared import written

SMALL = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_whole_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, sizes, first = docs.columns, [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    assert docs.select("doc_id").distinct().count() == sizes[-1]
    assert docs.join(first.select("doc_id"), "doc_id", "left_anti").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert out.select("doc_id").distinct().count() == sizes[-1]


def test_hundreds_of_copies_leave_one(spark, tmp_path):
    text = "\n".join(" ".join(f"w{a}{b}" for b in range(12)) for a in range(6))
    rows = [(k, text, "en", "s", 1) for k in range(100)] + [(500, "the quick brown fox jumps over", "en", "s", 2), (501, None, None, None, None), (502, "12 34", "en", "s", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "other words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted({r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}) == [0, 500]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def brute_stay(rows):
    """Smallest ids of groups that similarity 0.8 of five-word shingles reaches, by all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return set(low.values())


def test_every_stage_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf, stages = "/root/testdata/sf0.001", dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())

    out = written(stages["language_id"](spark, docs, sf), "a")
    scored = langid.predict(docs, langid.fit(docs)).collect()
    assert {i for i, _ in rows(out)} == {r.doc_id for r in scored if r.lang_pred != "und" and r.score >= 0.4}

    docs, out = out, written(stages["line_dedup"](spark, out, sf), "b")
    want = [(int(i), text) for i, lines, gone, text in brute_lines(rows(docs)) if not gone or gone < lines]
    assert rows(out) == sorted(want)

    docs, out = out, written(stages["near_dedup"](spark, out, sf), "c")
    assert {i for i, _ in rows(out)} == brute_stay(rows(docs))

    docs, out = out, written(stages["decontamination"](spark, out, sf), "d")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {str(i) for i, _ in rows(out)} == {h[0] for h in brute_hits(rows(docs), items) if not h[-1]}

    packed = stages["packing"](spark, out, sf).toPandas()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in rows(out):
        ids, mine = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), packed[packed.doc_id == i].sort_values("start")
        assert mine.length.sum() == len(ids) and all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(mine.start, mine.length, mine.ids_crc32))
    assert (packed.groupby("sequence_id").length.sum() <= 2048).all()


def test_driver_lets_go_of_cycles(spark):
    import gc
    import weakref

    from attestor.llm.shared import let_go

    class Holder:
        pass

    gc.disable()
    try:
        one = Holder()
        one.own, one.df, seen = one, spark.range(3), weakref.ref(one)
        del one
        let_go(spark)
        assert seen() is None
    finally:
        gc.enable()
