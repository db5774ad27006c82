import zlib

import numpy as np

from attestor.llm import langid, queries, toxicity

SMALL = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_documents(spark, small):
    out = queries.op5_toxicity_mil(spark, "/root/testdata/sf0.1").toPandas()
    labels = small("labels", "/root/testdata/sf0.1")
    assert len(out) == 10_000 and out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    m = out[out.held_out].merge(labels, on="doc_id")
    hit, clean = m[m.toxic == 1].predicted, m[m.toxic == 0].predicted
    assert hit.mean() > 0.8 and clean.mean() < 0.01


def test_toxic_sentence_is_found(spark, documents):
    clean = [f"The plain words number {k} stand here. Nothing bad is said {k}." for k in range(60)]
    toxic = [f"The plain words number {k} stand here. You are a vilething person. Nothing bad is said {k}." for k in range(30)]
    model = toxicity.train([t.encode() for t in clean + toxic], [0] * 60 + [1] * 30)
    rows = documents([(1, toxic[0]), (2, clean[0]), (3, None), (4, ""), (None, "Vilething! fine.")])
    got = {r.doc_id: r for r in toxicity.score(rows, model).collect()}
    assert got[1].score > 0.5 and got[1].worst_sentence == 1 and got[1].worst_text == "You are a vilething person"
    assert got[2].score < 0.5 and got[2].worst_text is None and got[3].score == got[4].score == 0 and got[3].worst_sentence is None and got[None].score > 0.5
    assert [(r.doc_id, r.sentence) for r in toxicity.offending_sentences(rows, model).where("doc_id = 1").collect()] == [(1, 1)]
    assert toxicity.score(documents([]), model).count() == 0


def test_noisy_or_is_the_product_form():
    model = toxicity.Model(-2.0, {b"bad": 3.0})
    p = 1 / (1 + np.exp(-np.array([1.0, -2.0])))
    assert abs(model.document(b"bad bad. good")[0] - (1 - np.prod(1 - p))) < 1e-12


def test_labels_may_be_null_repeated_or_at_odds(spark, documents, monkeypatch):
    drawn = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y, *more: drawn.append(sorted(zip(texts, y))))
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (3, 0), (3, 0), (4, 1), (5, 0)], "doc_id long, toxic int")
    docs = documents([(1, "b"), (1, "a"), (2, "c"), (3, "d"), (3, "d"), (4, None), (5, "x" * 3000), (None, "e")])
    toxicity.fit(docs, labels, most_chars=1000)
    assert drawn == [[(b"a", 1), (b"d", 0)]]


def test_score_is_noisy_or_over_sentences_by_brute_force(spark, documents):
    texts = ["You are bad. All is well! Bad bad?", "well", None, "", "Bad " * 3000]
    model = toxicity.Model(-1.5, {b"bad": 2.0, b"well": -1.0})
    for r in toxicity.score(documents(list(enumerate(texts))), model).collect():
        data = (texts[r.doc_id] or "").encode()
        each = [1 / (1 + np.exp(-(-1.5 + sum(model.weights[w] for w in model.weights.keys() & set(toxicity.features(s)))))) for s in toxicity.sentences(data)]
        assert abs(r.score - (1 - np.prod([1 - p for p in each]) if each else 0)) < 1e-9
        assert r.worst_sentence == (int(np.argmax(each)) if each else None)


def test_no_labels_give_a_constant_model(spark, documents):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(documents([(1, "a")]), empty)
    assert toxicity.score(documents([(1, "a")]), model).collect()[0].score < 0.5


def test_language_on_held_out_documents(spark, small):
    out = queries.op7_language_kernel(spark, SMALL).toPandas()
    m = out[out.held_out].merge(small("documents"), on="doc_id")
    assert len(out) == 1000 and (m.lang_pred == m.lang).mean() > 0.98 and out.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()


def test_language_of_odd_rows(spark, documents, odd_rows, tmp_path):
    model = langid.train(["the cat sat on the mat"] * 3 + ["der hund lief durch den wald"] * 3, ["en"] * 3 + ["de"] * 3)
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(documents(odd_rows + [(30, "der wald"), (31, "the mat")]), model).collect()]
    by = {i: p for i, p, _ in got}
    assert len(got) == len(odd_rows) + 2 and by[1] == by[2] == by[3] == by[8] == "und" and by[30] == "de" and by[31] == "en" and by[6] != "und"
    assert {p for i, p, _ in got} <= {"en", "de", "und"} and all(s == 0 for _, p, s in got if p == "und")
    none = langid.fit(documents([]))
    assert langid.predict(documents([(1, "abc")]), none).collect()[0].lang_pred == "und"
    kept = langid.recognised(documents([(1, "der hund lief"), (2, None), (3, "...")], tmp_path / "d"), model)
    assert [(r.doc_id, r.row_key_, r.file_row_) for r in kept.collect()] == [(1, 4, 3)]


def test_small_languages_are_drawn(spark, monkeypatch):
    """Seven large languages and two small ones, with more rows wanted than allowed."""
    sizes = {**{f"l{k}": 400 for k in range(7)}, "few": 3, "one": 1}
    rows = [(i, " ".join(f"{y}{w}" for w in "abcd"), y) for i, y in enumerate(y for y, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame([*rows, (9000, None, "few"), (9001, "x" * 2000, "few")], "doc_id long, text string, lang string")
    drawn = []
    monkeypatch.setattr(langid, "train", lambda texts, langs: drawn.append(langs))
    langid.fit(docs, most_per_language=20, most_rows=60, most_chars=1000)
    langid.fit(docs, most_per_language=20, most_rows=200, most_chars=1000)
    assert [{y: d.count(y) for y in sizes} for d in drawn] == [{**{f"l{k}": 8 for k in range(7)}, "few": 3, "one": 1}, {**{f"l{k}": 20 for k in range(7)}, "few": 3, "one": 1}]


def test_kernel_is_shared_distinct_grams():
    model = langid.train(["abab", "abc"], ["x", "y"], least_documents=1)
    a, b = (set(langid.gram_codes(langid.normal(t)).tolist()) for t in ("abab", "abc"))
    x = model.presence([langid.normal("abab"), langid.normal("abc")])
    assert x[0] @ x[1] == len(a & b) and x[0].sum() == len(a)


def test_scores_by_brute_force():
    """Kernel by sets, then Nyström features and ridge regression in plain formulas."""
    texts = ["the cat sat on the mat", "a dog ran to the park", "the sun is warm today", "der hund lief schnell", "die katze schlief lang", "das haus ist alt", "le chat dort bien", "la maison est belle"]
    langs = ["en"] * 3 + ["de"] * 3 + ["fr"] * 2
    model = langid.train(texts, langs, most_grams=10**6, landmarks=6, least_documents=1)
    sets = {t: set(langid.gram_codes(langid.normal(t)).tolist()) for t in [*texts, "the house is old", "der alte hund"]}
    known = set().union(*(sets[t] for t in texts))
    kernel = lambda x, y: len(sets[x] & sets[y] & known) / np.sqrt(len(sets[x] & known) * len(sets[y] & known))
    turns = [texts[k] for k in (3, 0, 6, 4, 1, 7)]  # languages in order, one of each in turn
    values, vectors = np.linalg.eigh(np.array([[kernel(x, y) for y in turns] for x in turns]))
    white = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    phi = np.array([[kernel(x, y) for y in turns] for x in texts]) @ white
    target = np.array([[float(y == c) for c in ("de", "en", "fr")] for y in langs])
    w = np.linalg.solve((phi - phi.mean(0)).T @ (phi - phi.mean(0)) + 1e-4 * len(phi) * np.eye(phi.shape[1]), (phi - phi.mean(0)).T @ (target - target.mean(0)))
    for t in sets:
        want = (np.array([kernel(t, y) for y in turns]) @ white - phi.mean(0)) @ w + target.mean(0)
        assert np.abs(model.scores([langid.normal(t)])[0] - want).max() < 2e-3
