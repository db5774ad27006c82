from attestor.llm import linededup


def brute(rows, min_lines=3, min_words=50):
    """Every run of lines that is long enough and stands in an earlier place, by all pairs of places; equal rows once."""
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    texts = [(t or "").split("\n") for _, t in docs]
    real = [[k for k, x in enumerate(lines) if x.strip(" \t\r")] for lines in texts]
    seen, out = set(), {}
    for (i, t), lines, places in zip(docs, texts, real):
        gone = set()
        for a in range(len(places)):
            for b in range(a + 1, len(places) + 1):
                run = tuple(lines[k] for k in places[a:b])
                words = sum(x.strip(" ").count(" ") + 1 for x in run)
                if len(run) >= min_lines or words >= min_words:
                    if run in seen:
                        gone |= set(places[a:b])
                    elif b - a <= 12:  # longer ones are covered by their parts
                        seen.add(run)
        out[(i, t)] = (len(places), len(gone), t if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return sorted((str(i), *out[(i, t)]) for i, t in rows)


def check(documents, rows, **options):
    got = linededup.dedup_lines(documents(rows), **options).collect()
    assert sorted((str(r.doc_id), int(r.n_lines), r.n_removed, r.text) for r in got) == brute(rows, **options)
    assert all((r.line_all_, r.line_key_, r.file_key_) == ("u", 2, "f") for r in got)
    return got


def test_runs_are_cut(spark, documents):
    long = " ".join(["word"] * 60)
    rows = [
        (1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\nd\ny"), (3, "b\nc\nz"), (4, f"p\n{long}\nq"), (5, f"{long}"), (6, "r\n\nb\n \nc\nd\ns"), (7, "k\nk\nk\nk\nk\nk"), (8, f"t {long[:150]}\nu {long[:150]}"), (9, f"t {long[:150]}\nu {long[:150]}\nv"),
        (11, f"A {long}\nb b\nc"), (12, f"A {long}\nb b\nc"), (13, f"B {long}\nq"), (14, f"B {long}\nq\nz"), (15, f"C {long}\nd\ne e"), (16, f"m\nd\nC {long}\nd\ne e\nn".replace("d\nC", "n\nC", 1).replace("m\nn", "m")),
    ]
    got = {r.doc_id: r.text for r in check(documents, rows)}
    assert [got[k] for k in (12, 14, 16)] == ["", "z", "m\nn"]  # tails go with their runs
    assert got[2] == "x\ny" and got[3] == "b\nc\nz" and got[5] == "" and got[4] == rows[3][1] and got[6] == "r\n\n \ns" and got[9] == "v"


def test_chains_of_different_first_places(spark, documents):
    rows = [(0, "l1\nl2\nl3"), (1, "l3\nl4\nl5"), (2, "l1\nl2\nl3\nl4\nl5"), (3, "l1\nl2\nl3\nl4\nl5\nl6"), (4, "l2\nl3\nl4")]
    check(documents, rows)
    check(documents, rows, min_lines=2, min_words=4)


def test_odd_rows_and_order(spark, documents, odd_rows):
    check(documents, odd_rows + [(None, "n\no\np"), (50, "n\no\np"), (51, "m\nn\no\np\r\nq\t"), (51, "m\nn\no\np\r\nq\t")])
    assert linededup.dedup_lines(documents([])).count() == 0


def test_only_jvm_expressions(spark, documents):
    plan = linededup.dedup_lines(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
