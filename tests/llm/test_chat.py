import hashlib
import random

from pyspark.sql import functions as F

from attestor.llm import chat


def brute(rows):
    """Digests of the rows themselves, the formatted length by writing the template out."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    out = []
    for conv, turns in by.items():
        turns = [(r.decode(), t.decode()) for _, _, r, t in sorted(turns)]
        esc = lambda s: s.replace("\\", "\\\\").replace("<|", "<\\|")
        whole, last = "", None
        for role, text in turns:
            r = esc(role).replace("\n", "\\n")
            whole += "<|im_sep|>" if role == last else ("<|im_end|>\n" if last is not None else "") + f"<|im_start|>{r}\n"
            whole, last = whole + esc(text), role
        whole += "<|im_end|>\n"
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        learned = "".join(t for r, t in turns if r == "assistant")
        out.append((str(conv), len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), len(whole)))
    return sorted(out)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "conv_id long, turn long, role string, text string, segments string, c string, t int")
    made = chat.format_conversations(df)
    got = chat.digests(made).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows)
    return made


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "<|", "|>", "<", "|", "\\", "\\\\", "\n", "assistant\n", "\\n", "é漢\U0001f600", "", " ok", "\r\n", "$1"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
    rows = [(conv, turn, rng.choice(["user", "assistant", "assistant", "system", "tool\nx", "a\\n", "<|im_end|>", "\\"]), text()) for conv in range(60) for turn in range(rng.randrange(1, 9))]
    check(spark, rows)


def test_turns_of_one_role_are_merged(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", ""), (1, 4, "assistant", "d")]
    row = check(spark, rows).select(chat.formatted(F.col("segments")).alias("t"), chat.loss_text(F.col("segments")).alias("l")).first()
    assert row.t == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_sep|><|im_sep|>d<|im_end|>\n" and row.l == "cd"


def test_odd_rows(spark):
    rows = [(1, None, "user", "late"), (1, 0, None, None), (None, 3, "assistant", "n"), (None, 3, "assistant", "n"), (2, 5, "user", "tie b"), (2, 5, "user", "tie a"), (2, 5, "assistant", None), (3, 1, "user", None), (4, 1, "assistant", "long " * 200_000)]
    check(spark, rows)
    assert check(spark, []).count() == 0


def test_one_conversation_may_hold_most_rows(spark):
    check(spark, [(7, k, ("user", "assistant")[k % 2 if k % 7 else 0], f"turn {k} <|") for k in range(6_000)] + [(8, 0, "user", "x")])


def test_only_jvm_expressions(spark):
    plan = chat.digests(check(spark, [(1, 0, "user", "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
