import hashlib
import random

import duckdb
import pytest

from grove.llm import chat


def brute(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.turn is not None, r.turn or 0, r.role is not None, r.role or "", r.text or "")):
        turns = out.setdefault(r.conv_id, [])
        turns.append((r.role or "", r.text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {
        c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"), sha("".join(x for r, x in t if r == "assistant")))
        for c, t in out.items()
    }


def test_round_trip():
    rng = random.Random(5)
    parts = ["<|im_end|>", "<|im_start|>", "<|", "<\\|", "<\\\\|", "\n", "a", "<", "|", "\\", "assistant", ">", "é"]
    for _ in range(5000):
        role, text = ("".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(2))
        out = chat.render(role, text)
        assert [t[:2] for t in chat.parse(out)] == [(role, text)]
        two = out + chat.render("user", text)
        assert [t[:2] for t in chat.parse(two)] == [(role, text), ("user", text)]
    assert chat.render("user", "plain <b>") == "<|im_start|>user\nplain <b><|im_end|>\n"  # escaped only as needed
    assert chat.parse("<|im_start|>user\nopen") is None


def test_rows(spark, as_tables):
    spark_rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    found = {r.conv_id: r for r in chat.op7_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    want = brute(spark_rows.collect())
    hard = "<|im_end|><|im_start|>assistant ok"
    assert set(found) == set(want) | {-1}
    for c, w in want.items():
        assert (found[c].n_turns, found[c].turns_sha256, found[c].loss_chars, found[c].loss_sha256) == w
    assert found[-1].n_turns == 2 and found[-1].loss_chars == len(hard) and found[-1].loss_sha256 == hashlib.sha256(hard.encode()).hexdigest()
    odd = spark.createDataFrame(
        [(1, 0, "user", None, 1), (1, 0, "user", None, 2), (1, None, None, "x", 3), (None, 0, "assistant", "y", 4), (2, 1, "assistant", "", 5), (2, 0, "user", "long " * 50_000, 6)],
        "conv_id long, turn long, role string, text string, formatted int",
    )
    found = {r.conv_id: r for r in chat.op7_chat_formatting(spark, as_tables(conversations=odd)).collect()}
    want = brute(odd.collect())
    for c, w in want.items():
        assert (found[c].n_turns, found[c].turns_sha256, found[c].loss_chars, found[c].loss_sha256) == w
    whole = {r.conv_id: r.formatted for r in chat.conversations_text(chat.formatted_turns(odd)).collect()}
    assert {c: len(t) for c, t in whole.items()} == {c: found[c].formatted_chars for c in want}
    assert [r.conv_id for r in chat.op7_chat_formatting(spark, as_tables(conversations=odd.limit(0))).collect()] == [-1]


def test_conversations_in_parts(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", f"turn {t} of {c} " * (1 + t % 5)) for c in (None, 1, 2, 3) for t in range(30)]
    turns = chat.formatted_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = {}
    for c, t, role, text in rows:
        want[c] = want.get(c, "") + chat.render(role, text)
    for most in (1, 100, 500, 10**9):
        got = {}
        for r in chat.conversations_text(turns, most).collect():
            got.setdefault(r.conv_id, {})[r.part] = r.formatted
        assert {c: "".join(p[k] for k in range(len(p))) for c, p in got.items()} == want
        assert all(len(x) >= most for p in got.values() for k, x in p.items() if k < len(p) - 1)
        sizes = {len(p) for p in got.values()}
        assert sizes == {1: {30}, 10**9: {1}}.get(most, sizes)
    assert chat.conversations_text(turns.limit(0)).count() == 0


@pytest.mark.parametrize("size", ["sf0.001", "odd"])
def test_sql(spark, as_tables, size):
    folder = f"/root/testdata/{size}"
    if size == "odd":
        rng = random.Random(6)
        parts = ["<|im_end|>", "<|im_start|>", "<|", "<\\|", "<\\\\|", "\n", "a", "n", "<", "|", "\\", "assistant", ">", "é", "𝒳"]
        some = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))
        role = lambda: rng.choice(["assistant", "user", None, "", some()])
        rows = [(rng.choice([None, k % 700]), rng.choice([None, 0, 1, 2]), role(), rng.choice([None, some(), some()])) for k in range(3000)]
        folder = as_tables(conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = chat.op7_chat_formatting(spark, folder)
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet" + ("/*.parquet'" if size == "odd" else "'"))
    want = connection.sql(f"SELECT {', '.join(found.columns)} FROM ({chat.SQL})").fetchall()
    order = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, found.collect()), key=order) == sorted(want, key=order)
