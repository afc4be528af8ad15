import duckdb
import pytest

from grove.llm import quality


def test_sql_gives_the_same_rows(spark, odd_docs, sf_docs):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lines_removed", "chars_removed"]
    for docs in (sf_docs, odd_docs):
        connection = duckdb.connect()
        connection.register("documents", docs.toPandas())
        want = connection.sql(f"SELECT {', '.join(columns)} FROM ({quality.SQL})").fetchall()
        got = quality.judged(docs, carry=["doc_id"]).select(columns).collect()
        key = lambda r: tuple((x is not None, x) for x in r)
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_repeated_words_against_brute_force():
    import random

    rng = random.Random(4)
    for _ in range(300):
        words = [rng.choice(b"ab").to_bytes() for _ in range(rng.randint(0, 60))]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
        assert quality.repeated_words(words) == len(inside)


@pytest.mark.parametrize(
    "line, fails",
    [
        ("A line of ordinary prose, which ends.", False),
        ("Home | About | Contact | Terms", True),
        ("Read our Privacy Policy before you go on with it.", True),
        ("Wow!! So!! Loud!! Here!!", True),
        ("word*** other### more&&& and%%% so$$$", True),
        ("12 34 56 -- 78", True),
        ("About us", True),
        ("Yes.", False),
        ("the the the the the the", True),
        ("Äpfel und Birnen sind Obst, sagt man.", False),
    ],
)
def test_line_rules(line, fails):
    raw = line.encode()
    assert quality.line_fails(raw, raw.split()) is fails


def test_clean_removes_lines_and_rejects(spark):
    mixed = "Home | About | Help\n" + "".join(f"In line {k} there is a sentence about thing {k} of its kind.\n" for k in "abcd")
    junk = "".join(f"Home{k} | About | Help{k} | Terms | More\n" for k in range(12))
    docs = spark.createDataFrame([(1, mixed, len(mixed), 5), (2, junk, len(junk), 6), (3, "few words", 9, 7)], "doc_id long, text string, n_chars long, kept int")
    rows = quality.clean(docs).collect()
    assert [r.doc_id for r in rows] == [1] and "Home" not in rows[0].text and rows[0].n_chars == len(rows[0].text)
    assert quality.clean(docs).columns == docs.columns


def test_clean_keeps_every_column_and_long_lines(spark):
    prose = " ".join(f"word{k} of the only line" for k in range(30)) + " where you can read more of it."
    docs = spark.createDataFrame([(1, prose, len(prose), "own", 7, {"a": 1}, "c")], "doc_id long, text string, n_chars long, kept string, n_words int, m map<string,int>, cleaned_text string")
    got = quality.clean(docs)
    assert got.schema.simpleString() == docs.schema.simpleString() and tuple(got.first()) == tuple(docs.first())
    assert quality.clean(docs, phrase_words=None).count() == 0 and not quality.judge(prose)[6]


def test_odd_rows(odd_docs, no_docs):
    rows = quality.judged(odd_docs).collect()
    assert len(rows) == 9 and not any(r.kept for r in rows if r.text is None or r.text.strip() == "")
    assert quality.judged(no_docs).count() == 0
