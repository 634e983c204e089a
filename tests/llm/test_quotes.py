import random

import duckdb
import numpy as np
import pandas as pd

from quern.llm import quotes
from quern.llm.quotes import conversations, reply_order

SCHEMA = "conv_id long, turn long, role string, text string, seq int, key string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA)
    return {r.conv_id: (r.n_messages, r.n_quotes, r.chat) for r in conversations(df).collect()}


def by_sql(rows):
    con = duckdb.connect()
    con.register("c", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("CREATE TABLE conversations AS SELECT conv_id::BIGINT conv_id, turn::BIGINT turn, role::VARCHAR role, text::VARCHAR text FROM c")
    return {r[0]: r[1:] for r in con.execute(quotes.SQL).fetchall()}


def test_quotes_link_nest_and_order_replies(spark):
    rows = [
        (1, 0, "user", "How do I boil an egg?\n\nAnd how do I peel it?"),
        (1, 1, "assistant", "> How do I boil an egg?\nSeven minutes in hot water."),
        (1, 2, "assistant", "On Monday someone wrote:\n> And how do I PEEL it\nUnder cold water, gently."),
        (1, 3, "user", ">> how do i boil an egg\n> Seven minutes in hot water!\nIs that soft or hard?"),
        (1, 4, "user", "> nobody ever said this line\nA last remark."),
    ]
    got = run(spark, rows)
    assert got[1] == (
        5,
        4,
        "<|user|>\nHow do I boil an egg?\n\nAnd how do I peel it?\n<|assistant|>\nSeven minutes in hot water.\n<|user|>\nIs that soft or hard?\n<|user|>\nA last remark.\n<|assistant|>\nUnder cold water, gently.",
    )
    assert by_sql(rows) == got


def test_random_threads_match_sql(spark):
    rng = random.Random(6)
    words = "red green blue tea cup sun moon sea hill wind".split()
    rows = []
    for c in range(60):
        said = []
        for t in range(rng.randrange(1, 9)):
            lines = []
            for _ in range(rng.randrange(0, 3)):
                if said:
                    q = rng.choice(said)
                    lines += [rng.choice([">", "> ", " > ", ">> ", "> > "]) + x for x in q.split("\n")]
                    if rng.random() < 0.4:
                        lines.append("")
            own = "\n".join(" ".join(rng.choices(words, k=rng.randrange(1, 7))) for _ in range(rng.randrange(0, 3)))
            said.append(own)
            text = "\n".join([*lines, own])
            rows.append((c, t, rng.choice(["user", "assistant", None]), text if rng.random() < 0.95 else None))
    rows += rng.sample(rows, 20)
    got = run(spark, rows)
    assert got == by_sql(rows) and sum(v[1] for v in got.values()) > 30


def test_short_quotes_link_too(spark):
    rows = [(1, 0, "a", "Shall we meet at noon?"), (1, 1, "b", "Yes, agreed."), (1, 2, "c", "何時がよいですか"), (1, 3, "d", "> yes agreed\nFine."), (1, 4, "e", "> 何時がよいですか\n正午に"), (1, 5, "f", "> No\nWhy not?")]
    got = run(spark, rows)
    assert got == by_sql(rows) and got[1][:2] == (6, 2)
    assert [x.split("\n")[0] for x in got[1][2].split("<|")[1:]] == ["a|>", "b|>", "c|>", "e|>", "f|>", "d|>"]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [(r.n_messages, r.n_quotes) for r in conversations(df, least_words=3).collect()] == [(6, 0)]


def test_reply_order_is_depth_first():
    conv, seq, parent = np.array([1] * 5 + [2] * 2), np.array([1, 2, 3, 4, 5, 1, 2]), np.array([0, 1, 1, 2, 3, 0, 1])
    assert list(reply_order(conv, seq, parent)) == [0, 1, 3, 2, 4, 0, 1]


def test_defined_cases(spark):
    long = "many words here " * 20000
    rows = [(None, 1, "user", "x"), (1, None, "user", "x"), (2, 0, None, "hello"), (2, 0, None, "hello"), (2, 1, "user", None), (2, 2, "user", ""), (2, 3, "user", "> hello\n> there"), (3, 0, "user", long), (3, 1, "assistant", "> " + long + "\nshort"), (4, 5, "b", "second"), (4, 5, "a", "first")]
    got = run(spark, rows)
    assert got == {2: (4, 1, "<|unknown|>\nhello"), 3: (2, 1, f"<|user|>\n{long.strip()}\n<|assistant|>\nshort"), 4: (2, 0, "<|a|>\nfirst\n<|b|>\nsecond")}
    assert run(spark, []) == {}
