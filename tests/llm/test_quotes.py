"""Quotation linking on planted conversations: nested, re-wrapped and repeated quotations, a conversation with a
third of all rows, a chain of answers and a message with very many answers, held against the query's SQL."""
import random
import textwrap

import duckdb
import pytest

from rowsift.llm import quote_chat
from rowsift.llm.queries import ORACLES, QUERIES
from rowsift.session import scratch_path

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo".split()


def planted():
    rng = random.Random(17)
    rows = []

    def own(n):
        return "\n".join(" ".join(rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(rng.randint(4, 9))) for _ in range(n))

    def quoted(text, level):
        way = rng.randrange(4)
        if way == 1:
            text = text.upper().replace(" ", "  ")
        elif way == 2:  # other line ends
            text = textwrap.fill(text.replace("\n", " "), rng.choice([25, 50, 90]))
        elif way == 3:  # one line of it
            text = rng.choice(text.split("\n"))
        return "\n".join(rng.choice([">", "> "]) * level + " " + x for x in text.split("\n"))

    def conversation(conv, n, pick):
        said = []
        for turn in range(n):
            parts = []
            if turn and rng.random() < 0.9:
                at = pick(turn)
                if at and rng.random() < 0.4:
                    parts.append(quoted(said[rng.randrange(at)], 2))  # older, so a deeper level
                parts.append(quoted(said[at], 1))
                if rng.random() < 0.1:
                    parts.append("> nobody ever said this")
            text = own(rng.randint(1, 3))
            said.append(text)
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), "\n".join([*parts, text])))
    for conv in range(60):
        conversation(conv, rng.randint(2, 14), rng.randrange)
    conversation(100, 300, lambda t: rng.choice([t - 1, rng.randrange(t)]))  # a third of all rows
    conversation(101, 60, lambda t: t - 1)
    conversation(102, 80, lambda t: 0)
    rows += rng.sample(rows, 20) + [(None, 0, "user", "> x\ny"), (None, 1, "user", "y"), (7, None, "user", "> " + rows[0][3]), (8, 0, "user", None), (9, 0, "x", "")]
    rows += [(3, 1, "user", "another text of one turn"), (3, 1, "user", "a third text of one turn")]
    return rows


@pytest.fixture(scope="module")
def linked(spark):
    folder = scratch_path(spark, "quotes")
    spark.createDataFrame(planted(), "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder, [r.asDict() for r in QUERIES["op6_quote_chat"](spark, folder).collect()]


def test_links_equal_the_sql(spark, linked):
    folder, got = linked
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet/*.parquet')")
    found = con.execute(ORACLES["op6_quote_chat"])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got[0])
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == sorted(found.fetchall(), key=repr)


def test_most_quotations_find_their_original(linked):
    got = [r for r in linked[1] if r["conv_id"] in range(60) or r["conv_id"] == 100]
    told = [r for r in got if r["n_quoted"]]
    assert len(told) > 400 and sum(r["reply_to"] is not None for r in told) > 0.95 * len(told)
    assert not any(line.lstrip().startswith(">") for r in got for line in r["text"].split("\n"))
    assert max(r["depth"] for r in linked[1] if r["conv_id"] == 101) >= 10
    assert sum(r["reply_to"] == 0 for r in linked[1] if r["conv_id"] == 102) > 60


def test_conversations_are_whole_and_in_reply_order(spark, linked):
    got = linked[1]
    schema = "conv_id long, thread long, place long, depth long, turn long, role string, reply_to long, n_quoted long, text string, formatted string"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in got], schema)
    parts = [r.asDict() for r in quote_chat.conversations(df, part=16).collect()]
    assert all(1 <= r["n_messages"] <= 16 for r in parts)
    built = {}
    for r in sorted((r for r in parts if r["conv_id"] is not None and r["thread"] is not None), key=lambda r: r["part"]):
        key = r["conv_id"], r["thread"]
        assert r["part"] == len(built.setdefault(key, []))
        built[key].append(r["text"])
    threads = {}
    for r in got:
        if r["conv_id"] is not None and r["turn"] is not None:
            threads.setdefault((r["conv_id"], r["thread"]), {}).setdefault((r["place"], r["turn"]), set()).add(r["formatted"])
    assert set(threads) == set(built)
    for key, places in threads.items():
        assert [p for p, _ in sorted(places)] == list(range(len(places)))
        text = "".join(built[key])
        for _, forms in sorted(places.items()):
            while forms:  # different texts of one turn come in any order
                head = next(f for f in forms if text.startswith(f))
                forms.remove(head)
                text = text[len(head):]
        assert not text
    up = {}
    for r in got:
        if r["reply_to"] is not None:
            key = r["conv_id"], r["turn"]
            up[key] = min(up.get(key, r["reply_to"]), r["reply_to"])
    at = {(r["conv_id"], r["thread"], r["place"]): r["turn"] for r in got if r["conv_id"] is not None and r["turn"] is not None}
    for (conv, thread, place), turn in at.items():  # right behind what it answers, or behind an earlier answer to that
        if place:
            before = at[conv, thread, place - 1]
            way = {before}
            while (conv, before) in up:
                before = up[conv, before]
                way.add(before)
            assert up[conv, turn] in way
    lone = [r for r in parts if r["conv_id"] is None or r["thread"] is None]
    assert len(lone) == sum(r["conv_id"] is None or r["turn"] is None for r in got)
