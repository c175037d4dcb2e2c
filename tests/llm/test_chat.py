import itertools

import numpy as np
import pytest

from leadmill.llm import chat
from leadmill.llm.queries import QUERIES

BIG = "/root/testdata/sf0.01"


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    model = chat.Model(
        rng.normal(size=chat.STATES), rng.normal(size=(chat.STATES,) * 2),
        rng.normal(size=(chat.STATES, chat.SYMBOLS)),
    )
    symbols = rng.integers(0, chat.SYMBOLS, 5)

    def score(path):
        s = model.start[path[0]] + sum(model.next[a, b] for a, b in zip(path, path[1:]))
        return s + sum(model.seen[k, x] for k, x in zip(path, symbols))

    best = max(itertools.product(range(chat.STATES), repeat=5), key=score)
    assert tuple(model.decode(symbols, None, None)) == best
    # A matrix holds the best chance of each pair of ends.
    assert model.matrix(symbols)[chat.STATES].max() == pytest.approx(score(best))


@pytest.mark.parametrize("line,role", [
    ("User: hi", "user"), ("### Assistant:", "assistant"), ("<|im_start|>system", "system"),
    ("**Human:** hi", "user"), ("[AI] hi", "assistant"), ("a: b", "assistant"), ("A house", None),
    ("the user: x", None), ("", None),
])
def test_markers(line, role):
    marker = chat.observe(line, True) // 12
    assert (chat.ROLES[marker - 1] if marker else None) == role


def key(rows):
    return sorted((r.conv_id, r.turn_no, r.role, r.text) for r in rows)


def test_roles_come_back(spark):
    conversations = spark.read.parquet(f"{BIG}/conversations.parquet")
    truth = {(r.conv_id, r.turn): (r.role, r.text) for r in conversations.collect()}
    rows = chat.parse(chat.transcribe(conversations)).collect()
    right = sum(truth.get((r.conv_id, r.turn_no)) == (r.role, r.text) for r in rows)
    assert right >= 0.95 * len(truth)
    one = next(r for r in rows if r.turn_no == 0)
    assert one.rendered == f"<|{one.role}|>\n{one.text}\n<|end|>\n"
    assert len(QUERIES["op1_chat_format"](spark, BIG).collect()) == len(rows)


def test_chunks_change_nothing(spark, sf_dir, monkeypatch):
    transcripts = chat.transcribe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    model = chat.train(chat.chunks(transcripts))
    whole = chat.parse(transcripts, model).collect()
    monkeypatch.setattr(chat, "CHUNK_LINES", 3)
    cut = {}
    for r in sorted(chat.parse(transcripts, model).collect(), key=lambda r: (r.conv_id, r.turn_no, r.chunk)):
        cut.setdefault((r.conv_id, r.turn_no, r.role), []).append(r)
    assert max(len(c) for c in cut.values()) > 1
    assert sorted((k, sum(r.n_lines for r in c)) for k, c in cut.items()) == sorted(
        ((r.conv_id, r.turn_no, r.role), r.n_lines) for r in whole
    )


def test_edges(spark):
    rows = [(1, 0, "User: hi", "user", 7), (1, 1, None, None, 7), (1, 1, None, None, 7),
            (None, 0, "Assistant: x", None, 7), (None, None, "y", "odd", 7), (2, 5, "", "user", 7),
            (3, 0, "line\n" * 20000, "user", 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string, chunk int")
    found = chat.parse(df).collect()
    assert {r.conv_id for r in found} == {1, None, 2, 3}
    lines = {c: sum(r.n_lines for r in found if r.conv_id == c) for c in (1, None, 2, 3)}
    assert lines == {1: 2, None: 2, 2: 1, 3: 20001}
    assert chat.parse(df.limit(0)).count() == 0
    assert chat.parse(df.drop("role")).count() >= 4


def test_turns_may_share_a_row(spark):
    model = chat.train(chat.chunks(chat.transcribe(spark.read.parquet(f"{BIG}/conversations.parquet"))))
    turns = [("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", "ok")]
    styles = ["{}: {}", "<|im_start|>{}\n{}<|im_end|>", "### {}:\n{}"]
    texts = [(k, 0, "\n".join(s.format(*t) for t in turns)) for k, s in enumerate(styles)]
    rows = chat.parse(spark.createDataFrame(texts, "conv_id long, turn long, text string"), model).collect()
    assert key(rows) == [(k, n, *t) for k in range(len(styles)) for n, t in enumerate(turns)]
