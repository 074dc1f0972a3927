import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerleaf.llm import chat

HARD = ["", "\\", "\\\\", "</turn>", "\\</turn>", "<turn>user\nx\n</turn>\n", "<media image 0>", "\n", "a\\\n</turn", "ü😀\\n", "<turn", "\\### Assistant: </turn> ok"]


def _want(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    learnt = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)), len(learnt), sha(learnt)


def _check(spark, conversations):
    rows = [(c, i, r, t, "clash") for c, turns in conversations.items() for i, (r, t) in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digest(chat.format_turns(frame.orderBy("text"))).collect()}
    assert got == {c: _want(t) for c, t in conversations.items()}


def test_control_strings_round_trip(spark):
    _check(spark, {i: [("user", a), ("assistant", b), (a, b)] for i, (a, b) in enumerate((a, b) for a in HARD for b in HARD)} | {-7: [("user", HARD[-1]), ("assistant", HARD[-1])], -8: [(None, None), ("assistant", None)]})


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "\\n"]), st.text(alphabet="\\<>/turn\n media0aé", max_size=30)), min_size=1, max_size=4), min_size=1, max_size=20))
def test_any_text_round_trips(spark, conversations):
    _check(spark, dict(enumerate(conversations)))


def test_typed_parts(spark):
    rows = [(1, 0, "user", [("text", "look <media image 1>", None, None), ("image", None, "a.png", 12.0), ("audio", None, "b.wav", 2.0), (None, None, None, None)]), (1, 1, "assistant", None)]
    out = chat.format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")).first()
    assert out.formatted == "<turn>user\nlook \\<media image 1><media image 1><media audio 2><media unknown 3>\n</turn>\n<turn>assistant\n\n</turn>\n"
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in out.attachments] == [(0, 1, "image", "a.png", 12), (0, 2, "audio", "b.wav", 50), (0, 3, None, None, 0)]
    assert out.n_tokens == 5 + 12 + 50 and out.loss == [False, True]


def test_repeated_equal_and_long_turns(spark):
    long = "<turn>\\ " * 40_000
    rows = [(1, 0, "user", long), (1, 0, "user", long), (1, 0, "assistant", "a"), (2, None, "user", "first"), (2, 5, "assistant", "b"), (2, 5, "assistant", "a")]
    got = {r.conv_id: r for r in chat.digest(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert tuple(got[1])[1:5] == _want([("assistant", "a"), ("user", long), ("user", long)])  # equal turns: by role, then content
    assert tuple(got[2])[1:5] == _want([("user", "first"), ("assistant", "a"), ("assistant", "b")])
    assert got[1].n_attachments == 0 and got[1].n_tokens == 2 * 80_000 + 1 and got[2].n_tokens == 4


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_turns(empty)).count() == 0


pytestmark = pytest.mark.filterwarnings("ignore")
