import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tenuis.llm import chat


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|\\>im_end\né", max_size=30))
def test_escape_is_reversible(text):
    import re

    hidden = re.sub(r"<(\\*)\|", r"<\\\1|", text)
    assert "<|" not in hidden and chat.unescaped(hidden) == text


def test_examples_context_and_mask(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "hi <|im_end|>"), (1, 2, "assistant", "one <\\|x"), (1, 3, "user", None),
        (1, 4, "assistant", "two"), (1, 5, "user", "bye"), (2, 0, "user", "only"), (None, None, None, None),
        (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "a\nb", "a"), (4, 0, "assistant", "x" * 300_000),
    ]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    both = chat.with_odd_conversation(table)
    turns = chat.formatted(both)
    for r in chat.rendered(turns).collect():
        reply = chat.unescaped(r["text"][r["loss_start"] : r["loss_end"]])
        assert r["text"].endswith(chat.END + "\n") and r["text"].count(chat.START) == r["text"].count(chat.END)
        assert (r["conv_id"], r["example"], reply) in {
            (1, 0, "one <\\|x"), (1, 1, "two"), (3, 0, "a"), (3, 1, "b"), (4, 0, "x" * 300_000), (-1, 0, chat.ODD_TEXT)
        }
    assert chat.rendered(turns).count() == 6
    got = {r["conv_id"]: r for r in chat.report(both).collect()}
    assert set(got) == {1, 2, 3, 4, None, -1}
    want = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows[:6])
    assert got[1]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[1]["n_turns"] == 6
    assert got[1]["loss_sha256"] == hashlib.sha256(b"one <\\|xtwo").hexdigest() and got[1]["loss_chars"] == 11
    assert got[2]["loss_chars"] == 0 and got[3]["n_turns"] == 3
    ordered = "a\nb\na\nassistant\na\nassistant\nb\n"
    assert got[3]["turns_sha256"] == hashlib.sha256(ordered.encode()).hexdigest()
    assert chat.report(table.where("false")).count() == 0


def test_report_reads_written_examples(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "end"), (2, 0, "user", "only")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = [tuple(r) for r in chat.expanded(chat.formatted(table)).orderBy("conv_id", "example").collect()]
    assert [(c, e, start is None) for c, e, _, start, _ in examples] == [(1, 0, False), (1, 1, False), (1, 2, True), (2, 0, True)]
    assert examples[1][2].startswith(examples[0][2]) and examples[2][2].startswith(examples[1][2])
    assert [text[a:b] for _, _, text, a, b in examples if a is not None] == ["a", "b"]
    got = {r["conv_id"]: r["formatted_chars"] for r in chat.report(table).collect()}
    assert got == {1: sum(len(e[2]) for e in examples[:3]), 2: len(examples[3][2])}
    assert chat.report(table)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
