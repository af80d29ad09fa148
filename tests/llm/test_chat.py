"""Chat formatting: round trips, loss masks and templates that rewrite."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from repurchase.llm import chat

from .test_trie import SCHEMA, tie

PIECES = ["</s>", "[INST]", "[/INST]", "[ROLE]", "[END]", "<s>", "\\", "[", "<", "/s>", "INST]", " ", "a", "é", "\n", "]"]
texts = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)


def conversations(ids=range(12), seed=4):
    r = random.Random(seed)
    rows = []
    for c in ids:
        for t in range(r.choice([1, 2, 5, 40, 70])):
            rows.append((c, t, r.choice(["user", "assistant", "system", "", None, "a]b [/ROLE]"]), r.choice(["", None, *("".join(r.choices(PIECES, k=6)) for _ in range(3))])))
    return rows


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, tie(role or "", text or ""), role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        said = [t[3:] for t in sorted(turns)]
        loss = "".join(t for r, t in said if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss))
    return out


def reported(df, **how):
    rows = chat.report(df, **how).collect()
    out = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out, {r["conv_id"]: r["rewrites"] for r in rows}, {r["conv_id"]: r["formatted_chars"] for r in rows}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), texts), texts), max_size=6))
def test_template_round_trip(turns):
    t = chat.instruction_template()
    out = t.render(turns, True)
    assert t.parse(out) == turns
    made = chat.render_block(t, [], turns, True)
    assert (made.text, made.rewrites) == (out if turns else "", 0)
    for (_, text), (start, end, a, b) in zip(turns, made.spans, strict=True):
        assert t.unescape(out[a:b]) == text and start <= a <= b <= end


@given(texts)
def test_no_control_string_is_left_in_a_text(text):
    escape, unescape = chat.escaping(chat.CONTROLS)
    assert unescape(escape(text)) == text and not any(c in escape(text) for c in chat.CONTROLS)


@pytest.mark.parametrize("block", [2, 3, 32])
def test_report_is_read_back_in_blocks(spark, block):
    rows = conversations()
    rows += [(None, 0, "assistant", "no id"), (None, None, "user", "first"), (0, None, "user", "null turn"), (3, 1, "user", "same"), (3, 1, "user", "same")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *(f"'x' as `{c}`" for c in ("pos", "block", "lead", "conv", "no_id", "spans")))
    got, rewrites, chars = reported(df, block=block)
    assert got == plain(rows) and set(rewrites.values()) == {0}
    assert chars == reported(df, block=70 * 3)[2]


def test_trap_and_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.report(empty).collect() == []
    got, _, _ = reported(chat.with_trap(empty))
    assert got == plain([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")])


def test_blocks_join_to_the_whole_render(spark):
    rows = conversations(range(4), 9)
    blocks = chat.format_conversations(spark.createDataFrame(rows, SCHEMA), block=5).collect()
    t = chat.instruction_template()
    for c in range(4):
        own = sorted((x for x in rows if x[0] == c), key=lambda x: x[1])
        text = "".join(b["formatted"] for b in sorted(blocks, key=lambda b: b["block"]) if b["conv_id"] == c)
        assert text == t.render([(r or "", x or "") for _, _, r, x in own], True)


def drop_thoughts(memory):
    """A template that takes ``(...)`` out of all but the last answer."""

    def render(turns, opening=True):
        out = "^" * opening
        for i, (role, text) in enumerate(turns):
            out += f"{role}:{text if i == len(turns) - 1 else text.replace('(think)', '')};"
        return out

    def parse(out):
        return [tuple(x.split(":", 1)) for x in out.lstrip("^").split(";")[:-1]]

    return chat.Template(render, parse, lambda s: s, memory)


@pytest.mark.parametrize("memory", [None, 1])
def test_rewritten_history_is_seen(spark, memory):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "(think) one"), (1, 2, "user", "r"), (1, 3, "assistant", "two"), (2, 0, "assistant", "plain")]
    got, rewrites, _ = reported(spark.createDataFrame(rows, SCHEMA), template=drop_thoughts(memory))
    assert rewrites == {1: 1, 2: 0}
    assert got[2][2] == 5 and got[1][2] == 3  # the rewritten answer has no loss


def test_a_template_that_looks_further_back_than_it_says(spark):
    def render(turns, opening=True):
        return "".join(f"{sum(r == 'user' for r, _ in turns[:i])}{r}:{x};" for i, (r, x) in enumerate(turns))

    t = chat.Template(render, lambda out: [], lambda s: s, memory=1)
    rows = [(1, i, "user", "x") for i in range(9)]
    _, rewrites, _ = reported(spark.createDataFrame(rows, SCHEMA), template=t, block=4)
    assert rewrites[1] > 0
    with pytest.raises(ValueError):
        chat.format_conversations(spark.createDataFrame(rows, SCHEMA), t, block=1)
