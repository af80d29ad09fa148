r"""Chat formatting by incremental black-box rendering.

A template is a function from turns to text. Nothing else of it is used to find
the turns: each successive prefix of a conversation is rendered, and what a
turn adds to the render before it is the turn's span. Inside the span, the
text's place is found by rendering the turn with two other one-letter texts:
their common beginning and end are the marks around it. A render that does not
begin with the one before it comes from a template that rewrites history: the
turn counts in ``rewrites``, and spans that reach beyond the text both renders
share are void (no loss is taken from them).

Renders grow with the square of the turns rendered together, so conversations
are cut into blocks of ``BLOCK`` turns. A template states how many earlier turns
a turn's rendering depends on (``memory``); a block is rendered after that many
turns of the block before. The first turn of a block is also rendered after one
turn more, and a difference counts in ``rewrites`` too: the template looks
further back than it says. A template without ``memory`` is rendered on whole
conversations, one task each.

Control strings inside texts and roles are escaped reversibly: backslashes are
doubled, and one is put behind the first character of each control string, so
none is left in the text. ``parse`` reads turns back from formatted text.

Turns are ordered by turn (null first), ties by a hash of role and text; a null
role or text is empty; rows with a null conv_id form one conversation. Repeated
rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from os.path import commonprefix

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash
from .positions import number_rows

BLOCK = 32
LEARNED = ("assistant",)
Turn = tuple[str, str]


def escaping(controls: Sequence[str]) -> tuple[Callable[[str], str], Callable[[str], str]]:
    """(escape, unescape) for the given control strings of two characters or
    more, which hold no backslash and none of their first characters later on."""
    back = re.compile(r"\\(\\?)")

    def escape(s: str) -> str:
        s = s.replace("\\", "\\\\")
        for c in controls:
            s = s.replace(c, f"{c[0]}\\{c[1:]}")
        return s

    return escape, lambda s: back.sub(r"\1", s) if "\\" in s else s


@dataclass(frozen=True)
class Template:
    """``render`` gives the text of some first turns; ``opening`` says whether
    they are the conversation's first. ``parse`` reads turns back from text that
    starts at a turn or at the conversation's beginning."""

    render: Callable[[Sequence[Turn], bool], str]
    parse: Callable[[str], list[Turn]]
    unescape: Callable[[str], str]
    memory: int | None = None


# Control strings of the instruction template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[END]")


def instruction_template() -> Template:
    """``<s>``, then ``[INST] text [/INST]`` for users, `` text</s>`` for
    assistants and ``[ROLE]role[/ROLE] text [END]`` for any other role."""
    escape, unescape = escaping(CONTROLS)

    def one(role: str, text: str) -> str:
        if role == "user":
            return f"[INST] {escape(text)} [/INST]"
        if role == "assistant":
            return f" {escape(text)}</s>"
        return f"[ROLE]{escape(role)}[/ROLE] {escape(text)} [END]"

    def render(turns: Sequence[Turn], opening: bool = True) -> str:
        return "<s>" * opening + "".join(one(*t) for t in turns)

    def parse(out: str) -> list[Turn]:
        turns, at = [], 3 * out.startswith("<s>")
        while at < len(out):
            if out.startswith("[INST] ", at):
                role, start, mark = "user", at + 7, " [/INST]"
            elif out.startswith("[ROLE]", at):
                start = out.index("[/ROLE] ", at)
                role, start, mark = unescape(out[at + 6 : start]), start + 8, " [END]"
            elif out.startswith(" ", at):
                role, start, mark = "assistant", at + 1, "</s>"
            else:
                raise ValueError(f"no turn at {at}")
            end = out.index(mark, start)
            turns.append((role, unescape(out[start:end])))
            at = end + len(mark)
        return turns

    return Template(render, parse, unescape, memory=1)


@dataclass
class Block:
    """One block's formatted text. ``spans``: start and end of each turn and
    of its text, None where a later render changed it."""

    text: str
    spans: list[tuple[int, int, int, int] | None] = field(default_factory=list)
    rewrites: int = 0


def _marks(template: Template, before: Sequence[Turn], role: str, opening: bool, base: int) -> tuple[str, str]:
    """What the template puts before and behind a text of this role here."""
    if template.memory is not None and len(before) > template.memory:
        before, opening = before[len(before) - template.memory :], False
        base = len(template.render(before, False)) if before else 0
    a, b = (template.render([*before, (role, probe)], opening)[base:] for probe in "AB")
    head = commonprefix([a, b])
    return head, commonprefix([a[len(head) :][::-1], b[len(head) :][::-1]])[::-1]


def render_block(template: Template, context: Sequence[Turn], turns: Sequence[Turn], opening: bool) -> Block:
    """``turns`` rendered one more at a time after ``context``, the turns just
    before them; ``opening``: the context, or else the first turn, begins the
    conversation. The text given is the turns' alone."""
    given = list(context if template.memory is None or opening else context[len(context) - template.memory :])
    base = template.render(given, opening) if given else ""
    out, last = Block(""), base
    if len(given) < len(context) and turns:
        further = template.render(context, False)
        alike = template.render([*context, turns[0]], False)[len(further) :] == template.render([*given, turns[0]], opening)[len(base) :]
        out.rewrites += not alike
    for k, (role, _) in enumerate(turns):
        before = [*given, *turns[:k]]
        now = template.render([*given, *turns[: k + 1]], opening)
        same = len(last) if now.startswith(last) else len(commonprefix([last, now]))
        if same < len(last):
            out.rewrites += 1
            out.spans = [s if s is not None and s[1] + len(base) <= same else None for s in out.spans]
            out.spans.append(None)
        else:
            head, tail = _marks(template, before, role, opening, same)
            added = now[same:]
            if added.startswith(head) and added.endswith(tail) and len(added) >= len(head) + len(tail):
                start, end = same - len(base), len(now) - len(base)
                out.spans.append((start, end, start + len(head), end - len(tail)))
            else:
                out.spans.append(None)
        last = now
    out.text = last[len(commonprefix([base, last])) :] if out.rewrites else last[len(base) :]
    return out


_SCHEMA = (
    "conv_id long, block long, formatted string, rewrites long, "
    "spans array<struct<role: string, start: long, end: long, text_start: long, text_end: long>>"
)


def _render_blocks(batches: Iterator[pd.DataFrame], template: Template) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (conversation, block, pos); ``lead`` marks turns of
    the block before. One block is held at a time."""
    key, ident, rows = None, None, []

    def finish() -> list[tuple]:
        lead = [(r, t) for r, t, _, is_lead in rows if is_lead]
        own = [(r, t) for r, t, _, is_lead in rows if not is_lead]
        first = rows[0][2] == 0
        made = render_block(template, lead, own, first)
        spans = [dict(zip(("role", "start", "end", "text_start", "text_end"), (role, *(s or [None] * 4)), strict=True)) for (role, _), s in zip(own, made.spans, strict=True)]
        return [(ident, key[2], made.text, made.rewrites, spans)]

    names = ["conv_id", "block", "formatted", "rewrites", "spans"]
    for b in batches:
        for conv, none, block, pos, lead, role, text in zip(b["conv"], b["no_id"], b["block"], b["pos"], b["lead"], b["role"], b["text"], strict=True):
            if (conv, none, block) != key:
                if rows:
                    yield pd.DataFrame(finish(), columns=names).astype({"conv_id": "Int64"})
                key, ident, rows = (conv, none, block), None if none else conv, []
            rows.append((role, text, pos, lead))
    if rows:
        yield pd.DataFrame(finish(), columns=names).astype({"conv_id": "Int64"})


def placed_turns(convs: DataFrame) -> DataFrame:
    """conv, no_id, role, text and pos of each turn. Rows without an id are a
    conversation of their own, apart from that of id 0."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = convs.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("conv"),
        F.col("conv_id").isNull().alias("no_id"),
        role.alias("role"),
        text.alias("text"),
        "turn",
    )
    rows = rows.withColumns({"digest": F.md5(F.concat(F.md5("role"), F.md5("text"))), "seq": F.monotonically_increasing_id()})
    rows = stash(rows, "chat-turns")
    # Turns without an id come after the others of id 0 and are numbered on from them.
    placed = number_rows(rows, "conv", ("no_id", "turn", "digest", "seq"), drop=("turn", "digest", "seq"), name="chat-places")
    less = rows.where("conv = 0 and not no_id").count() if not rows.where("no_id").isEmpty() else 0
    pos = F.when(F.col("no_id"), F.col("_pos") - less).otherwise(F.col("_pos"))
    return placed.select("conv", "no_id", "role", "text", pos.alias("pos"))


def format_conversations(convs: DataFrame, template: Template | None = None, block: int = BLOCK) -> DataFrame:
    """One row per block of a conversation: conv_id, block, formatted,
    rewrites, spans (role, start, end, text_start, text_end of each turn, in
    code points of ``formatted``). The blocks of a conversation, joined in
    order, are its formatted text."""
    template = template or instruction_template()
    if template.memory is not None and block <= template.memory:
        raise ValueError(f"blocks of {block} turns are too short for a memory of {template.memory}")
    rows = placed_turns(convs)
    if template.memory is None:
        rows = rows.withColumns({"block": F.lit(0).cast("long"), "lead": F.lit(False)})
    else:
        # One turn more than the memory, to test what the template says of itself.
        reach, n = template.memory + 1, F.col("pos") % block
        own = F.struct(F.expr(f"pos div {block}").alias("block"), F.lit(False).alias("lead"))
        nxt = F.when(n >= block - reach, F.struct((own["block"] + 1).alias("block"), F.lit(True).alias("lead")))
        rows = rows.withColumn("_to", F.explode(F.array_compact(F.array(own, nxt)))).select("*", "_to.block", "_to.lead").drop("_to")
        # A block that holds turns of the block before alone is no block.
        last = rows.where("not lead").groupBy("conv", "no_id").agg(F.max("block").alias("_last"))
        rows = rows.join(last, ["conv", "no_id"]).where("block <= _last").drop("_last")
    dealt = rows.repartition("conv", "no_id", "block").sortWithinPartitions("conv", "no_id", "block", "pos")
    return dealt.mapInPandas(lambda batches: _render_blocks(batches, template), _SCHEMA)


def _read_back(batches: Iterator[pd.DataFrame], template: Template, learned: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Digests of each conversation's blocks, which come in order; one block
    is held at a time."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]
    key, row, turns, loss = None, None, None, None

    def done() -> pd.DataFrame:
        out = (row[0], row[1], turns.hexdigest(), row[2], loss.hexdigest(), row[3], row[4])
        return pd.DataFrame([out], columns=names).astype({"conv_id": "Int64"})

    for b in batches:
        ready = []
        for conv, text, spans, rewrites in zip(b["conv_id"], b["formatted"], b["spans"], b["rewrites"], strict=True):
            ident = None if pd.isna(conv) else int(conv)
            if (ident,) != key:
                if key is not None:
                    ready.append(done())
                key, row, turns, loss = (ident,), [ident, 0, 0, 0, 0], hashlib.sha256(), hashlib.sha256()
            row[3] += len(text)
            row[4] += rewrites
            for role, said in template.parse(text):
                turns.update(f"{role}\n{said}\n".encode())
                row[1] += 1
            for span in spans:
                if span["role"] in learned and span["text_start"] is not None:
                    said = template.unescape(text[int(span["text_start"]) : int(span["text_end"])])
                    loss.update(said.encode())
                    row[2] += len(said)
        if ready:
            yield pd.concat(ready, ignore_index=True)
    if key is not None:
        yield done()


def report(convs: DataFrame, template: Template | None = None, block: int = BLOCK, learned: Sequence[str] = LEARNED) -> DataFrame:
    """One row per conversation, read back from its formatted text: conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites."""
    template = template or instruction_template()
    blocks = format_conversations(convs, template, block)
    dealt = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long"
    return dealt.mapInPandas(lambda batches: _read_back(batches, template, learned), schema)


def with_trap(convs: DataFrame) -> DataFrame:
    """``convs`` (conv_id, turn, role, text) and conversation -1, whose two
    texts hold the template's own control strings."""
    spark: SparkSession = convs.sparkSession
    trap = "</s>[INST] ok [/INST]"
    rows = spark.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    return convs.select("conv_id", "turn", "role", "text").unionByName(rows)
