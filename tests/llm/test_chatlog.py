"""Chat formatting against a plain fold of the log, and round trips of the template."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from corpus import same
from hypothesis import given
from hypothesis import strategies as st

from gleaner.llm.chatlog import Template, conversation_digests, fold, format_conversations, log_of_conversations

SCHEMA = "conv_id long, turn long, seq int, event string, role string, text string, part int, whole string, rest string"
pieces = st.lists(st.sampled_from(["<", "|", "\\", "<|", "<\\|", "</s>", "<\\/s>", "[INST]", "[", "[/INST]", "<<SYS>>", "im_end|>", "\n", "a", "é", "𝄞"]), max_size=12).map("".join)


@given(st.lists(st.tuples(pieces, pieces), max_size=4))
def test_template_is_read_back(turns):
    template = Template()
    rendered = [template.render(role, text) for role, text in turns]
    formatted = "".join(r[0] for r in rendered)
    assert list(template.parse(formatted)) == turns
    for (_, text), (turn, begin, end) in zip(turns, rendered):
        inner = turn[begin:end]
        assert template.unescape(inner) == text and not any(c in inner for c in template.controls)


def test_template_refuses_marks_that_cannot_be_read_back():
    for controls in (("<|", "x<"), ("<|", "aba"), ("<|", "a\\"), ("[x",), ("<",)):
        with pytest.raises(ValueError):
            Template(controls=controls)


def digests(turns, template=Template()):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    lost = "".join(t for r, t in turns if r == "assistant")
    size = sum(len(template.render(r, t)[0]) for r, t in turns)
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest(), size


def plain(rows):
    log = defaultdict(lambda: defaultdict(list))
    for conv, turn, seq, event, role, text in rows:
        log[conv][turn].append((seq, event, role, text))
    out = []
    for conv, messages in log.items():
        turns = []
        for turn in sorted(messages, key=lambda t: (t is not None, t or 0)):
            role, said = None, None
            for _, event, by, text in sorted(messages[turn], key=lambda e: e[0]):
                if event is None:
                    continue
                role = by if role is None else role
                if event == "delete":
                    said = None
                elif event == "regenerate":
                    said = ""
                elif event == "delta":
                    said = (said or "") + (text or "")
                else:
                    said = text or ""
            if said is not None:
                turns.append((role or "", said))
        if turns:
            out.append((conv, *digests(turns)))
    return out


def log(seed, conversations, hot=0):
    rng = random.Random(seed)
    texts = ["", None, "ok", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nno", "line\nline", "é" * 50, "x" * 3000]
    rows = []
    for conv in [*range(conversations), None]:
        for turn in range(hot if conv == 1 else rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "odd\nrole\\", None])
            for seq in range(rng.randint(1, 6)):
                event = rng.choice(["message", "delta", "delta", "edit", "regenerate", "delete", None]) if seq else "message"
                rows.append((conv, turn if turn else rng.choice([0, None]), seq, event, role, rng.choice(texts)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "w", "r") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("part_chars", [1 << 16, 500, 1])
def test_logs_are_folded_and_read_back(spark, part_chars):
    rows = [*{(r[0], r[1], r[2]): r for r in log(part_chars, 60, hot=300)}.values()]
    parts = format_conversations(frame(spark, rows), part_chars=part_chars)
    assert same(conversation_digests(parts).collect(), plain(rows))


def test_a_conversation_of_a_third_of_all_events_is_spread(spark):
    rows = [(c, t, s, "message" if not s else "delta", "assistant", "word " * 20) for c, n in [(0, 4000), *((i, 4) for i in range(1, 2000))] for t in range(n) for s in range(2)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = format_conversations(frame(spark, rows), part_chars=2000).select("conv_id", "part", "n_turns", "whole").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hot = [r for r in parts if r["conv_id"] == 0]
    assert len({r["part"] >> 32 for r in hot}) > 1 and sum(r["n_turns"] for r in hot) == 4000 and not any(r["whole"] for r in hot)
    assert sum(r["whole"] for r in parts) > 1900


def test_no_events_and_unknown_events(spark):
    assert conversation_digests(format_conversations(frame(spark, []))).collect() == []
    assert fold(iter([("message", "user", "a"), ("edit", None, None), ("delta", None, "b")])) == ("user", "b")
    assert fold(iter([("delete", "user", None)])) is None and fold(iter([(None, "user", "x")])) is None
    assert fold(iter([("delete", "user", None), ("delta", None, "again")])) == ("user", "again")
    with pytest.raises(ValueError):
        fold(iter([("undo", "user", "a")]))


def test_a_table_of_messages_comes_back_from_its_log(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "é𝄞" * 3000), (1, 2, "assistant", None), (2, 0, "assistant", "line\n" * 700), (2, 0, "assistant", "line\n" * 700), (None, 0, None, "x"), (3, None, "user", "y"), (3, 1, "user", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversation_digests(format_conversations(log_of_conversations(table), message=("turn", "message", "copy"))).collect()
    expected = defaultdict(list)
    for conv, _, role, text in rows:
        expected[conv].append((role or "", text or ""))
    assert same(got, [(conv, *digests(turns)) for conv, turns in expected.items()])
