"""Chat logs against a plain fold of each conversation's events, and the template's round trip."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from paperloom.llm import chat_format
from paperloom.llm.chat_format import Template

SCHEMA = "conv_id long, turn long, part long, seq long, kind string, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", "<", "|", "<\\|", "é<<SYS>>ü<</SYS>>", "", "a\nb", "[", "<<s>s>", "\U0001f600<s>"]


def plain(events):
    """Replays a conversation's events one after another."""
    low = lambda x: (x is not None, x or 0)
    found = {}
    for e in sorted(set(events), key=lambda e: (low(e[3]), low(e[1]), low(e[2]), e[4] or "", e[5] is not None, e[5] or "", e[6] is not None, e[6] or "")):
        _, turn, part, _, kind, role, text = e
        if kind not in chat_format.KINDS:
            continue
        at = (low(turn), low(part))
        if kind == "regenerate":
            found = {k: m for k, m in found.items() if k <= at}
        was = found.get(at, ("", ""))
        found[at] = (was[0] if role is None else role, (was[1] if kind == "delta" else "") + (text or ""))
    return [found[k] for k in sorted(found)]


@pytest.fixture(scope="module")
def logs():
    rnd, rows = random.Random(5), []
    for conv in [None, *range(40)]:
        seq = 0
        for _ in range(rnd.randint(1, 60)):
            seq += 1
            kind = rnd.choices(["message", "delta", "edit", "regenerate", "typing", None], [4, 9, 2, 1.5, 1, 0.3])[0]
            row = (conv, rnd.choice([None, 0, 1, 2, 3, 7, 8, 9]), rnd.choice([None, None, 4]), seq if rnd.random() > 0.02 or kind == "regenerate" else None, kind, rnd.choice(["user", "assistant", None, "a\nb\\"]), rnd.choice([*NASTY, None, "word "]))
            rows += [row] * rnd.choice([1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_messages_digests_and_round_trip(spark, logs, block):
    shuffled = random.Random(1).sample(logs, len(logs))
    log = spark.createDataFrame(shuffled, SCHEMA).withColumns({"block": F.lit(5), "whole": F.lit("x"), "formatted": F.lit("y")})
    pieces = chat_format.rendered(chat_format.messages(log, block))
    want = {c: plain([r for r in logs if r[0] == c]) for c in {r[0] for r in logs}}
    want = {c: m for c, m in want.items() if m}
    got = {}
    for r in pieces.collect():
        got.setdefault(r["conv_id"], []).append(r)
        assert r["whole"] in (True, False)
    low = lambda x: (x is not None, x or 0)
    template = Template()
    assert got.keys() == want.keys()
    for c, rows in got.items():
        rows.sort(key=lambda r: (low(r["turn"]), low(r["part"])))
        assert [template.read(r["formatted"]) for r in rows] == want[c]
        for r, (role, text) in zip(rows, want[c], strict=True):
            assert (r["loss_start"] is None) == (role != "assistant")
            inside = r["formatted"][len(template.start) : -len(template.end)]
            assert not any(x in inside for x in template.controls)
            if r["loss_start"] is not None:
                assert chat_format.unescaped(r["formatted"][r["loss_start"] : r["loss_end"]]) == text
    for r in chat_format.digests(pieces).collect():
        turns, learned = want[r["conv_id"]], "".join(t for role, t in want[r["conv_id"]] if role == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(learned))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(x["formatted"]) for x in got[r["conv_id"]])


def test_turns_to_log_and_back(spark):
    rnd = random.Random(2)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None]), rnd.choice([*NASTY, None, "wörd " * rnd.randint(1, 900)])) for c in [None, *range(30)] for t in [None, *range(rnd.randint(0, 9))]]
    rows += [(3, 0, "user", "same turn"), (-1, 0, "assistant", "z" * 3_000_000)]
    log = chat_format.logged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chunk=50)
    got = {}
    for r in chat_format.messages(log, 4).collect():
        got.setdefault((r["conv_id"], r["turn"]), set()).add((r["role"], r["text"]))
    want = {}
    for c, t, role, text in rows:
        want.setdefault((c, t), set()).add((role or "", text or ""))
    assert got == want
    assert chat_format.digests(chat_format.rendered(chat_format.messages(log.limit(0)))).count() == 0


def test_templates_that_a_text_could_break_are_refused():
    for wrong in ({"end": "END"}, {"start": "\\<|"}, {"controls": ("<",)}, {"controls": ("<|", "x<")}, {"controls": ("<|", "><")}):
        with pytest.raises(ValueError):
            Template(**wrong)
    assert Template(start="[INST]", end="</s>").read("[INST]user\nhi</s>") == ("user", "hi")
    with pytest.raises(ValueError):
        Template().read("<|im_start|>user\nhi")
