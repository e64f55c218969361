import hashlib
import random

import pytest

from tessera.llm import chat_format as cf
from tessera.llm.chat_format import Turn


def test_escape_is_reversible_and_leaves_no_control_string():
    rng = random.Random(3)
    parts = cf.CONTROL + ["\\", "<", "|", ">", "a", "\n", "/", "s", "[", "<|end|>", cf.ROLE]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        safe = cf.escape(text)
        assert cf.unescape(safe) == text
        assert not any(c in safe for c in cf.CONTROL)


@pytest.mark.parametrize("window", [1, 2, 5, None])
def test_spans_are_the_turns(window):
    turns = [Turn("user", "<|end|>"), Turn("", ""), Turn("assistant", "\\</s>")] * 4
    spans = list(cf.turn_spans(turns, cf.render, window))
    assert "".join(spans) == cf.render(turns)
    assert [cf.parse(s) for s in spans] == turns


def test_templates_that_look_back_keep_their_spans():
    def numbered(turns):  # marks a turn by the role before it
        return "".join(f"[{turns[i - 1].role if i else ''}>{t.role}]{t.text}" for i, t in enumerate(turns))

    turns = [Turn("u", str(i)) if i % 2 else Turn("a", str(i)) for i in range(9)]
    assert "".join(cf.turn_spans(turns, numbered, 3)) == numbered(turns)


@pytest.mark.parametrize("template", [
    lambda turns: cf.render([Turn(t.role, t.text.strip()) if t is not turns[-1] else t for t in turns]),
    lambda turns: f"{len(turns)}:" + cf.render(turns),
    lambda turns: cf.render(turns[-2:])])
def test_rewritten_history_is_found(template):
    with pytest.raises(cf.Rewrites):
        list(cf.turn_spans([Turn("user", " a "), Turn("assistant", " b "), Turn("user", " c ")], template))


def numbered_rounds(turns):
    return "<bos>" + "".join(f"[Round {i + 1}]{t.role}:{t.text}\n" for i, t in enumerate(turns))


def user_first(turns):
    if turns[0].role != "user":
        raise ValueError("a user turn must come first")
    return cf.render(turns)


LONG = [Turn("assistant" if i % 2 else "user", f"t{i}") for i in range(150)]


@pytest.mark.parametrize("template", [numbered_rounds, user_first])
@pytest.mark.parametrize("n", [1, 31, 32, 33, 50, 64, 150])
def test_long_conversations_are_rendered_as_a_whole(template, n):
    assert list(cf.turn_spans(LONG[:n], template)) == list(cf.turn_spans(LONG[:n], template, None))
    assert "".join(cf.turn_spans(LONG[:n], template)) == template(LONG[:n])


@pytest.mark.parametrize("n", [41, 50, 64, 150])
def test_history_rewritten_behind_the_window_is_found(n):
    keeps_40 = lambda turns: cf.render(turns[-40:])
    assert "".join(cf.turn_spans(LONG[:40], keeps_40)) == cf.render(LONG[:40])
    with pytest.raises(cf.Rewrites):
        list(cf.turn_spans(LONG[:n], keeps_40))


def test_whole_prefixes_are_rendered_few_times():
    long = []

    def template(turns):
        if len(turns) > cf.WINDOW:
            long.append(len(turns))
        return "".join(f"{t.role}:{t.text}\n" for t in turns)

    list(cf.turn_spans(LONG * 20, template))
    assert sum(long) <= 3 * len(LONG * 20)


def test_other_templates_reach_spark(spark):
    rows = [(c, i, *t) for c, n in ((1, 50), (2, 3), (None, 70)) for i, t in enumerate(LONG[:n])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got, template = {}, lambda turns: "<bos>" + "".join(f"[Round {i + 1}]{t.role}:{t.text}\n" for i, t in enumerate(turns))
    for r in cf.format_turns(df, template=template).orderBy("position").collect():
        assert ((r["loss_from"], r["loss_to"]) == (0, len(r["span"]))) == (r["position"] % 2 == 1)
        got[r["conv_id"]] = got.get(r["conv_id"], "") + r["span"]
    assert got == {c: numbered_rounds(LONG[:n]) for c, n in ((1, 50), (2, 3), (None, 70))}
    read = lambda span: Turn(*span.rstrip("\n").split("]")[1].split(":"))
    own = {r["conv_id"]: r for r in cf.digests(df).collect()}
    for r in cf.digests(df, template=template, read=read).collect():
        assert (r["n_turns"], r["turns_sha256"]) == (own[r["conv_id"]]["n_turns"], own[r["conv_id"]]["turns_sha256"])
        assert r["formatted_chars"] == len(got[r["conv_id"]])
    with pytest.raises(ValueError, match="read"):
        cf.digests(df, template=numbered_rounds)


def test_digests_equal_the_input(spark):
    rng = random.Random(4)
    rows = []
    for conv in [1, 2, 3, None, 9007199254740993]:
        for turn in range(rng.randrange(1, 80)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "sys\ntem", ""]),
                         rng.choice(["", "</s>[INST] ok [/INST]", "h\u00e9 \U0001f642\\", "x" * 5000])))
    rows += [(4, 0, None, None), (4, None, "assistant", None), (5, 1, "assistant", "b"), (5, 1, "assistant", "a"),
             (5, 1, "assistant", "a")]
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0,
                                                             r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r["conv_id"]: r for r in cf.digests(df.repartition(4), window=6).collect()}
    assert set(got) == set(want)
    for conv, turns in want.items():
        r, loss = got[conv], "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == len(cf.render([Turn(*t) for t in turns]))
    spans = cf.format_turns(df.filter("conv_id = 1")).orderBy("position").collect()
    assert "".join(s["span"] for s in spans) == cf.render([Turn(*t) for t in want[1]])
    for s, (role, text) in zip(spans, want[1]):
        masked = s["span"][s["loss_from"]:s["loss_to"]] if s["loss_from"] is not None else None
        assert masked == (cf.escape(text) if role == "assistant" else None)
    assert cf.digests(df.limit(0)).count() == 0
