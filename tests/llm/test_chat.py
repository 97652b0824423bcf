import hashlib
import random

import pytest

from waymark.llm import chat


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows():
    rng = random.Random(6)
    bits = [*chat.CONTROLS, "<\\s>", "[\\\\INST]", "<", "[", "\\", "\n", "<|", "|im_end|>", "s>", "a", "Ü", "😀", " "]
    text = lambda n: "".join(rng.choice(bits) for _ in range(n))
    out = [(c, t, rng.choice(["user", "assistant", "system", "a\\n\nb", "<s>", "\\"]), text(rng.randrange(12))) for c in range(40) for t in range(rng.randrange(1, 9))]
    out += [(50, None, "assistant", "first"), (50, 0, "user", None), (50, 1, None, "x"), (50, 1, None, None), (51, 0, "assistant", "")]
    out += [(None, 2, "assistant", "y"), (None, 1, "user", "z"), (52, 0, "assistant", "same"), (52, 0, "assistant", "same"), (53, 0, "assistant", "long " * 200_000)]
    return out + [(54, t, "assistant" if t % 2 else "user", text(9)) for t in range(500)] + [(-7, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(["user", "assistant"])]


def ordered(rows):
    turns = {}
    for conv, turn, role, text in rows:
        turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    # Strings in the order of their bytes, as Spark has it.
    return {c: [(r, t) for *_, r, t in sorted(x, key=lambda y: (*y[:2], y[2].encode(), y[3].encode()))] for c, x in turns.items()}


SCHEMA = "conv_id long, turn long, role string, text string, piece string, start int"


def frame(spark):
    return spark.createDataFrame([(*r, "p", 1) for r in rows()], SCHEMA).repartition(4)


@pytest.mark.parametrize("window", [1, 4, 64])
def test_what_is_read_back_is_what_was_given(spark, window):
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(frame(spark), window).collect()}
    want = {}
    for conv, turns in ordered(rows()).items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        want[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt), len(chat.marked_turns(turns)))
    assert got == want


def test_pieces_and_spans_make_the_rendering(spark):
    got = {}
    for r in chat.formatted(frame(spark), chat.ChatRules(window=8)).collect():
        got.setdefault(r["conv_id"], []).append(r)
    for conv, turns in ordered(rows()).items():
        pieces = sorted(got[conv], key=lambda r: r["position"])
        whole = "".join(r["piece"] for r in pieces)
        assert whole == chat.marked_turns(turns) and not any(r["rewritten"] for r in pieces)
        for r, (role, text) in zip(pieces, turns):
            assert whole[r["start"]:r["end"]] == r["piece"]
            assert (r["loss_start"] is None) == (role != "assistant")
            if role == "assistant":
                assert chat.restore(whole[r["loss_start"]:r["loss_end"]]) == text


def test_escaping_is_reversible_and_leaves_no_controls():
    rng = random.Random(1)
    bits = [*chat.CONTROLS, "<", "[", "\\", "s>", "/s>", "INST]", "|im_end|>", "x"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
        assert chat.restore(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROLS)
    assert len({chat.escape(t) for t in ("<s>", "<\\s>", "<\\\\s>")}) == 3


def headed(turns):
    return "<s>" + "".join(f"[{r}]{t}</s>" for r, t in turns)


def forgetful(turns):
    """Drops what the assistant said before the last turn, as templates that strip earlier reasoning do."""
    return "".join(f"{r}:{t if r != 'assistant' or i == len(turns) - 1 else ''};" for i, (r, t) in enumerate(turns))


def numbered(turns):
    return "".join(f"{i}{r}:{t};" for i, (r, t) in enumerate(turns))


def test_templates_that_rewrite_history_are_marked():
    talk = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", ""), ("user", "d")]
    rows = chat.Conversation(chat.ChatRules(forgetful))
    marked = [rows.add(*t) for t in talk]
    assert [m[-1] for m in marked] == [False, False, True, False, False]
    last = max(i for i, m in enumerate(marked) if m[-1])
    assert "".join(m[0] for m in marked[last:]) == forgetful(talk) and marked[2][1:5] == (None,) * 4


@pytest.mark.parametrize("render", [headed, numbered, chat.marked_turns])
def test_black_boxes_with_a_small_window(render):
    talk = [("assistant" if i % 2 else "user", f"a{i}b" * (i % 4)) for i in range(40)]
    rows = chat.Conversation(chat.ChatRules(render, window=4))
    got = [rows.add(*t) for t in talk]
    whole = "".join(p[0] for p in got)
    assert whole == render(talk) and not any(p[-1] for p in got)
    assert [whole[p[3]:p[4]] for p in got if p[3] is not None] == [t for r, t in talk if r == "assistant"]


def echoing(turns):
    """Repeats what was said a hundred turns before."""
    return "".join(f"{r}:{t}{turns[i - 100][1] if i >= 100 else ''};" for i, (r, t) in enumerate(turns))


def test_a_template_that_looks_back_on_more_turns_than_the_window():
    talk = [("user", f"t{i}") for i in range(250)]
    rows = chat.Conversation(chat.ChatRules(echoing))
    got = [rows.add(*t) for t in talk]
    assert "".join(p[0] for p in got) == echoing(talk) and not any(p[-1] for p in got)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(empty).count() == 0 and chat.formatted(empty).count() == 0
