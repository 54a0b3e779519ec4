import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import chat_format as chat

PIECES = st.lists(st.sampled_from([*chat.CONTROLS, "<", "[", "\\", "s>", "INST]", "SYS>>", "a", "é", " ", "\n", "<\\s>"]), max_size=10).map("".join)


@given(PIECES | st.text(max_size=30))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_hides_controls(text):
    shown = chat.escape(text)
    assert chat.unescape(shown) == text and not any(c in shown for c in chat.CONTROLS)


@given(st.none() | PIECES | st.sampled_from(["user", "system", "assistant"]), st.none() | PIECES)
@settings(max_examples=200, deadline=None)
def test_turn_round_trip(role, text):
    t = chat.Tokenizer()
    enc = chat._load(t)
    ids, mask = chat.assemble(chat.segments(role, text), enc, t.reserved)
    assert chat.read_turn(ids, enc, t.reserved) == (role or "", text or "")
    masked = chat.unescape(enc.decode_bytes(ids[mask > 0].tolist()).decode())
    assert masked == ((text or "") if role == "assistant" else "")


def expected(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    result = {}
    for conv, turns in out.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        shown = "<s>" + "".join("".join(chat.CONTROLS[p] if isinstance(p, int) else p for p, _ in chat.segments(r, t)) for r, t in turns)
        result[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(shown))
    return result


def test_conversations(spark):
    rnd = random.Random(1)
    rows = []
    for conv in [*range(30), None]:
        for turn in range(rnd.randint(1, 6)):
            rows.append((conv, rnd.choice([turn, turn, None]), f"{rnd.choice(['user', 'assistant', 'system', 'tool'])}", rnd.choice(["héllo </s> x", "", None, "[INST]", "x" * rnd.randint(0, 300)])))
    rows += [(76, t, r, x) for t in (0, None) for r in ("user", None, "") for x in ("b", "a", None, "é", "zz", "c", "")]  # ties, in texts too
    rows += [(77, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(3000)]  # a long conversation
    rows += [(78, 0, "assistant", "long " * 60_000), (79, 0, "user", "same"), (79, 0, "user", "same")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    turns = chat.format_turns(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.digests(turns).collect()}
    assert got == expected(rows)
    ordered = [r for r in turns.where("conv_id = 77").orderBy("n").collect()]
    before = 0
    for i, r in enumerate(ordered):
        assert (r.n, r.first_token) == (i, before) and len(r.ids) == len(r.loss)
        before += len(r.ids)


def test_ids_of_long_texts_are_the_tokenizer_s():
    t = chat.Tokenizer()
    enc, rnd = chat._load(t), random.Random(4)
    words = " ".join("".join(rnd.choice("abcé1 -'\n\x1c中") for _ in range(rnd.randint(1, 12))) for _ in range(40_000))
    for text in (words[:200_000], " ".join(["a"] * 120_000), "word" * 20_000 + " " * 70_000 + "x y" * 30_000, "a\xa0 b" * 40_000, ""):
        assert chat._encode(enc, text) == enc.encode_ordinary(text)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_turns(df)).count() == 0
