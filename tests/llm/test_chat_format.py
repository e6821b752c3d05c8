import hashlib
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from quillmask.llm import chat_format as cf
from quillmask.llm.query_chats import op9_chat_format

PIECES = st.lists(st.sampled_from(["<", "\\", "[", "/s>", "s>", "INST]", "/INST]", "<SYS>>", "|end|>", "|start|>", "a", "\n", " ", *cf.CONTROLS]), max_size=8).map("".join)


@given(PIECES)
def test_escaping_is_reversible_and_hides_controls(text):
    hidden = cf.escape(text)
    assert cf.unescape(hidden) == text
    assert not any(c in hidden for c in cf.CONTROLS)
    assert cf.unescape_role(cf.escape_role(text)) == text


@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_assembled_turns_parse_back(turns):
    out, places, start, length = cf.assemble([r for r, _ in turns], [t for _, t in turns])
    for i, (role, text) in enumerate(turns):
        data = out[places[i] : places[i + 1]].tobytes()
        assert cf.parse_turn(data) == (role, text)
        assert data[start[i] : start[i] + length[i]].decode() == cf.escape(text)


def formatted(role, text):
    return f"{cf.START}{cf.escape_role(role or '')}\n{cf.escape(text or '')}{cf.END}\n"


def brute(rows):
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]].append(r)
    out = {}
    for k, turns in convs.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1], r[2] or "", formatted(*r[2:]).encode()))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[k] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(formatted(*r[2:])) for r in turns))
    return out


def check(got, rows):
    want = brute(rows)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in got} == want
    assert len(got) == len(want)


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(op9_chat_format(spark, d).collect(), [*rows, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")])


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "x"), (None, None, "assistant", "<s>"), (2, 0, "assistant", "é" * 200_000), (2, 0, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", cf.F.lit(1))
    check(cf.read_back(cf.format_turns(df)).collect(), rows)
    assert cf.read_back(cf.format_turns(df.limit(0))).collect() == []
