import hashlib
from itertools import islice, repeat

import pytest
from pyspark.sql import functions as F

from copyloom.llm.chat import CONTROL, END, MIDDLE, START, escaping, format_conversations, read_formatted
from copyloom.llm.queries import op1_chat
from copyloom.llm.template import Const, Output, TemplateError, compile_template, fold, parse

COLUMNS = "conv_id long, turn long, role string, text string"


def text(source, filters=None, **names):
    return "".join(t for t, _ in compile_template(source, filters)(**names))


def test_language():
    assert text("a{{ x.y }}{{ x['z'] }}{{ q }}", x={"y": 1, "z": None}) == "a1"
    assert text("{% for i in l %}{{ loop.index0 }}{{ i }}{% if not loop.last %},{% endif %}{% endfor %}", l=["a", "b"]) == "0a,1b"
    source = "{% if a == 'x' %}1{% elif a in 'yz' and b %}2{% else %}3{% endif %}"
    assert [text(source, a=a, b=True) for a in "xyw"] == ["1", "2", "3"]
    assert text("{% set k = 'a' ~ 1 + 'b' %}{{ k | up }}", {"up": str.upper}) == "A1B"
    assert text("{{ 1 + 2 }}{{ 'it\\'s' }}{{ (a or 'b') }}{{ \"}\" }}", a="") == "3it'sb}"


def test_sandbox():
    assert text("{{ x.__class__ }}{{ x.upper }}{{ x['__doc__'] }}", x="s") == ""
    for bad in ("{{ f() }}", "{% include x %}", "{% for x in y %}", "{{ a + }}", "{% endif %}", "{{ a b }}", "{{ 'a' | open }}", "{% if a %}{% endfor %}"):
        with pytest.raises(TemplateError):
            compile_template(bad)


def test_constants_are_folded():
    nodes = fold(parse("a{{ 'b' ~ 1 }}{% if 1 == 2 %}x{% else %}{{ 'c' | up }}{% endif %}{{ '' }}d"), {"up": str.upper})
    assert nodes == (Output(Const("ab1Cd")),)
    assert fold(parse("{% generation %}{{ 'a' + 'b' }}{% endgeneration %}"), {})[0].body == (Output(Const("ab")),)


def test_loops_are_lazy():
    pieces = compile_template("{% for m in messages %}{{ m }}{% endfor %}")(messages=repeat("x"))
    assert list(islice(pieces, 5)) == [("x", False)] * 5


def test_escaping_is_reversible_and_leaves_no_control_string():
    there, back = escaping()
    for s in (*CONTROL, "\\", "\\<s>", "\\\\b[", "<<s>>", "a\\", "<|im_end|>\n<|im_start|>assistant"):
        assert back(there(s)) == s and not any(c in there(s) for c in CONTROL)


def brute(rows):
    out, groups = [], {}
    for conv, turn, role, t in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", t is not None, t or ""))
    for conv, turns in groups.items():
        turns.sort(key=lambda x: (x[0], x[1], x[2], x[3].encode(), x[4], x[5].encode()))
        whole = "".join(f"{x[3]}\n{x[5]}\n" for x in turns)
        loss = "".join(x[5] for x in turns if x[3] == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(turns), digest(whole), len(loss), digest(loss)))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_query_on_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    tricky = "</s>[INST] ok [/INST]"
    assert result(op1_chat(spark, small)) == brute([*rows, (-1, 0, "user", tricky), (-1, 1, "assistant", tricky)])


def test_nulls_ties_long_and_many_turns(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, 0, "user", ""), (1, None, "a\nb", "\\n"), (None, 3, "assistant", "x"), (None, 1, "user", None)]
    rows += [(2, 0, "assistant", "é<" * 60_000), (2, 0, "assistant", "é<" * 60_000), (3, i := 0, "assistant", f"{START}{MIDDLE}{END}\n{i}")]
    rows += [(4, i, ("user", "assistant")[i % 2], f"[INST]{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("conv", F.lit("clash")).withColumn("part", F.lit(1))
    formatted = format_conversations(df, part_chars=1000)
    assert result(read_formatted(formatted)) == brute(rows)
    assert formatted.where("conv = 4").agg(F.max("part")).head()[0] > 10
    assert formatted.agg(F.max(F.length("formatted"))).head()[0] < 200_000


def test_empty_table(spark):
    assert read_formatted(format_conversations(spark.createDataFrame([], COLUMNS))).count() == 0
