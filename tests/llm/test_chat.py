"""Template compiler and chat formatting: syntax, sandbox, folding, round trips, streams, edge rows."""

import hashlib
import random

import pytest

from weekpanel.llm import chat
from weekpanel.llm.chat import Const, If, Print, TemplateError, Text, compile_template, escape, fold_body, parse, unescape

SCHEMA = "conv_id long, turn long, role string, text string, chunk long, spans string, messages string"


def rendered(source, **context):
    return "".join(t for t, _ in compile_template(source)(**context))


@pytest.mark.parametrize("source, context, expected", [
    ("plain", {}, "plain"),
    ("{{ a }}-{{ a | upper }}", {"a": "x"}, "x-X"),
    ("{{ 'it\\'s\\n' }}", {}, "it's\n"),
    ("{{ a.b['c'] }}|{{ a.z }}|{{ q.r }}", {"a": {"b": {"c": 3}}}, "3||"),
    ("{% if a == 1 %}one{% elif a == 2 %}two{% else %}many{% endif %}", {"a": 2}, "two"),
    ("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", {"xs": "no text loops"}, ""),
    ("{% for x in xs %}{{ loop.index0 }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}{{ x }}", {"xs": ["a", "b"]}, "0a,1b"),
    ("{% for x in xs %}{% for y in ys %}{{ loop.index }}{% endfor %}{{ loop.index }};{% endfor %}", {"xs": [1, 2], "ys": [1, 2, 3]}, "1231;1232;"),
    ("a {%- if true -%} b {%- endif -%} c", {}, "abc"),
    ("{# remark {{ a }} #}x", {}, "x"),
    ("{% set a = b ~ 1 %}{{ a | length }}{{ a if a == 'q1' else none }}", {"b": "q"}, "2q1"),
    ("{{ not a and 1 < 2 or 'b' in 'abc' }}", {"a": 0}, "true"),
    ("{{ 'a' < 1 }}{{ none }}{{ false }}", {}, "falsefalse"),
    ("{{ not not a }}", {"a": "x"}, "true"),
    ("{{ ('a' if a else 'b') ~ 'c' }}", {"a": False}, "bc"),
])
def test_language(source, context, expected):
    assert rendered(source, **context) == expected


@pytest.mark.parametrize("source", [
    "{{ a.b() }}", "{{ f(1) }}", "{% if a %}", "{% endif %}", "{{ a | eval }}", "{{ a", "{{ }}", "{{ a b }}", "{{ 1 + 1 }}",
    "{% include 'x' %}", "{% for if in a %}{% endfor %}", "{% set loop = 1 %}", "{{ a[ }}", "{{ ; }}", "{{ 'open }}",
    "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{{ " + "(" * 60 + "a" + ")" * 60 + " }}",
    "{% if a %}" * 60 + "{% endif %}" * 60,
])
def test_templates_that_are_refused(source):
    with pytest.raises(TemplateError):
        compile_template(source)


def test_sandbox_sees_mappings_only():
    class Secret:
        key = "secret"

    assert rendered("{{ s.key }}{{ s.__class__ }}{{ t.__len__ }}{{ d[d] }}", s=Secret(), t="x", d={"a": 1}) == ""


def test_folding():
    assert fold_body(parse("a{{ 'b' | upper }}{% if 1 == 1 %}c{{ 2 ~ 'd' }}{% else %}{{ x }}{% endif %}e")) == (Text("aBc2de"),)
    assert fold_body(parse("{% for x in 'abc' %}{{ x }}{% endfor %}{% generation %}{% endgeneration %}")) == ()
    (node,) = fold_body(parse("{% if a and true %}x{% endif %}"))
    assert isinstance(node, If) and node.then == (Text("x"),)
    (node,) = fold_body(parse("{{ a if not 1 else 'x' ~ b }}"))
    assert isinstance(node, Print) and node.of.parts[0] == Const("x")


def test_folded_and_plain_trees_render_alike():
    rng = random.Random(3)

    def expression(deep):
        if deep == 0:
            return rng.choice(["'a'", "1", "true", "none", "x", "y.k", "''"])
        a, b, c = (expression(deep - 1) for _ in range(3))
        return rng.choice([f"({a} ~ {b})", f"({a} == {b})", f"({a} and {b})", f"({a} or {b})", f"(not {a})", f"({a} if {b} else {c})", f"({a} | upper)"])

    for _ in range(300):
        tree = parse(f"[{{{{ {expression(3)} }}}}]{{% if {expression(2)} %}}p{{% else %}}q{{% endif %}}")
        context = {"x": rng.choice([None, "v", 0, 7]), "y": {"k": rng.choice(["w", "", None])}}
        plain, folded = (chat._sequence(t, False) for t in (tree, fold_body(tree)))
        assert "".join(t for t, _ in plain(dict(context))) == "".join(t for t, _ in folded(dict(context)))


@pytest.mark.parametrize("text", ["", "\\", "\\l", "<", "</turn>", "a\\\n<b>\\\\l<", chat.TURNS, "ü\\ü"])
def test_escapes_are_reversible(text):
    assert "<" not in escape(text) and unescape(escape(text)) == text


def test_rendering_is_lazy():
    def endless():
        i = 0
        while True:
            yield {"role": "assistant", "text": str(i)}
            i += 1

    pieces = compile_template(chat.TURNS)(messages=endless())
    marked = [next(pieces) for _ in range(5000)]
    assert [t for t, m in marked if m][:3] == ["0", "1", "2"]


def expected(conversations):
    out = {}
    for conv, rows in conversations.items():
        turns = "".join(f"{r}\n{t}\n" for r, t in rows)
        loss = "".join(t for r, t in rows if r == "assistant")
        out[conv] = (len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def read(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "s", "m") for r in rows], SCHEMA)
    formatted = chat.format_conversations(df, **options)
    return formatted, {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(formatted).collect()}


ROWS = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "<turn>user<text>\\"), (1, 2, "assistant", "</turn>\n\\l"), (1, 2, "assistant", "</turn>\n\\l"),
    (2, None, None, None), (2, None, "assistant", "before"), (2, 5, "assistant", "after ü\U0001f600"), (2, 5, "assistant", ""),
    (None, 0, "user", "no id"), (None, 1, "assistant", "x" * 700_000), (3, 0, "<text>", "odd role"),
]
TOLD = {
    1: [("system", "Be brief."), ("user", "<turn>user<text>\\"), ("assistant", "</turn>\n\\l"), ("assistant", "</turn>\n\\l")],
    2: [("", ""), ("assistant", "before"), ("assistant", ""), ("assistant", "after ü\U0001f600")],
    None: [("user", "no id"), ("assistant", "x" * 700_000)],
    3: [("<text>", "odd role")],
}


def test_edges_come_back(spark):
    formatted, got = read(spark, ROWS)
    assert got == expected(TOLD)
    text = {r.conv_id: r.text for r in formatted.filter("conv_id = 1").collect()}[1]
    assert text.startswith("<turn>system<text>Be brief.</turn>\n<turn>user<text>\\lturn>")


def test_small_chunks_lose_nothing(spark):
    rows = [(7, i, ("user", "assistant")[i % 2], f"<{i}>\\" * (i % 5)) for i in range(3000)]
    formatted, got = read(spark, rows, chunk_chars=64)
    assert formatted.count() > 100
    assert got == expected({7: [(r, t) for _, _, r, t in rows]})


def test_empty_table(spark):
    formatted, got = read(spark, [])
    assert got == {} and formatted.count() == 0 and formatted.columns == ["conv_id", "chunk", "text", "spans"]


def test_bad_template_fails_before_any_row(spark):
    with pytest.raises(TemplateError):
        chat.format_conversations(spark.createDataFrame([], SCHEMA), "{% for %}")
