"""The template compiler, and formatted conversations against a rendering in plain Python and a plain digest."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenspan.llm.chat_format import CONTROLS, TEMPLATE, digests, escape, format_chat, read, unescape
from lumenspan.llm.chat_template import Mark, Template, TemplateError, Text

FRAGMENTS = st.lists(st.sampled_from([*CONTROLS, "\\", "<", "[", "/", "s>", " ", "\n", "a", "é", "INST]", "\x00", "{{", "%}"]), max_size=12).map("".join)


@pytest.mark.parametrize(
    "source, names, told",
    [
        ("a{{ 1 + 2 * 3 }}b", {}, "a7b"), ("{{ x | trim | upper }}", {"x": " é "}, "É"), ("{{ x.y[1] ~ x['z'] }}", {"x": {"y": [1, 2], "z": "q"}}, "2q"),
        ("{% for a in l %}{{ loop.index0 }}{{ a }}{{ '' if loop.last else ',' }}{% endfor %}", {"l": ["x", "y"]}, "0x,1y"), ("{% if a and not b %}1{% elif b %}2{% else %}3{% endif %}", {"a": 1, "b": 0}, "1"),
        ("{% set x = 'q' %}{{ x }}{# {{ none }} #}", {}, "q"), (" {{- 'a' -}} \n b", {}, "ab"), ("{{ 'x' in ['x', 'y'] and 'z' not in 'xy' }}", {}, "True"), ("{{ missing }}{{ missing.a | default('d') }}", {}, "d"),
        ("{{ '%}' ~ \"}}\" }}", {}, "%}}}"), ("{{ -(7 // 2) % 5 }}", {}, "2"), ("{{ ['a', 'b'] | join('-') | replace('-', '+') }}", {}, "a+b"), ("", {}, ""), ("{{ '\\n' }}", {}, "\n"),
    ],
)
def test_templates(source, names, told):
    assert Template(source).render(**names) == (told, [])


@pytest.mark.parametrize("source", ["{{ x.__class__ }}", "{{ _x }}", "{{ x['__class__'] }}", "{{ x() }}", "{{ 'a' * 9 }}", "{% for a in b %}", "{% if a %}", "{{ a", "{{ a | open }}", "{{ }}", "{% import x %}", "{{ 1 // 0 }}", "{{ a b }}", "{% else %}", "{{ if }}"])
def test_templates_that_are_refused(source):
    with pytest.raises(TemplateError):
        Template(source)


@pytest.mark.parametrize("source, names", [("{{ x.real }}", {"x": 3}), ("{{ x['__len__'] + 1 }}", {"x": {}}), ("{% for a in x %}{% endfor %}", {"x": "text"}), ("{{ x }}", {"x": object()}), ("{{ x + 1 }}", {"x": "a"})])
def test_values_that_are_refused(source, names):
    with pytest.raises(TemplateError):
        Template(source).render(**names)


def test_constants_are_folded_and_marks_told():
    t = Template("a{% if 1 == 1 %}{{ 'b' | upper }}{% generation %}{{ 2 + 3 }}{% endgeneration %}{% else %}{{ x }}{% endif %}{% if false %}n{% endif %}d{{ 'e' }}")
    assert t.tree == (Text("aB"), Mark((Text("5"),)), Text("de"))
    assert t.render() == ("aB5de", [(2, 3)])


@pytest.mark.parametrize("source", ["{{ messages }}{% for m in messages %}{% endfor %}", "x", "{% for m in messages %}{{ messages }}{% endfor %}", "{% set a = 1 %}{% for m in messages %}{% endfor %}"])
def test_templates_without_one_loop_are_not_streamed(source):
    with pytest.raises(TemplateError):
        Template(source).over("messages")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), FRAGMENTS), FRAGMENTS), max_size=6))
def test_reads_back_what_it_wrote(turns):
    text, spans = Template(TEMPLATE, {"escape": escape}).render(messages=[{"role": r, "text": t} for r, t in turns])
    assert read(text) == turns
    assert [unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert not any(c in escape(t) for _, t in turns for c in CONTROLS)


def plain(rows):
    """Digests by conversation, without any template."""
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    told = {}
    for conv, turns in out.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        text, _ = Template(TEMPLATE, {"escape": escape}).render(messages=[{"role": r, "text": t} for r, t in turns])
        told[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text))
    return told


@pytest.mark.parametrize("slices, piece", [(1, 1 << 20), (8, 300)])
def test_conversations_of_any_length(spark, slices, piece):
    rows = [(1, k, ["user", "assistant", "x", "assistant"][k % 4], f"t{k} [INST] \\ <s>é" * (k % 5)) for k in range(700)]
    rows += [(2, 0, None, None), (None, None, None, "x"), (None, 3, "user", None), (3, 1, "assistant", ""), (4, 1, "user", "same"), (4, 1, "user", "same"), (5, 0, "assistant", "long " * 30_000)]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "conv_id long, turn long, role string, text string, slice string, piece int").repartition(3)
    pieces = format_chat(df, slices=slices, piece_chars=piece)
    if slices > 1:
        assert pieces.where("conv_id = 1").select("slice").distinct().count() >= 6
    got = {r.conv_id: tuple(r)[1:] for r in digests(pieces).collect()}
    assert got == plain(rows)


def test_parts_make_the_whole(spark):
    """loop.first and loop.last hold for a conversation, not for its part in a slice; text around the loop appears once."""
    source = "<{% for m in messages %}{% if loop.first %}F{% endif %}{{ loop.index }}{{ m.text }}{% if loop.last %}L{% endif %};{% endfor %}>"
    rows = [(c, k, "user", f"{c}-{k}") for c in (1, 2) for k in range(40)]
    got = format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), source, slices=8, piece_chars=20).orderBy("conv_id", "slice", "piece").collect()
    for c in (1, 2):
        assert "".join(r.formatted for r in got if r.conv_id == c) == Template(source).render(messages=[{"text": f"{c}-{k}"} for k in range(40)])[0]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert digests(format_chat(empty)).count() == 0
