import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stellwerk.llm.render import render, rendered

CASES = [
    ("<p>Eins<p>Zwei <b>fett</b>\n  weiter</p>Drei", "Eins\n\nZwei fett weiter\n\nDrei"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
    ("<table><tr><th>Tag<th>Zeit<tr><td>Montag<td>8 Uhr<tr><td>Di<td>10 Uhr</table>", "Tag     Zeit\nMontag  8 Uhr\nDi      10 Uhr"),
    ("<div>a</div><div style='display: none'>b</div><script>c()</script><span hidden>d</span><div aria-hidden=true>e</div>f", "a\nf"),
    ("<head><title>t</title><style>p{}</style></head><body><h1>A &amp; B</h1>x<br>y<br><br>z", "A & B\n\nx\ny\n\nz"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"), ("<dl><dt>k<dd>v<dt>l<dd>w</dl>", "k\nv\nl\nw"), ("ohne <jeder> Tag &amp; so", "ohne <jeder> Tag &amp; so"), ("a  b\n c", "a  b\n c"), (None, None), ("", ""), ("<b>", ""),
]


@pytest.mark.parametrize(("markup", "want"), CASES)
def test_layout(markup, want):
    assert render(markup) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "x", " ", "<div hidden>", "</div>", "<br>", "<pre>", "</pre>", "&amp;", "<!-- c -->"]), max_size=30))
def test_any_markup(parts):
    out = render("".join(parts))
    assert "<p>" not in out and "\n\n\n\n" not in out or "<br>" in parts or "<pre>" in parts


def test_deep_and_column(spark):
    assert render("<div>" * 20000 + "x") == "x" and len(render("<li>" * 5000 + "y")) > 0
    df = spark.createDataFrame([("<p>a",), (None,), ("plain\ntext",), ("a < b",)], "m string")
    assert [r[0] for r in df.select(rendered(F.col("m"))).collect()] == ["a", None, "plain\ntext", "a < b"]
