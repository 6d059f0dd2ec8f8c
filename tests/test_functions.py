from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerloom.functions import ids, names, pystr, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("o")).collect()[0].o


@pytest.mark.parametrize(("name", "slug"), [("Acme Corp.", "acme-corp"), ("Société Générale S.A.", "societe-generale"), ("Foo & Bar Ltd", "foo-bar"), ("  ", None), (None, None)])
def test_slug(spark, name, slug):
    assert one(spark, name, ids.company_slug) == slug


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Www.Example.com/Path/?b=2&utm_source=x&a=1&ref=z&reference=q#top", "https://www.example.com/path?a=1&b=2&reference=q"),
        ("http://example.com", "http://example.com/"), ("http://example.com/a/?x", "http://example.com/a?x="), ("https://example.com/?_ga=1&fbclid=2", "https://example.com/"),
        ("https://e.com/?q=x%20y", "https://e.com/?q=x+y"), ("https://e.com/?q=x+y&UTM_Source=1&Ref=2", "https://e.com/?q=x+y"), ("example.com/Path/", "https:example.com/path"), ("/Path?b", "https:///path?b="), ("//E.com", "https://e.com/"),
        ("https://e.com/a?p=1/2:3~*&n=%zz&u=\u00e9", "https://e.com/a?n=%25zz&p=1%2F2%3A3~%2A&u=%C3%A9"), (" https://e.com/a%20b#x?y ", "https://e.com/a%20b"), ("mailto:A@b.com", "mailto:a@b.com"), (None, None), ("", "https:///"),
        ("https://e.com/?b=2&a=2&a=1&a", "https://e.com/?a=&a=1&a=2&b=2"), ("https://e.com/?x=1=2&&", "https://e.com/?x=1%3D2"),
    ],
)
def test_urls(spark, url, want):
    assert one(spark, url, ids.url_normal_form) == want


def test_ids(spark):
    same = [one(spark, u, lambda c: ids.source_id(c, F.lit("Web"))) for u in ("https://example.com/a?utm_medium=1", "https://EXAMPLE.com/a/")]
    assert same[0] == same[1] and same[0].startswith("src_") and len(same[0]) == 20
    assert one(spark, "x", lambda c: ids.artifact_id(c, c, c, F.lit(""))) is None
    assert one(spark, "2024-05-06 07:08:09", lambda c: ids.run_id(c.cast("timestamp"), F.lit("ab12"))) == "20240506T070809Z-ab12"
    assert one(spark, "2024-05-06 07:08:09", lambda c: ids.run_id(c.cast("timestamp"), F.lit("AB"))) is None


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("auto-\nmatic  text\f\n 12 \nend x", "automatic text end x"), ("1\na\n2", "1 a 2"), ("a\n1\n2\nb", "a 2 b"), ("x \u00a0\u2003y\x1c", "x y"), ("\ufb01t\u2026 \u00bd", "fit... 1\u20442"),
        ("e\u0301\n\u0664\u0662\n", "\u00e9"), ("", ""), (None, None),
    ],
)
def test_canonical_text(spark, raw, want):
    assert one(spark, raw, text.canonical_text) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("<html><script>var a = '<b>';</script><!-- no --><p>Hello   <b>World</b> &amp; co</p></html>", "Hello World & co"), ("Caf&eacute; &#8364;", "Caf\u00e9 \u20ac"), ("a<b>c</b>d", "a c d"), ("x<5 y", "x < 5 y"),
        ("<a title='x>y'>t</a>", "t"), ("<style>p{}</style >q</style>r", "q r"), ("\ufb01ne plain", "fine plain"), ("tail <unclosed", "tail"), (None, None), ("", ""),
    ],
)
def test_canonical_html(spark, raw, want):
    assert one(spark, raw, text.canonical_html) == want


def test_canonical_json_and_dispatch(spark):
    raw = '{"b":1,"a":{"Timestamp":5,"x":"\u00e9","l":[{"nonce":1,"k":[]}]}}'
    assert one(spark, raw, text.canonical_json) == '{"a":{"l":[{"k":[]}],"x":"\\u00e9"},"b":1}'
    assert one(spark, "TEXT/HTML; charset=x", text.profile_of) == "html" and one(spark, "image/png", text.profile_of) == "text"
    got = [one(spark, raw, lambda c, m=m: text.canonical(c, F.lit(m))) for m in ("application/json", "text/html", None)]
    assert got == [one(spark, raw, text.canonical_json), one(spark, raw, text.canonical_html), one(spark, raw, text.canonical_text)]
    same = [one(spark, v, lambda c: text.content_hashes(c, F.lit("text/html"))["canonical_hash"]) for v in ("<p>a  b</p>", "a b<!-- x -->")]
    assert same[0] == same[1]


def test_list_strings(spark):
    assert one(spark, "A] [B] [ ", names.clean_programme) == "A; B"
    assert one(spark, "DOB 1; a.k.a.X; aka GOOD FRONT; f.k.a. 'OLD'; nka \"NEW\"", names.remark_aliases) == ["X", "GOOD FRONT", "NEW"]
    assert one(spark, "  Müller-Lüdenscheid,  (A.G.) ", names.normal_name) == "müller lüdenscheid a g"
    assert one(spark, " -0- ", names.null_token) is None and one(spark, " x ", names.null_token) == "x" and one(spark, "STRA\u00dfE", names.normal_name) == "strasse"
    assert [one(spark, v, names.to_float) for v in ("1.5", " 2e3 ", "1_000", "1d", "", None)] == [1.5, 2000.0, None, None, None, None]


def test_export_text(spark):
    df = spark.createDataFrame([(None, True, 1e20, 2.0, "a|b")], "n string, b boolean, f double, w double, s string")
    assert rows(pystr.export_columns(pystr.redact(df, ["s", "absent"]), ["w", "n", "b", "f", "s", "zz"])) == [("2.0", "None", "True", "1e+20", "[REDACTED]", "")]


def test_tables_of_html():
    html = "<table><tr><th> A </th><th>B</th></tr><tr><td></td></tr><tr><td>1<table><tr><td>in</td></tr></table></td><td>2</td></tr></table><table></table>"
    got = text.tables_of(html)
    assert got[0][0] == ["A", "B"] and got[1] == [["in"]] and len(got) == 2
