import sys
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexivane.functions import text as t
from lexivane.functions.batches import slices
from lexivane.functions.html import article, extract_articles


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_whitespace_is_pythons():
    assert set(t.WHITESPACE) == {chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", max_codepoint=0x2FFF, exclude_categories=["Cn", "Cs", "Lu", "Lt"])), min_size=1, max_size=20))
def test_tokens_like_split(spark, texts):
    texts = [unicodedata.normalize("NFC", x).replace("\0", "") for x in texts]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", t.tokens(F.col("x"))).collect()
    assert {i: w for i, w in rows} == {i: x.lower().split() for i, x in enumerate(texts)}


@pytest.mark.parametrize(("text", "want"), [(None, []), ("", []), ("  \n ", []), ("A b A", ["a", "b", "a"]), ("İx ΑΣ", "İx ΑΣ".lower().split())])
def test_tokens_edges(spark, text, want):
    assert one(spark, text, t.tokens) == want


@pytest.mark.parametrize(("text", "want"), [(None, ""), ("the of", ""), ("The cat  sat on", "The cat sat"), ("isn't it", "")])
def test_stopwords(spark, text, want):
    assert one(spark, text, t.drop_stopwords) == want


def test_no_stopwords(spark):
    assert one(spark, "the  cat", lambda c: t.drop_stopwords(c, ())) == "the cat"


def test_combined(spark):
    df = spark.createDataFrame([(7, None, "x", [1])], "id int, title string, url string, encoded_data array<bigint>")
    columns = ["id", "title", "content", "url", "encoded_data"]
    assert df.select(t.combined(columns, df.columns)).first()[0] == "None  x"


@pytest.mark.parametrize(("url", "want"), [("http://a/b/c?d=e#f", "c?d=e#f"), ("http://a/", ""), ("plain", "plain"), (None, None)])
def test_url_title(spark, url, want):
    assert one(spark, url, t.url_title) == want


@pytest.mark.parametrize(("path", "want"), [("/x/a.b.txt", "file_a.b"), ("notes.txt", "file_notes"), ("/x/plain", "file_plain"), ("/x/.hidden", "file_.hidden")])
def test_file_table(spark, path, want):
    assert one(spark, path, t.file_table) == want


@pytest.mark.parametrize(("text", "want"), [("abcdef", "abc..."), ("a", "a..."), ("", "N/A"), (None, "N/A")])
def test_preview(spark, text, want):
    assert one(spark, text, lambda c: t.preview(c, 3)) == want


def test_strip(spark):
    assert one(spark, "  a b \n", t.strip) == "a b"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<article><h1> T </h1><p>one<p>two</article>", "T\nonetwo\ntwo"),  # an open p holds what follows
        ("<section class='x post-content'><p>a</p></section><div class=article-content><p>b</p></div>", "a"),
        ("<div class='article-content y'><li><p>a</p></li></div>", "a\na"),
        ("<div itemprop=articleBody><h6>a</h6></div>", "a"),
        ("<article></article><p>x</p>", ""),
        ("<div><p> x </p><p>y</p></div>", "x\ny"),
        ("<p>a<!-- no --><script>no</script><style>no</style>b<br/>c<br>d</p>", "abcd"),
        ("<p>a &amp; b &copy;</b></p>", "a & b ©"),
        ("<article>1<article><p>in</p></article></article>", "in\nin"),
        ("<div>none</div>", None),
        ("", None),
    ],
)
def test_article(html, want):
    assert article(html) == want


def test_deep_page():
    assert article("<div>" * 5000 + "<p>x</p>") == "x"


def test_batches_are_cut_by_bytes():
    texts = ["x" * n for n in (10, 3000, 5, 5, 0, 2000, 2000, 2000, 1)]
    parts = list(slices(pa.RecordBatch.from_pydict({"t": texts}), 1000))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts
    assert all(p.num_rows == 1 or p.nbytes <= 2000 for p in parts)
    assert not list(slices(pa.RecordBatch.from_pydict({"t": pa.array([], pa.string())})))


def test_python_gets_few_pages_at_a_time(spark):
    html = "<article><p>" + "x" * 50_000 + "</article>"
    pages = spark.range(0, 600, 1, 1).select(F.col("id").alias("page_id"), F.lit(html).alias("html"))
    assert extract_articles(pages).where("length(content) = 50000").count() == 600
    size = lambda bs: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in bs)
    assert max(r["n"] for r in pages.mapInArrow(size, "n bigint").collect()) < 8 << 20
