import re

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import SCHEMA, documents, frame

from touchline.llm import html, langid, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count, hit = {}, set()
    for i in range(len(w) - 7):
        count[tuple(w[i : i + 8])] = count.get(tuple(w[i : i + 8]), 0) + 1
    for i in range(len(w) - 7):
        if count[tuple(w[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_quality_base_equals_brute_force(spark):
    rows = documents(4)
    extra = ["a b\na b\n  \n\n", "x y z " * 40, "## && é", " lead\n trail ", "a\n\nb", "one two three four five six seven eight nine " * 3]
    rows += [(100 + k, t) for k, t in enumerate(extra)]
    got = sorted(tuple(r) for r in quality.rules(frame(spark, rows)).select("doc_id", *quality.BASE).collect())
    assert got == sorted((d, *brute_base(t)) for d, t in rows)


def test_boilerplate_lines_reject_depleted_documents(spark):
    own = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    shared = " ".join(f"menu{i}" for i in range(40))
    rows = [(k, f"{own(k)}\n{shared}" if k < 60 else f"{own(k)}\n{own(k + 1000)}") for k in range(120)]
    df = spark.createDataFrame([(d, t, "host") for d, t in rows], "doc_id long, text string, source string")
    kept = {r["doc_id"]: (r["kept"], r["n_boiler_words"]) for r in quality.rules(df).collect()}
    assert all(kept[k] == (False, 40) for k in range(60))
    assert all(kept[k] == (True, 0) for k in range(60, 120))


def test_empty_tables(spark, empty):
    assert quality.rules(empty).count() == 0
    assert langid.predict(empty).count() == 0
    assert toxicity.score(empty, empty.select("doc_id", F.col("rank").alias("toxic"))).count() == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_toxicity_held_out_accuracy(spark, sf):
    d = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score(docs, labels).where("held_out").join(labels, "doc_id")
    r = got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")).alias("acc"), F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r["n"] > 500 and r["acc"] > 0.97 and 0 <= r["lo"] and r["hi"] <= 1


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(k, 1, "x") for k in range(5)] + [(k, 0, "x") for k in range(20, 40)] + [(41, None, "x")], "doc_id long, toxic int, text string")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.score(docs, labels.where("toxic = 0")).select("score").distinct().collect()
    assert [r[0] for r in none] == [0.0]


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = langid.predict(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.95


def test_language_edges(spark):
    rows = [(1, "the house and the garden", "en"), (2, "das Haus und der Garten", "de"), (3, None, "en"), (4, "", None), (5, "12 34 --", "fr"), (6, "la maison et le jardin", "fr"), (7, "und das Haus", None), (7, "und das Haus", None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert got[1][0] in ("en", "de", "fr") and 0 <= got[1][1] <= 1


PAGE = """<!DOCTYPE html><html><head><title>T &amp; more</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><a href="/">Home</a> Site</header><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>A  title</h1><p>First &eacute; para&nbsp;graph with <a href=z>a link</a> inside and some more words.<p><b>Second one.<br><div class="ad">Buy now</div><!-- note --><p>Third &lt;b&gt; &am one</p>
<form>Name <input></form><section id="comments"><p>Great article, thanks a lot for it!</p></section></article><aside>Related stories here</aside><footer>&copy; 2024</footer></body></html>"""


def test_html_main_text():
    tree = html.trained()
    assert html.main_text(PAGE, tree) == "A title\nFirst é para graph with a link inside and some more words.\nSecond one.\nThird <b> &am one"
    assert html.main_text("", tree) == html.main_text(None, tree) == html.main_text("<nav>x</nav>", tree) == ""
    for bad in ("<", "<p", "a <b", "<p>" * 9000, "</p></div>", "<!-- x", "<script>x", "&#xZZ; &#0; &#99999999;", "<p class='x>y"):
        html.main_text(bad, tree)


def test_html_without_article():
    words = "this is a long paragraph of plain text that goes on for more than a few words and has no links at all in it"
    page = f"<body><ul><li><a>Home</a><li><a>News</a><li><a>About</a></ul><p>{words}</p><p>{words} twice</p><p>{words} thrice</p><div id='footer'>Contact us</div></body>"
    assert html.main_text(page, html.trained()) == f"{words}\n{words} twice\n{words} thrice"


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (2, None, None, "x"), (3, "u", "<p>" + "word " * 200_000, "x")], "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)


def test_training_reads_only_its_fold(spark):
    assert "doc_id" in SCHEMA
    rows = documents(2)
    df = frame(spark, rows)
    held = df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang")))
    assert {r["lang_pred"] for r in langid.predict(held).collect()} <= {"en", "de", "fr", "es", "und"}


@pytest.mark.parametrize("n", [3, 5])
def test_ngrams_stay_inside_rows(n):
    import pyarrow as pa

    from touchline.llm.textcore import chunks

    _, _, data, offs = next(chunks(pa.array(["abcdef", "", "gh", "ijklm"])))
    h = toxicity.ngrams(data, offs, n)
    assert (h >= 0).sum() == sum(max(0, len(t) - n + 1) for t in ("abcdef", "", "gh", "ijklm"))


def test_long_texts_are_learned_from(spark):
    # every text is longer than 8 KB: the fit uses them all the same
    rows = [(k, f"{'good calm words here ' * 500}{'vile slur ' if k % 2 else 'kind note '}{k}", "en" if k % 2 else "fr") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(1, 1), (2, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, labels).collect()}
    assert all((got[k] >= 0.5) == bool(k % 2) for k in range(60))
    assert {r["lang_pred"] for r in langid.predict(df).collect()} == {"en", "fr"}


def test_rows_without_ids_and_repeated_ids(spark):
    rows = [(None, "kind note", "en"), (None, None, None), *[(7, f"vile slur {k}", "fr") for k in range(30)], *[(8 + k, f"kind note {k}", "en") for k in range(30)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(7, 1), (7, 1), (None, 1)] + [(8 + k, 0) for k in range(30)], "doc_id long, toxic int")
    got = toxicity.score(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
    assert len(langid.predict(df).collect()) == len(rows)
