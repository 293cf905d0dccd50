"""Lines above the limit leave the documents that are kept."""

from pyspark.sql import functions as F

from touchline.llm import quality


def test_lines_above_the_limit_are_removed(spark):
    own = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(k if k % 3 else None, f"Menu ONE  two\n\n{own(k)}\nzwölf é\nmenu one two\n{own(k, 5)}", "h") for k in range(60)]
    rows += [(100 + k, f"menu one two\n{own(k)}", "small") for k in range(10)]
    rows += [(200 + k, f"{own(k, 20)}\n{' '.join(f'footer{i}' for i in range(40))}", None) for k in range(60)]  # depleted
    rows += [(300, None, "h"), (301, "", "h"), (302, f"{own(302)}\r\n MENU one two \n", "h"), (302, f"{own(302)}\r\n MENU one two \n", "h")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, source string, n_chars long")
    got = quality.cleaned(df)
    assert got.columns == df.columns
    want = [(d, f"\n{own(k)}\n{own(k, 5)}", s) for k, (d, _, s) in enumerate(rows[:60])]
    want += [*rows[60:70], (302, f"{own(302)}\r\n", "h"), (302, f"{own(302)}\r\n", "h")]
    assert sorted(((r["doc_id"], r["text"], r["source"]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert got.where(F.length("text") != F.col("n_chars")).count() == 0


def test_removed_words_are_those_counted(spark, sf, monkeypatch):
    monkeypatch.setattr(quality, "LINE_DOCS", 2)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = F.size(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))
    left = {r["doc_id"]: r["n"] for r in quality.cleaned(docs).select("doc_id", n.alias("n")).collect()}
    said = quality.rules(docs).where("kept").collect()
    assert left == {r["doc_id"]: r["n_words"] - r["n_boiler_words"] for r in said}
    assert any(r["n_boiler_words"] for r in said)


def test_columns_with_the_names_in_use(spark):
    rows = [(k, f"same line\n{' '.join(f'w{k}x{i}' for i in range(30))}", "h", 5, 6, 7, 8, 9) for k in range(quality.LINE_DOCS + 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _d long, gone long, _s int, _h int, row int")
    got = quality.cleaned(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(r[0], r[1].split("\n")[1], *r[2:]) for r in rows]


def test_no_rows(empty):
    assert quality.cleaned(empty).count() == 0
