from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import columns as C
from corpusflow.operators import clean, merge, stats
from corpusflow.plans import cli, pipelines
from corpusflow.sources import files

HEADER = "title,url,published_date,author,tags,excerpt,scraped_at\n"
ROWS = [
    '"Joins, explained",https://x.test/blog/a,2026-08-14,Ann,SQL|Data,"An ""excerpt""\nof two lines",2026-08-16',
    "Plain,https://x.test/blog/b,2026-07-01,Bob,SQL,Second,2026-08-16",
    "No tags,https://x.test/blog/c,2025-8-4,,,Third,2026-08-16",
    "Again,https://x.test/blog/b,2026-07-02,Bob,SQL,Repeated,2026-08-16",
    "No date,https://x.test/blog/d,,,,Fourth,2026-08-16",
    ",https://x.test/blog/e,2026-01-01,Eve,R,Fifth,2026-08-16",
    "No excerpt,https://x.test/blog/f,2026-01-01,Eve,R,,2026-08-16",
    "Bad date,https://x.test/blog/g,14 August 2026,Eve,R,Sixth,2026-08-16",
    "No url,,2026-01-01,Eve,R,Seventh,2026-08-16",
]


@pytest.fixture()
def raw_csv(tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(HEADER + "\n".join(ROWS) + "\n", encoding="utf-8")
    return str(path)


def test_each_reason_once(spark, raw_csv):
    done = pipelines.clean_rows(files.load_raw(spark, raw_csv))
    assert done.report["rows_in"] == 9 and done.report["rows_out"] == 3
    assert list(done.report["dropped_by_reason"].items()) == [(r, 1) for r in clean.REASONS]
    kept = done.kept.collect()
    assert [r.url[-1] for r in kept] == ["a", "b", "c"]
    assert (kept[0].published_year, kept[0].published_month, kept[0].tag_count, kept[0].excerpt) == (2026, "2026-08", 2, 'An "excerpt"\nof two lines')
    assert kept[2].tag_count == 0 and kept[2].published_month == "2025-08"
    clean.validate(done.kept)
    assert "duplicate url: 1  (e.g. https://x.test/blog/b)" in clean.report_text(done.report)


def test_a_bad_first_copy_does_not_shadow_a_good_one(spark):
    rows = spark.createDataFrame([(0, "", "u", "2026-01-01", "", "", "e", ""), (1, "t", "u", "2026-01-01", "", "", "e", "")], ["row_ord", *clean.RAW])
    assert [r.drop_reason for r in clean.with_reason(rows).orderBy("row_ord").collect()] == ["empty title", None]


def test_schema_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.load_raw(spark, str(tmp_path / "none.csv"))
    (tmp_path / "bad.csv").write_text("title,url\na,b\n")
    with pytest.raises(clean.SchemaError):
        files.load_raw(spark, str(tmp_path / "bad.csv"))


def test_files_round_trip(spark, raw_csv, tmp_path):
    out = [str(tmp_path / x) for x in ("clean", "dropped", "report.json")]
    said = pipelines.clean_files(spark, raw_csv, *out)
    again = files.load_clean(spark, out[0])
    assert again.count() == 3 and again.where("tag_count = 2").first().tags_list == ["SQL", "Data"]
    assert files.load_clean(spark, out[0]).where("url like '%/a'").first().excerpt == 'An "excerpt"\nof two lines'
    assert files.read_json(spark, out[2]) == said
    assert files.read_json(spark, str(tmp_path / "none.json")) is None
    text = pipelines.stats_text(spark, out[0], out[2])
    assert "articles     : 3" in text and "2026      2   66.7%" in text


def test_command_line(spark, raw_csv, tmp_path, capsys):
    out = [str(tmp_path / x) for x in ("clean", "dropped", "report.json")]
    assert cli.main(["clean", "--input", raw_csv, "--output", out[0], "--dropped-output", out[1], "--report-output", out[2]]) == 0
    assert cli.main(["clean", "--input", str(tmp_path / "none.csv")]) == 2
    assert cli.main(["stats", "--input", out[0], "--report", out[2]]) == 0
    assert "removed : 6" in capsys.readouterr().out
    assert cli.topic_range(8, 12, 2) == [8, 10, 12] and cli.topic_range(4, 4, 1) == [4]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("2026-08-14", "2026-08-14"), ("2026-8-4", "2026-08-04"), (" 2026-08-14", None), ("2026-02-30", None), ("20260814", None), ("0001-01-01", None), ("9999-01-01", None), ("2026-08-14T00:00:00", None)],
)
def test_strict_date(spark, raw, want):
    got = spark.range(1).select(C.strict_date(F.lit(raw)).cast("string")).first()[0]
    assert got == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2024-05-21", "2024-05-21"),
        ("2024-05-21T23:00:00-05:00", "2024-05-21"),
        ("2024-05-21T10:00:00Z", "2024-05-21"),
        ("May 21st, 2024", "2024-05-21"),
        ("21 May 2024", "2024-05-21"),
        ("3 Sep 2021", "2021-09-03"),
        ("2024/05/21", "2024-05-21"),
        ("5/21/2024", "2024-05-21"),
        ("on 2024-13-45", "2024-13-45"),
        ("soon", ""),
        (None, ""),
    ],
)
def test_parse_date(spark, raw, want):
    assert spark.range(1).select(C.parse_date(F.lit(raw))).first()[0] == want


def test_tags(spark):
    rows = spark.createDataFrame([("A|B",), ("",), ("  ",), ("A | B ",), ("Solo",), ("A||B",)], "tags string")
    assert [len(r[0]) for r in rows.select(C.split_tags(F.col("tags"))).collect()] == [2, 0, 0, 2, 1, 2]
    counts = {r.tag: r.n for r in stats.tag_frequencies(spark.createDataFrame([("A|B",), ("A",), ("",), ("B|C|A",), ("A|A",)], "tags string")).collect()}
    assert counts == {"A": 5, "B": 2, "C": 1}
    many = [f"t{i}" for i in range(13)]
    limited = spark.createDataFrame([(["See More", " a  b ", "A B", "c"],), (many,)], "a array<string>").select(C.limit_tags(F.col("a"))).collect()
    assert [r[0] for r in limited] == [["a b", "c"], []]


def test_dedupe_ci_takes_whole_texts(spark, tmp_path):
    from corpusflow import queries

    def brute(text):
        seen = set()
        return " ".join(w for w in text.split(" ") if w and not (w.lower() in seen or seen.add(w.lower())))

    texts = [(1, " ".join(f"{'W' if i % 3 else 'w'}{i * 7919 % 6007}" for i in range(20000))), (2, "a A  b " * 30 + "late Late"), (3, ""), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.words for r in queries.QUERIES["dedupe_ci"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else brute(t) for i, t in texts}
    assert got[2] == "a b late" and len(got[1].split(" ")) == 6007
    tags = {r.doc_id: r.tags for r in queries.QUERIES["limit_tags"](spark, str(tmp_path)).collect()}
    assert tags == {1: "", 2: "a|b|late", 3: "", 4: ""}
    some = spark.createDataFrame([(["b", None, "B", "", None, "a"],), ([],)], "a array<string>").select(C.dedupe_ci(F.col("a"))).collect()
    assert [r[0] for r in some] == [["b", "a"], []]


def test_urls(spark):
    urls = ["HTTPS://X.test/Blog/Post/?q=1#f", "https://x.test", "ftp://x.test/a", None]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(C.canonical_url(F.col("u"))).collect()
    assert [r[0] for r in rows] == ["https://x.test/Blog/Post", "https://x.test/", None, None]
    tests = {"https://x.test/blog/post": True, "https://x.test/blog/tags": False, "https://x.test/blog": False, "https://y.test/blog/post": False, "https://x.test/blog/a/b": False}
    got = spark.createDataFrame([(u,) for u in tests], "u string").select("u", C.is_article_url(F.col("u"), "x.test")).collect()
    assert {r[0]: r[1] for r in got} == tests


def test_upsert_and_first_seen(spark):
    rows = lambda xs: spark.createDataFrame(xs, "url string, title string, row_ord long")
    got = merge.upsert(rows([("a", "old", 0), ("b", "old", 1), ("b", "older", 0), ("", "x", 2)]), rows([("a", "new", 0), ("c", "new", 1), ("c", "newer", 2)]))
    assert {r.url: r.title for r in got.collect()} == {"a": "new", "b": "old", "c": "newer"}
    links = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "b"), (3, 0, "c")], "page int, pos int, url string")
    assert {(r.url, r.page) for r in merge.first_seen(links).collect()} == {("a", 1), ("b", 1), ("c", 3)}
    assert {r.url for r in merge.until_nothing_new(links, links.select("page").distinct()).collect()} == {"a", "b"}
    assert {r.url for r in merge.unseen(links, links.where("url = 'a'")).collect()} == {"b", "c"}


def test_upsert_of_all_rows(spark):
    from corpusflow import queries

    d = "/root/testdata/sf0.001"
    urls = {r.url for r in queries.raw(spark, d).collect()}
    got = {r.url: r for r in queries.QUERIES["upsert_merge"](spark, d).collect()}
    assert urls <= set(got) and any(r.row_ord % 2 for r in got.values())
    only = {u for u in got if u.endswith("-new")}
    assert only and {u.removesuffix("-new") for u in only} <= urls and set(got) == urls | only
    assert all(got[u].title.startswith("new ") for u in only)
    assert {r.title.startswith("new ") for u, r in got.items() if u in urls} == {True, False}


def test_upsert_stream(spark, tmp_path):
    from corpusflow.streaming import upserts

    source = str(tmp_path / "in")
    for i, rows in enumerate(([("a", "1", 0), ("b", "1", 1)], [("a", "2", 5)])):
        spark.createDataFrame(rows, "url string, title string, row_ord long").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("url string, title string, row_ord long").parquet(source)
        upserts.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {r.url: r.title for r in upserts.latest(spark, str(tmp_path / "out")).collect()} == {"a": "2", "b": "1"}
