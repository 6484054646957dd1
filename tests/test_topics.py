from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.functions import columns as C
from corpusflow.functions import lexicon
from corpusflow.operators import clean, graph, text, topics
from corpusflow.plans import pipelines


def tokens(spark, x):
    return spark.range(1).select(C.tokens(F.lit(x))).first()[0]


def test_tokens(spark):
    assert tokens(spark, "C++ and C# with scikit, LLMs; A/B tests in 2024 -- .NET!") == ["c++", "and", "c#", "with", "scikit-learn", "llm", "a/b", "tests", "in", ".net"]
    assert tokens(spark, "Machine-Learning 1.2.3 gpt4") == ["machine", "learning", "gpt-4"]


def lemma(spark, word, *corpus):
    vocab = spark.createDataFrame([(w, 1) for w in {word, *corpus}], "token string, n long")
    return {r.token: r.lemma for r in text.lemmas(vocab).collect()}[word]


@pytest.mark.parametrize(
    ("word", "corpus", "want"),
    [
        ("queries", [], "query"),
        ("classes", [], "class"),
        ("bias", [], "bias"),
        ("models", [], "model"),
        ("coding", ["code"], "code"),
        ("coding", [], "coding"),
        ("running", ["run"], "run"),
        ("trained", ["train"], "train"),
        ("learning", ["learn"], "learning"),
        ("analyses", [], "analysis"),
        ("series", [], "series"),
        ("statistics", [], "statistics"),
    ],
)
def test_lemmas(spark, word, corpus, want):
    assert lemma(spark, word, *corpus) == want


def test_ngrams_and_weights(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, [])], "id long, tokens array<string>")
    terms = text.ngrams(docs, "id")
    assert sorted(r.term for r in terms.where("id = 1").collect()) == ["a", "a", "a b", "b", "b a"]
    stats = {r.term: (r.df, r.cf) for r in text.term_statistics(terms, "id").collect()}
    assert stats == {"a": (1, 2), "b": (2, 2), "a b": (1, 1), "b a": (1, 1)}
    vocab = text.vocabulary_terms(text.term_statistics(terms, "id"), 3, max_df=1.0)
    got = {r.term: r.weight for r in text.tfidf(terms, vocab, 3, "id").where("id = 1").collect()}
    raw = {"a": 2 * (math.log(4 / 2) + 1), "b": math.log(4 / 3) + 1, "a b": math.log(4 / 2) + 1, "b a": math.log(4 / 2) + 1}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    assert got == pytest.approx({k: v / norm for k, v in raw.items()})


def test_stopwords():
    assert len(set(lexicon.STOPWORDS)) == len(lexicon.STOPWORDS) == 263
    assert not set(lexicon.stopwords()) & lexicon.DOMAIN_TERMS


def test_dominant(spark):
    probs = [(0, 0, 0.7), (0, 1, 0.2), (0, 2, 0.1), (1, 0, 0.3), (1, 1, 0.3), (1, 2, 0.4)]
    got = {r.id: tuple(r)[1:] for r in topics.dominant(spark.createDataFrame(probs, "id long, topic_id long, prob double"), "id").collect()}
    assert got == {0: (0, 0.7, 1, 0.2), 1: (2, 0.4, 0, 0.3)}
    one = topics.dominant(spark.createDataFrame([(0, 0, 1.0)], "id long, topic_id long, prob double"), "id").first()
    assert tuple(one) == (0, 0, 1.0, 0, 0.0)


def keywords(spark, *lists):
    return spark.createDataFrame([(t, term, w, i + 1) for t, ks in enumerate(lists) for i, (term, w) in enumerate(ks)], "topic_id long, term string, weight double, rank long")


RULES = [("X", ["sql", "data base"]), ("Y", ["sql", "query"]), ("Z", ["zeta"])]


def test_labels(spark):
    rules = topics.rule_rows(spark, RULES)
    kw = keywords(spark, [("sql", 0.5), ("query", 0.2)], [("big data base", 0.3), ("model", 0.2)], [("sql", 0.1), ("model", 0.09), ("tree", 0.01)], [("pi", 0.4), ("rho", 0.3), ("tau", 0.2), ("psi", 0.1)], [("database", 1.0)])
    best = {r.topic_id: (r.label, r.matches) for r in topics.label_rules(kw, rules).collect()}
    assert best == {0: ("Y", 2), 1: ("X", 1), 2: ("X", 1)}
    labels = {r.topic_id: r.label for r in topics.assign_labels(kw, rules).collect()}
    assert labels == {0: "Y", 1: "X", 2: "X (tree)", 3: "Тема 3: pi, rho, tau", 4: "Тема 4: database"}


def test_default_label_rules(spark):
    """Names and triggers that the reference's catalogue has beyond ten a label."""
    assert len(lexicon.LABEL_RULES) == 19 and sum(len(t) for _, t in lexicon.LABEL_RULES) == 268
    rules = topics.rule_rows(spark, lexicon.LABEL_RULES)
    kw = keywords(spark, [("claude", 0.5), ("vs", 0.2)], [("kubernetes", 0.3), ("airflow", 0.2)], [("jupyter", 0.1)], [("portfolio", 0.4)], [("token", 0.4)])
    got = {r.topic_id: r.label for r in topics.assign_labels(kw, rules).collect()}
    assert got == {0: "Порівняння AI-моделей", 1: "Хмарні платформи та Data Engineering", 2: "Python: мова та бібліотеки", 3: "Кар'єра та навчання в Data Science", 4: "Великі мовні моделі та генеративний AI"}


def test_lift_and_edges(spark):
    rows = spark.createDataFrame([(0, "a|c")] * 3 + [(1, "b|c")] * 3, "topic_id long, tags string")
    lift = {(r.topic_id, r.tag): (r.lift, r.rank) for r in topics.tag_lift(rows).collect()}
    assert lift[0, "a"] == (2.0, 1) and lift[0, "c"] == (1.0, 2)
    w = spark.createDataFrame([(0, "x", 1.0), (1, "x", 0.6), (1, "y", 0.8), (2, "y", 1.0)], "topic_id long, term string, weight double")
    edges = {(r.source, r.target): r.weight for r in topics.similarity_edges(w).collect()}
    assert edges == {(0, 1): 0.6, (1, 2): 0.8}
    pairs = graph.tag_cooccurrence(spark.createDataFrame([("a|b|a",), ("b|a|c",)], "tags string"))
    assert {(r.tag_a, r.tag_b): r.n for r in pairs.collect()} == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}


def test_coherence_prefers_terms_that_meet(spark):
    terms = spark.createDataFrame([(i, t) for i in range(6) for t in (("a", "b") if i < 3 else ("c",))], "id long, term string")
    kw = keywords(spark, [("a", 0.5), ("b", 0.4)], [("a", 0.5), ("c", 0.4)])
    got = {r.topic_id: r.coherence for r in topics.umass(kw, terms, "id").collect()}
    assert got == pytest.approx({0: math.log(4 / 3), 1: math.log(1 / 3)})


def test_digamma():
    x = np.array([0.1, 1.0, 2.5, 30.0])
    assert topics._digamma(x) == pytest.approx([-10.4237549404, -0.5772156649, 0.7031566406, 3.3844381325], abs=1e-8)


THEMES = ["sql query join table index database schema", "neural network layer tensor training gradient deep", "career salary resume interview mentor portfolio job"]


@pytest.fixture(scope="module")
def articles(spark):
    rows = []
    for i in range(18):
        words = THEMES[i % 3].split()
        k = i // 3
        rows.append((i, " ".join(words[k:] + words[:k]), f"https://x.test/blog/post-{i}", "2026-01-01", "Tester", ["SQL", "Deep", "Careers"][i % 3], " ".join(words * 2), "2026-01-02"))
    return clean.clean(spark.createDataFrame(rows, ["row_ord", *clean.RAW])).cache()


def test_topics_end_to_end(spark, articles):
    run = lambda ks=[2]: pipelines.model_topics(articles, ks, rounds=2, max_df=0.9)
    done = run([2, 3])
    p = done.payload
    pipelines.validate_topics(p)
    assert p["n_documents"] == 18 and p["settings"]["min_df"] == 1 and [s["n_topics"] for s in p["selection"]] == [2, 3]
    assert all(m[i] == 1.0 for i, m in enumerate(p["similarity"]["matrix"]))
    assert done.articles.count() == 18 and done.articles.where("topic_label IS NULL").isEmpty()
    assert "# Topic model" in pipelines.topics_report(p)
    assert run().payload == run().payload


def test_feasible_numbers_of_topics(spark, articles):
    with pytest.raises(ValueError):
        pipelines.model_topics(articles, [1, 99])
    with pytest.raises(ValueError):
        pipelines.model_topics(articles, [2], kind="other")
    assert topics.best_score([{"n_topics": 2, "coherence_umass": float("nan"), "perplexity": 5.0}, {"n_topics": 3, "coherence_umass": float("nan"), "perplexity": 4.0}])["n_topics"] == 3


def test_registered_models_run_the_whole_fit(spark, tmp_path, monkeypatch):
    from corpusflow import queries

    texts = [(i, " ".join(THEMES[i % 3].split() * 2)) for i in range(30)] + [(30, None), (31, ""), (32, "the of and"), (33, "zzzz")]
    texts += [(i, "zzz" + chr(97 + i - 34)) for i in range(34, 54)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    fits = []

    def fit(vectors, ks, n_terms, rounds=25, seed=42):
        fits.extend((k, rounds) for k in ks)
        return {k: np.random.default_rng(seed).gamma(100.0, 0.01, (k, n_terms)) for k in ks}

    monkeypatch.setattr(topics, "fit_ldas", fit)
    assert queries.QUERIES["lda_topics"](spark, str(tmp_path)).count() > 0
    got = {r.doc_id: r for r in queries.QUERIES["lda_doc_topics"](spark, str(tmp_path)).collect()}
    assert fits == [(8, 25), (8, 25)] and set(got) == {i for i, _ in texts}
    assert all((got[i].topic_id, got[i].topic_prob, got[i].topic_second_id) == (0, 0.125, 1) for i in (30, 31, 32, 33))
    fits.clear()
    scores = queries.QUERIES["select_n_topics"](spark, str(tmp_path)).collect()
    assert fits == [(k, 25) for k in range(8, 23, 2)] and [r.n_topics for r in scores] == [k for k, _ in fits]


@pytest.mark.parametrize("frequent", [10_000, 2])
def test_lemmas_of_documents_however_joined(spark, monkeypatch, frequent):
    monkeypatch.setattr(text, "FREQUENT", frequent)
    docs = spark.createDataFrame([(1, "Models, models and the data-science of models"), (2, "2024 --- the"), (3, None), (4, "trained to train; a/b LLMs")], "id long, text string")
    rows = text.content_lemmas(text.token_rows(docs, "id", "text"), lexicon.stopwords(), "id")
    got = {r.id: r.tokens for r in text.gathered(rows, "id").collect()}
    assert got == {1: ["model", "model", "data", "science", "model"], 4: ["train", "train", "a/b", "llm"]}


def test_models_fitted_side_by_side(spark):
    rows = [(i, [i % 3, 3 + i % 4], [1.0, 0.5 + i % 2]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "id long, ids array<long>, weights array<double>")
    both = topics.fit_ldas(vectors, [2, 3], 7, rounds=3)
    assert np.array_equal(both[2], topics.fit_lda(vectors.repartition(5), 2, 7, rounds=3)) and both[3].shape == (3, 7)
    # one pass by hand
    lam = np.random.default_rng(42).gamma(100.0, 0.01, (2, 7))
    beta, want = topics._expectation(lam), np.full((2, 7), 0.5)
    for _, ids, weights in rows:
        gamma = np.ones(2)
        for _ in range(100):
            theta = topics._expectation(gamma)
            phi = theta[:, None] * beta[:, ids]
            new = 0.5 + (phi / phi.sum(0) * weights).sum(1)
            done, gamma = np.abs(new - gamma).mean() < 1e-3, new
            if done:
                break
        phi = topics._expectation(gamma)[:, None] * beta[:, ids]
        want[:, ids] += phi / phi.sum(0) * weights
    assert topics.fit_lda(vectors, 2, 7, rounds=1) == pytest.approx(want, abs=1e-5)


def test_prepared_docs_follow_the_rules_of_lemmas(spark):
    """Matches are lemmatized in Python as in column expressions; documents are arrays, rows of one key one document."""
    odd = "Classes queries series boxes ies a-b data-science analyses .NET c++ 1.2.3 _x_ -/- running ran run coding code tied tie stopped stop llms bias's Ünïted needed need models the being"
    docs = spark.createDataFrame([(1, odd), (2, "2024 --- the"), (3, None), (4, odd * 2), (None, "model models")], "id long, text string")
    stop = lexicon.stopwords()
    want = {r.id: r.tokens for r in text.gathered(text.content_lemmas(text.token_rows(docs, "id", "text"), stop, "id"), "id").collect()}
    assert {r.id: r.tokens for r in text.prepared_docs(docs, "id", "text", stop).collect()} == want and set(want) == {1, 4, None}
    twice = spark.createDataFrame([(1, "alpha beta"), (1, "gamma"), (2, "delta")], "id long, text string")
    assert {r.id: sorted(r.tokens) for r in text.prepared_docs(twice, "id", "text", stop).collect()} == {1: ["alpha", "beta", "gamma"], 2: ["delta"]}


@pytest.mark.parametrize(("most", "numbered"), [(5000, 1 << 18), (7, 1 << 18), (7, 3)])
def test_vocabulary_and_vectors_as_by_rows_of_terms(spark, monkeypatch, most, numbered):
    monkeypatch.setattr(text, "NUMBERED", numbered)
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, [f"w{x}" for x in rng.zipf(1.6, 30) if x < 40]) for i in range(60)] + [(60, [])], "id long, tokens array<string>")
    terms = text.ngrams(docs, "id")
    want = text.vocabulary_terms(text.term_statistics(terms, "id"), 61, most=most)
    got = text.vocabulary_list(docs, "id", 61, most=most)
    assert got == [(r.term, r.df, r.cf) for r in want.collect()] and any(" " in t for t, _, _ in got)
    names = [r.term for r in text.named_terms(spark, got).orderBy("idx").collect()]
    vectors = {r.id: dict(zip((names[i] for i in r.ids), r.weights)) for r in text.term_vectors(docs, "id", got, 61).collect()}
    rows = {}
    for r in text.tfidf(terms, want, 61, "id").collect():
        rows.setdefault(r.id, {})[r.term] = r.weight
    assert set(vectors) == set(rows) and all(vectors[i] == pytest.approx(rows[i]) for i in rows)


def test_umass_of_vectors_is_umass(spark):
    docs = [(0, ["a", "b", "c"]), (1, ["a", "c"]), (2, ["b"]), (3, ["c", "d"]), (4, ["a", "d"])]
    names = spark.createDataFrame([(i, t) for i, t in enumerate("abcde")], "idx int, term string")
    vectors = spark.createDataFrame([(i, ["abcde".index(t) for t in ts]) for i, ts in docs], "id long, ids array<int>")
    kw = keywords(spark, [("a", 0.5), ("b", 0.4), ("c", 0.3)], [("d", 0.5), ("a", 0.4)])
    terms = spark.createDataFrame([(i, t) for i, ts in docs for t in ts], "id long, term string")
    told = lambda rows: {r.topic_id: (round(r.coherence, 9), r.n_pairs) for r in rows.collect()}
    assert told(topics.umass_of_vectors(kw, vectors, names)) == told(topics.umass(kw, terms, "id"))


def test_inference_side_by_side():
    """Documents of any size, empty ones too, side by side: as one by one, and as the plain rounds say."""
    rng = np.random.default_rng(3)
    beta = topics._expectation(rng.gamma(100.0, 0.01, (4, 50)))
    docs = [np.sort(rng.choice(50, n, replace=False)) for n in (0, 1, 7, 8, 9, 30, 50, 3, 1)]
    weights = [rng.random(len(d)) + 0.1 for d in docs]
    ends = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    ids, all_weights = np.concatenate(docs), np.concatenate(weights)
    found, parts = np.zeros((len(docs), 4)), np.zeros((len(ids), 4))
    for own, gamma, at, stats in topics._infer(ends, ids, all_weights, beta, 0.25, parts=True, limit=20):
        found[own], parts[at] = gamma, stats
    for i, (d, w) in enumerate(zip(docs, weights)):
        (_, alone, _, _), = topics._infer(np.array([0, len(d)]), d, w, beta, 0.25)
        assert np.array_equal(alone[0], found[i])
        gamma = np.ones(4)
        for _ in range(100):
            theta = topics._expectation(gamma)
            phi = theta[:, None] * beta[:, d]
            new = 0.25 + (phi / phi.sum(0) * w).sum(1)
            done, gamma = np.abs(new - gamma).mean() < 1e-3, new
            if done:
                break
        phi = topics._expectation(gamma)[:, None] * beta[:, d]
        assert found[i] == pytest.approx(gamma, abs=1e-9) and parts[ends[i] : ends[i + 1]] == pytest.approx((phi / phi.sum(0) * w).T, abs=1e-9)


@pytest.mark.parametrize("block", [8 << 20, 40])
def test_blocks_hold_whole_documents_and_their_groups(spark, monkeypatch, block):
    """Texts are read once; rows that repeat a key are one document, in the groups of all its rows."""
    monkeypatch.setattr(text, "BLOCK", block)
    rows = [(i, " ".join(THEMES[i % 3].split()[: i % 5 + 1]), i % 3) for i in range(20)] + [(3, "tree graph", 7), (5, None, 8), (None, "table table", 1), (30, "the of", 2)]
    docs = spark.createDataFrame(rows, "id long, text string, g long")
    blocks = text.prepared_blocks(docs, "id", "text", lexicon.stopwords(), F.col("g"))
    held = blocks.where("n_tokens > 0")
    of = {}
    for i, words, _ in rows:
        own = [w for w in (words or "").split() if w not in ("the", "of")]
        of[i] = [x for pair in zip(of[i], own) for x in pair] + of[i][len(own) :] if i in of and own else of.get(i, own)
    got = {r.id: r.tokens for r in text.block_docs(held, "id").collect()}
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in of.items() if x}
    want: dict = {}
    for i, x in got.items():
        for j, _, g in rows:
            if i == j and i is not None:
                for w in x:
                    want[g, w] = want.get((g, w), 0) + 1
    vocab = [(w, 1, 1) for w in sorted({w for x in got.values() for w in x})]
    names = sorted(w for w, _, _ in vocab)
    assert {(r.topic_id, names[r.idx]): r.c for r in text.group_counts(blocks, vocab).collect()} == want
    assert {7, 8} <= {g for g, _ in want}


def test_matches_are_those_of_the_token_pattern():
    rng = np.random.default_rng(5)
    for x in ["c++ c# .net a/b-c. a.+b 1#2 a+ a++b --x_y_ ..z", *("".join(rng.choice(list("ab1.+#-_/ "), 60)) for _ in range(300))]:
        assert re.findall(text.MATCHES, x) == re.findall(lexicon.TOKEN, x)


def test_documents_that_one_task_reads_are_dealt_over_the_cores(spark):
    docs = spark.range(0, 800, 1, 8).where("id < 100").selectExpr("id", "concat('alpha beta word', id) AS text")  # all in the first of 8 partitions
    blocks = text.prepared_blocks(docs, "id", "text", []).select("keys").collect()
    assert len(blocks) > 1 and max(len(b["keys"]) for b in blocks) < 60
    assert sorted(k for b in blocks for k in b["keys"]) == list(range(100))


def test_matches_of_arrays_are_those_of_texts_in_lower_case():
    rng = np.random.default_rng(6)
    odd = ["", None, "c++ c# .net a/b-c. a.+b 1#2 a+ a++b --x_y_ ..z .c# c#d c+++", "c+", "+", "#", "\u212ax \u0130y \u00c9Z"]
    for xs in [[], [None], odd, *([["".join(rng.choice(list("aBz1.+#-_/ \n\u00e9"), rng.integers(0, 60))) for _ in range(20)] for _ in range(50)])]:
        ends, found = text.matches(pa.array(["not read", *xs], pa.string()).slice(1))
        assert [found.to_pylist()[a:b] for a, b in zip(ends, ends[1:])] == [re.findall(text.MATCHES, (x or "").lower()) for x in xs]


def test_characters_that_are_folded_into_letters_of_tokens(spark):
    """Of all characters, as lower() of Spark has them."""
    points = pa.array([chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000], pa.string())
    told = spark.createDataFrame(pa.table({"x": points})).where("ascii(x) >= 128").select("x", F.lower("x").alias("y")).where(F.col("y").rlike(r"[\x00-\x7F]"))
    assert {r.x: r.y for r in told.collect()} == text.FOLDED


@pytest.mark.parametrize("numbered", [1 << 18, 60])
def test_pairs_that_can_not_be_terms_are_not_counted(spark, monkeypatch, numbered):
    """Frequent pairs of one block and of all blocks are found; where too many are likely, all are counted."""
    rng = np.random.default_rng(2)
    docs = [(i, [f"w{x}" for x in rng.zipf(1.3, 80) if x < 60] + ["a", "b"] * (60 if i < 6 else 0) + ["c", "d"]) for i in range(80)]
    df = spark.createDataFrame(docs, "id long, tokens array<string>").repartition(8)
    terms = text.ngrams(df, "id")
    want = [(r.term, r.df, r.cf) for r in text.vocabulary_terms(text.term_statistics(terms, "id"), 80, max_df=1.0, most=30).collect()]
    assert {"c d", "a b"} <= {t for t, _, _ in want}
    monkeypatch.setattr(text, "NUMBERED", numbered)
    counted = []
    own = text._likely_pairs
    monkeypatch.setattr(text, "_likely_pairs", lambda *x: counted.append(own(*x)) or counted[0])
    assert text.vocabulary_list(df, "id", 80, max_df=1.0, most=30) == want
    assert counted[0] is None if numbered == 60 else len(counted[0]) < terms.where("term LIKE '% %'").select("term").distinct().count() / 2


@pytest.mark.parametrize("numbered", [1 << 18, 2])
def test_new_tokens_are_the_tokens_of_words_once_a_task(spark, monkeypatch, numbered):
    monkeypatch.setattr(text, "REMEMBERED", numbered)
    odd = ["scikit", "llms", "gpt4", "1.2.3", "a-b", "-x_", "2024", "plain", ".net", "c++", "x.", "ml"]
    lists = spark.createDataFrame([(odd,), (odd[::-1],), (["plain", "new"],), ([],)], "words array<string>").coalesce(1)
    got = [r.token for r in lists.mapInArrow(text._new_tokens, "token string").collect()]
    want = lists.select(F.explode("words").alias("raw")).distinct().select(F.explode(C.token_parts(F.col("raw"))).alias("token"))
    assert set(got) == {r.token for r in want.collect()}
    if numbered > 2:
        assert sorted(got) == sorted(r.token for r in want.collect())


def test_texts_are_searched_in_pieces(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha w{i} beta " * (i % 4) or None) for i in range(30)], "id long, text string").coalesce(1)
    held = lambda: {r.id: r.tokens for r in text.block_docs(text.raw_blocks(docs, "id", "text"), "id").collect()}
    whole = held()
    assert whole == {i: ["alpha", f"w{i}", "beta"] * (i % 4) for i in range(30)}
    monkeypatch.setattr(text, "PIECE", 40)
    assert held() == whole
    part = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["x" * 30, None, "", *["y" * 30] * 6])], ["id", "text"])
    cut = list(text._cut(part, 60))
    assert len(cut) > 3 and pa.Table.from_batches(cut).to_pylist() == part.to_pylist()
