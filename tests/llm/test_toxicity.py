import numpy as np

from panelforge.llm import toxicity


def test_step_turns_round_where_the_clean_risk_is_negative():
    high, low = np.full(4, 3.0), np.full(4, -30.0)
    d_p, d_u, _ = toxicity.nnpu_step(high, low, 0.5)  # unlabelled risk ~0, less 0.5 * 3: negative
    assert (d_p > 0).all() and (d_u < 0).all()
    d_p, d_u, risk = toxicity.nnpu_step(high, high, 0.5)
    assert (d_u > 0).all() and risk > 0


def test_gradient_is_that_of_the_risk():
    rand = np.random.default_rng(0)
    z_p, z_u, e = rand.normal(size=5), rand.normal(size=7) + 1, 1e-6
    d_p, d_u, risk = toxicity.nnpu_step(z_p, z_u, 0.3)
    for k in range(5):
        up = z_p.copy()
        up[k] += e
        assert abs((toxicity.nnpu_step(up, z_u, 0.3)[2] - risk) / e - d_p[k]) < 1e-4
    for k in range(7):
        up = z_u.copy()
        up[k] += e
        assert abs((toxicity.nnpu_step(z_p, up, 0.3)[2] - risk) / e - d_u[k]) < 1e-4


def test_learns_planted_words_without_reading_clean_labels():
    rand = np.random.default_rng(2)
    words = [f"word{i}" for i in range(300)]
    text = lambda bad: " ".join([*rand.choice(words, 40), *(["nastyword"] if bad else [])])
    slots = lambda t: np.array(sorted(x for w in toxicity.words_of(t) for x in toxicity.features_of(w)), np.int32)
    positive = [slots(text(True)) for _ in range(80)]
    unlabelled = [slots(text(k % 10 == 0)) for k in range(400)]
    score = toxicity.fit(positive, unlabelled, 0.1).scorer()
    got = score([text(True) for _ in range(50)] + [text(False) for _ in range(50)])
    assert all(s >= 0.5 for s in got[:50]) and all(s < 0.5 for s in got[50:])


def test_edge_rows(spark):
    docs = spark.createDataFrame(
        [(1, "Vile text", 1), (2, None, 2), (3, "", 3), (3, "", 3), (None, "x " * 50000, 4)],
        "doc_id long, text string, toxic int",
    )
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (9, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = docs.select("doc_id", toxicity.score_column(spark, model, docs["text"]).alias("s")).collect()
    assert len(got) == 5 and all(0.0 <= r.s <= 1.0 for r in got)
    nothing = toxicity.train(docs.limit(0), labels.limit(0))
    assert docs.select(toxicity.score_column(spark, nothing, docs["text"]).alias("s")).where("s >= 0.5").count() == 0
    assert docs.limit(0).select(toxicity.score_column(spark, nothing, docs["text"])).count() == 0


def test_held_out_accuracy(spark):
    """Both kinds, on the largest table; the score of every row against a plain sum of word weights."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.query(spark, sf).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    for toxic, least in ((0, 0.97), (1, 0.75)):
        of = [r.predicted == toxic for r in held if truth[r.doc_id] == toxic]
        assert len(of) >= 20 and sum(of) >= least * len(of), (toxic, sum(of), len(of))


def test_query_against_plain_sums(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.learn(spark, docs, sf)
    got = {r.doc_id: r for r in toxicity.query(spark, sf).collect()}
    for row in docs.collect():
        z = model.bias + sum(float(model.weights[x]) for w in toxicity.words_of(row.text or "") for x in toxicity.features_of(w))
        want = 1.0 / (1.0 + np.exp(-min(max(z, -500.0), 500.0)))
        assert abs(got[row.doc_id].score - want) < 1e-6 and got[row.doc_id].predicted == int(got[row.doc_id].score >= 0.5)
