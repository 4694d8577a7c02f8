import itertools
import math

import numpy as np
import public_tokenizers

from panelforge.llm import langid


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "▁a", "ab", "ba", "aba", "▁ab"]
    rand = np.random.default_rng(1)
    prob = rand.random((len(pieces), 2))
    prob /= prob.sum(axis=0)
    model = langid.Model(pieces, ["x", "y"], prob)
    words = ["a", "ab", "aba", "abab", "abcab", "a" * 40]
    got = model.word_scores(words)

    def brute(text, g):
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(text)]
            value = 1.0
            for i, j in zip(at, at[1:]):
                part = text[i:j]
                value *= prob[pieces.index(part), g] if part in pieces else (langid.UNKNOWN if j - i == 1 else 0.0)
            total += value
        return math.log(total)

    for w, row in zip(words[:5], got):
        for g in range(2):
            assert abs(row[g] - brute("▁" + w, g)) < 1e-9
    assert np.isfinite(got).all() and np.isfinite(model.word_scores(["ab" * 5000])).all()


def test_expected_uses_add_up():
    model = langid.Model(["▁", "a", "▁a", "aa"], ["x"], np.full((4, 1), 0.25), langid.Vocabulary(["▁", "a", "▁a", "aa"]))
    uses = model.expected(["aa"], np.array([[3.0]]))
    # each segmentation covers three characters, three times over
    assert abs((uses[:, 0] * np.array([1, 1, 2, 2])).sum() - 9.0) < 1e-9


def test_edge_rows_and_unknown_labels(spark):
    rows = [
        (1, "the house and the garden of the king", "en", "a"),
        (2, "das Haus und der Garten des Königs", "de", "a"),
        (3, None, "en", "b"),
        (4, "", "de", "b"),
        (5, "123 --- !!! 456", "en", "c"),
        (6, "«…» ½", None, "c"),
        (8, "garden of the king " * 4000, None, "d"),
        (8, "garden of the king " * 4000, None, "d"),
        (None, "der Garten und das Haus", None, "d"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = sorted(langid.identify(docs, path).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (3, 4, 5, 6)] == ["und"] * 4 and by[3].score == 0.0
    assert all(0.0 <= r.score <= 1.0 for r in got)
    assert {r.lang_pred for r in got} <= {"en", "de", "und"}
    assert langid.identify(docs.limit(0), path).count() == 0


def test_held_out_accuracy(spark, sf):
    got = langid.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 200 and held
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_words_of_any_length_are_learned_from():
    pieces = ["▁", "的", "一", "是", "的一", "ab", "a", "b", "▁ab"]
    vocabulary = langid.Vocabulary(pieces)
    model = langid.Model(pieces, ["x", "y"], np.full((len(pieces), 2), 1.0 / len(pieces)), vocabulary)
    for word, sizes in (("的一是" * 14, [1, 1, 1, 1, 2, 2, 1, 1, 3]), ("ab" * 20, [1, 1, 1, 1, 2, 2, 1, 1, 3]), ("ab的" * 3000, [1, 1, 1, 1, 2, 2, 1, 1, 3])):
        uses = model.expected([word], np.array([[2.0, 1.0]]))
        covered = (uses * np.array(sizes)[:, None]).sum(axis=0)
        assert np.allclose(covered, np.array([2.0, 1.0]) * (len(word) + 1), rtol=1e-6), word[:6]
    # scaled sums give the uses of unscaled ones
    short = model.expected(["ab的一" * 3], np.ones((1, 2)))
    langid.RESCALE, kept = 2, langid.RESCALE
    try:
        assert np.allclose(model.expected(["ab的一" * 3], np.ones((1, 2))), short)
        assert np.allclose(model.word_scores(["ab的一" * 3]), model.word_scores(["ab的一" * 3]))
    finally:
        langid.RESCALE = kept


def test_one_very_long_word_through_the_query(spark):
    docs = spark.createDataFrame(
        [(1, "the house of the king", "en"), (2, "的一是不了人我在有" * 9000, "zh"), (3, "是不了人我在" * 30, None), (6, "of the king", None)],
        "doc_id long, text string, lang string",
    )
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert got[3] == "zh" and got[6] == "en"


def test_languages_with_few_long_texts_are_learned(spark):
    finnish, english = "talo on suuri ja järvi on syvä mutta yö on pimeä ", "the house is large and the lake is deep "
    rows = [(i, finnish * (60_000 if i < 6 else 3), "fi") for i in range(9)] + [(i, english * 20, "en") for i in range(9, 49)]
    rows += [(i, "123 456 " * 400_000, "und0") for i in range(50, 54)]  # no letter: nothing to learn
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert all(got[i] == want for i, _, want in rows if i < 49) and {got[i] for i in range(50, 54)} == {"und"}


def test_query_against_a_plain_forward_sum(spark, sf):
    from panelforge.llm.common import crc_mod, table

    docs = table(spark, sf, "documents")
    pieces = langid.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    counts = langid.sample_counts(docs.where(crc_mod("doc_id", 4) != 2).selectExpr("doc_id as id", "text", "lang"), 1_000_000)
    langs = sorted({lang for lang, _ in counts})
    model = langid.fit(pieces, langs, counts)
    place, known = {p: i for i, p in enumerate(pieces)}, {}

    def plain(word):
        text, sums = "▁" + word, [np.ones(len(langs))]
        for end in range(1, len(text) + 1):
            total = np.zeros(len(langs))
            for start in range(max(0, end - 16), end):
                i = place.get(text[start:end])
                if i is not None:
                    total += sums[start] * model.prob[i]
                elif end - start == 1:
                    total += sums[start] * langid.UNKNOWN
            sums.append(total)
        return np.log(sums[-1])

    assert max(map(len, pieces)) <= 16
    got = {r.doc_id: r for r in langid.query(spark, sf).collect()}
    for row in docs.orderBy("doc_id").limit(60).collect():
        words = [x for w in langid.words_of(row.text or "") for x in langid.letters_of(w)]
        if not words:
            assert got[row.doc_id].lang_pred == "und"
            continue
        total = sum(known[w] if w in known else known.setdefault(w, plain(w)) for w in words)
        assert got[row.doc_id].lang_pred == langs[int(total.argmax())]
        assert abs(got[row.doc_id].score - 1.0 / np.exp(total - total.max()).sum()) < 1e-6
