import itertools
import random

import numpy as np

from panelforge.llm import decontaminate as d

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew strange potions at noon"


def brute(text, item):
    """Whether some window of the item lies in the text with few enough substitutions, by trying all places."""
    x, y = d.tokens_of(text), d.tokens_of(item)
    if not y:
        return False
    width, most = (d.WINDOW, d.SUBSTITUTIONS) if len(y) >= d.WINDOW else (len(y), int(len(y) >= d.ONE_OFF))
    if len(x) < width:
        return False
    number = {w: i for i, w in enumerate({*x, *y})}
    same = np.array([number[w] for w in x])[:, None] == np.array([number[w] for w in y])
    n, m = len(x) - width + 1, len(y) - width + 1
    return bool((sum(same[k : n + k, k : m + k].astype(np.int8) for k in range(width)) >= width - most).any())


def test_masks_are_lossless_for_the_allowed_substitutions():
    for gone in itertools.combinations(range(d.WINDOW), d.SUBSTITUTIONS):
        assert any(
            all(start + k not in gone for k in mask) for mask in d.MASKS for start in range(d.WINDOW - mask[-1])
        )


def test_same_as_brute_force():
    rand = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rand.choice(words) for _ in range(rand.randint(2, 24)))) for i in range(25)]
    seeds = d.Seeds(items)
    texts = [None, ""]
    for _ in range(120):
        parts = [rand.choice(words + ["zz"]) for _ in range(rand.randint(0, 15))]
        item = rand.choice(items)[1].split()
        for k in range(rand.randint(0, 4)):
            item[rand.randrange(len(item))] = rand.choice(["subst", "other"])
        cut = rand.randint(0, len(item))
        texts.append(" ".join(parts + item[rand.randint(0, cut) :] + parts[::-1]))
    for text, found in zip(texts, seeds.overlaps(texts)):
        assert {seeds.ids[i] for i, *_ in found} == {i for i, item in items if brute(text or "", item)}


def test_edge_rows_and_blocks(spark):
    leak = ITEM.upper().replace("BROWN", "red").replace(" ", ", ")
    docs = spark.createDataFrame(
        [(1, "intro " + leak + " outro", "k"), (2, None, "k"), (3, "", "k"), (4, "a clean text", "k"), (1, leak, "k"),
         (None, "x " * 40000 + ITEM, "k")],
        "doc_id long, text string, item_id string",
    )
    bench = spark.createDataFrame([(7, ITEM, 1), (8, "too short", 1), (None, None, 1)], "item_id long, text string, doc_id int")
    for chars in (60, 1_000_000):
        got = d.overlaps(docs, bench, chars).collect()
        assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 7), (1, 7), (1, 7)]
        clean = docs.where(~d.contaminated(spark, docs["text"], bench, chars))
        assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4]
    assert {r.matched_tokens for r in d.overlaps(docs, bench).where("doc_id = 1").collect()} == {17}
    assert d.overlaps(docs.limit(0), bench).count() == 0
    assert d.overlaps(docs, bench.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = set()
    for doc in docs:
        words = set(d.tokens_of(doc.text))
        for item in items:
            if len(set(d.tokens_of(item.text)) & words) > 6 and brute(doc.text, item.text):
                want.add((doc.doc_id, item.item_id))
    assert {(r.doc_id, r.item_id) for r in d.query(spark, sf).collect()} == want


def test_scripts_without_spaces_and_short_items():
    question = "下列哪一项是光合作用的主要产物？请选择最合适的答案，并说明理由。"
    seeds = d.Seeds([(1, question), (2, "five words make an item"), (3, "…"), (4, "один—два “три” четыре пять шесть")])
    assert len(d.tokens_of(question)) == 29 and d.tokens_of("a—b\u3000c“d”") == [b"a", b"b", b"c", b"d"]
    changed = question.replace("主要", "次要")
    texts = ["前文" + changed + "后文", "so five words, make an item.", "five words made an item", "x один два три четыре пять шесть", "…"]
    assert [[seeds.ids[i] for i, *_ in found] for found in seeds.overlaps(texts)] == [[1], [2], [], [4], []]
    assert d.Seeds([(2, "five words make an item")], shortest=6).overlaps(texts[1:2]) == [[]]


def test_a_frame_of_very_many_items(monkeypatch):
    monkeypatch.setattr(d, "HITS", 50)
    frame = "which of the following statements about the topic named below is correct in every respect"
    seeds = d.Seeds([(i, f"{frame} topic{i}") for i in range(200)])
    found = seeds.overlaps([frame, "nothing of it", frame])
    assert [len(x) for x in found] == [200, 0, 200]
    assert [len(x) for x in seeds.overlaps([frame, "nothing of it"], True)] == [1, 0]
