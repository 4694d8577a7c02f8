import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CODER = byte_bpe._encoder(PATH, public_tokenizers.PATTERN)
PEER = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODER.bpe.ranks, special_tokens={}
)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abthe ing \n\r\t'sll!?1é\x1c\x85\xa0　你😀İ")), max_size=40))
def test_same_ids_as_tiktoken_and_round_trip(text):
    ids = CODER.encode(text)
    assert ids == PEER.encode_ordinary(text)
    assert CODER.bpe.decode(ids) == text.encode()


def test_append_and_replace_give_the_table_of_the_whole():
    bpe, rand = CODER.bpe, random.Random(3)
    for _ in range(300):
        data = "".join(rand.choice("abthe ing") for _ in range(rand.randint(0, 80))).encode()
        last = bpe.last_tokens(data)
        assert bpe.append(last, data, b"ation") == bpe.last_tokens(data + b"ation")
        i = rand.randint(0, len(data))
        j = rand.randint(i, len(data))
        text, table = bpe.replace(last, data, i, j, b"xthe")
        assert text == data[:i] + b"xthe" + data[j:] and table == bpe.last_tokens(text)


def test_edge_rows(spark):
    long = "ab" * 30000 + " x" * 30000
    rows = [(1, None, "a"), (2, "", "a"), (3, "The end.", "b"), (3, "The end.", "b"), (None, "x", "c"), (4, long, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = byte_bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    want = {r[0]: PEER.encode_ordinary(r[1] or "") for r in rows}
    for r in got:
        ids = want[r.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(PEER.decode_bytes(ids)).hexdigest()
    assert byte_bpe.digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    full = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN).where("doc_id = 3").first()
    assert bytes(full.decoded) == b"The end." and full.ids == want[3]


def test_vocabulary_without_single_bytes_is_refused():
    bpe = byte_bpe.PrefixBpe({base64.b64decode("YQ=="): 0})
    with pytest.raises(ValueError):
        bpe.encode(b"ab")


def test_query_over_the_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = byte_bpe.query(spark, sf).collect()
    assert len(got) == len(docs)
    assert all(r.n_tokens == len(PEER.encode_ordinary(docs[r.doc_id])) for r in got)


def test_digests_over_the_whole_table(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in byte_bpe.query(spark, sf).collect():
        ids = PEER.encode_ordinary(docs[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_caches_are_bounded_and_keep_the_ids():
    small = byte_bpe.TextEncoder(CODER.bpe, public_tokenizers.PATTERN, 50_000)
    rand = random.Random(5)
    for _ in range(300):
        text = " ".join("".join(rand.choice("abcdeghinorst") for _ in range(rand.randint(1, 12))) for _ in range(40))
        assert small.encode(text) == PEER.encode_ordinary(text)
    assert all(c.bytes <= c.most and (len(c) + len(c.old)) * 100 < 2 * c.most for c in (small.pieces, small.parts, small.spaced))
