"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string, the BPE encoding of that prefix ends in exactly one token, and that token
is the only one that both ends there and may follow the last token of the remaining shorter prefix. Storing
this last token per prefix gives the encoding in one left-to-right pass, makes appending exact, and lets an
edit re-encode only from the edit on, until the stored tokens agree again.

Whether two tokens may stand side by side is decided by undoing merges on both sides of their border: if at
some moment the two tokens at the border would have been merged before either of them was built, they may not.

Defined cases: a null text counts as empty; an empty text has no tokens (``n_tokens`` 0 and the digest of the
empty string); a match that is itself in the vocabulary is that one token; repeated rows give repeated rows;
other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from sys import getsizeof

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import chunks, table

#: White space as Unicode has it (the \\s of the pattern), for cutting texts before matching.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Most pairs of tokens whose fit is remembered (about 160 bytes each), and most bytes that an encoder's three caches
#: may hold together. Both are per running task and independent of the input.
FITS = 1 << 18
CACHE_BYTES = 88 << 20

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def load_ranks(lines: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the text of a ``.tiktoken`` file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}


class PrefixBpe:
    """Encoder for one vocabulary of ranks. ``last_tokens`` is the table of the dynamic programme."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._sound: set[int] = set()  # tokens known to be reachable by merges

    def _merged(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first; used only to learn how a vocabulary entry is put together."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            found = [(self.ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in self.ranks]
            found = [x for x in found if x[0] < self.ranks.get(data, 1 << 60)]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[x] for x in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for single bytes and for entries no merge reaches."""
        if token not in self._halves:
            data = self.token[token]
            parts = self._merged(data) if len(data) > 1 else []
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two tokens side by side."""
        key = (left, right)
        if (known := self._fits.get(key)) is None:
            if len(self._fits) >= FITS:
                self._fits.clear()
            known = self._fits[key] = self._undo(left, right)
        return known

    def _undo(self, x: int, y: int) -> bool:
        # built_*: rank of the merge that made the part which has been taken apart on that side. A merge across
        # the border wins over that one if its rank is lower, or equal and further left.
        made = 1 << 60
        while True:
            across = self.ranks.get(self.token[x] + self.token[y])
            if across is not None and across < made:
                return False
            parts_x, parts_y = self.halves(x), self.halves(y)
            # take the later merge apart first; of equal ones, the right-hand one was made later
            if parts_x and (not parts_y or x > y):
                made, x = x, parts_x[1]
            elif parts_y:
                made, y = y + 1, parts_y[0]
            else:
                return True

    def reachable(self, token: int) -> bool:
        if len(self.token[token]) > 1 and self.halves(token) is None:
            return False
        self._sound.add(token)
        return True

    def last_tokens(self, data: bytes, known: list[int] | None = None) -> list[int]:
        """For each prefix data[:i + 1], the last token of its encoding. ``known``: the table of a prefix of data.

        The token is the one that ends there and may follow the last token of what is before it. Where the last token of
        the prefix one byte shorter begins is tried first, since tokens mostly grow; then all places, the nearest first.
        """
        last, get, fits, sound = list(known or ()), self.ranks.get, self._fits, self._sound
        size, grown = len(data), 0
        if last:
            grown = len(last) - len(self.token[last[-1]])
        for end in range(len(last) + 1, size + 1):
            token = get(data[grown:end])
            if token is not None and token in sound:
                if not grown:
                    last.append(token)
                    continue
                key = (last[grown - 1], token)
                good = fits.get(key)
                if good is None:
                    good = self.fits(*key)
                if good:
                    last.append(token)
                    continue
            grown, token = self._place(data, end, last)
            last.append(token)
        return last

    def _place(self, data: bytes, end: int, last: list[int]) -> tuple[int, int]:
        """(start, token) of the last token of data[:end]."""
        get, fits, sound = self.ranks.get, self._fits, self._sound
        for start in range(end - 1, -1, -1):
            token = get(data[start:end])
            if token is None or (token not in sound and not self.reachable(token)):
                continue
            if not start:
                return start, token
            key = (last[start - 1], token)
            good = fits.get(key)
            if good is None:
                good = self.fits(*key)
            if good:
                return start, token
        raise ValueError("no token ends here; does the vocabulary lack single bytes?")

    def read_back(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.token[last[end - 1]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        return self.read_back(self.last_tokens(data))

    def append(self, last: list[int], data: bytes, more: bytes) -> list[int]:
        """The table of data + more from that of data; nothing of data is looked at again but its last bytes."""
        return self.last_tokens(data + more, last)

    def replace(self, last: list[int], data: bytes, start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """The text with data[start:stop] replaced, and its table: kept before the edit, re-encoded after it
        until the rest is bound to repeat the old table."""
        text = data[:start] + new + data[stop:]
        table_, longest, same = last[:start], max(map(len, self.token.values())), 0
        for end in range(start + 1, len(text) + 1):
            table_.append(self._place(text, end, table_)[1])
            old = end - len(text) + len(data)
            same = same + 1 if end > start + len(new) and old > 0 and table_[-1] == last[old - 1] else 0
            if same >= longest:  # every later token starts inside the stretch that agrees
                return text, table_ + last[old:]
        return text, table_

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class _Cache(dict):
    """Values of ``make`` by key. At ``most`` bytes they become the old generation, from which keys in use return, and
    the former old one is dropped; so twice ``most`` bounds the memory, and frequent keys stay."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old, self.bytes = make, most, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            self.bytes += getsizeof(key) + getsizeof(value) + 48  # and a slot of the table
            if self.bytes >= self.most:
                self.old, self.bytes = dict(self), 0
                self.clear()
            self[key] = value
        return value


class TextEncoder:
    """Whole texts: pieces by the pattern, each encoded by ``PrefixBpe``.

    A piece never holds white space after other characters, so a text may be cut before each run of white space
    and the parts matched apart; texts whose white space is single spaces are cut by ``str.split``.
    """

    def __init__(self, bpe: PrefixBpe, pattern: str, most: int = CACHE_BYTES):
        self.bpe = bpe
        self.pattern = regex.compile(pattern)
        self.cut = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.odd = re.compile(f"[{WHITE}]{{2}}|^[{WHITE}]|[{WHITE}]$")
        self.pieces = _Cache(self._piece, most // 16)
        self.parts = _Cache(self._part, most // 16)
        self.spaced = _Cache(self._spaced, most * 3 // 8)

    def _part(self, part: str) -> tuple[int, ...]:
        found = self.pattern.findall(part)
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, found))) if len(found) > 1 else self.pieces[part]

    def _spaced(self, part: str) -> tuple[int, ...]:
        """A part after a single space; if it is all letters, the pattern takes it whole."""
        return self._piece(" " + part) if part.isalpha() else self._part(" " + part)

    def _piece(self, piece: str) -> tuple[int, ...]:
        return tuple(self.bpe.encode(piece.encode("utf-8", "surrogatepass")))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if self.odd.search(text):
            return list(chain.from_iterable(map(self.parts.__getitem__, self.cut.findall(text))))
        first, *rest = text.split(" ")
        out = list(chain.from_iterable(map(self.parts.__getitem__, self.cut.findall(first))))
        out.extend(chain.from_iterable(map(self.spaced.__getitem__, rest)))
        return out


@lru_cache(maxsize=1)
def _encoder(path: str, pattern: str) -> TextEncoder:
    """One for each worker: all that it keeps is bounded in bytes, so it may stay from task to task."""
    with open(path, "rb") as file:
        return TextEncoder(PrefixBpe(load_ranks(file.read())), pattern)


def encode(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids array<int>, decoded binary) of every text; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(vocabulary, pattern)
        for batch in chunks(batches, 256):
            ids = [coder.encode(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(coder.bpe.decode, ids), pa.binary())],
                ["doc_id", "ids", "decoded"],
            )

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id bigint, ids array<int>, decoded binary"
    )


def digests(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Number of tokens, digest of the ids and digest of the decoded bytes of every text.

    The same encoder as ``encode``, with the digests taken where the ids are, so that no ids leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(vocabulary, pattern)
        decimal = {rank: str(rank) for rank in coder.bpe.token}
        for batch in chunks(batches, 256):
            rows = []
            for text in batch.column(1).to_pylist():
                ids = coder.encode(text or "")
                rows.append(
                    (
                        len(ids),
                        hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest(),
                        hashlib.sha256(coder.bpe.decode(ids)).hexdigest(),
                    )
                )
            n, a, b = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, SCHEMA
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
