"""Language identification by unigrams that are summed over all segmentations.

Each language has a probability for every piece of one fixed public vocabulary. The probability of a word is
the sum, over all ways to cut it into pieces, of the product of their probabilities; a forward pass over the
word's positions computes it for all languages at once. A text's log-probability is the sum over its words,
and the language with the highest one is predicted. Piece probabilities are fitted by expectation-maximisation:
the forward and backward sums give the expected number of uses of each piece in a language's words.

Words are runs of letters, lower case. The model is fitted on a bounded sample of labelled rows
(``chars_per_language``); scoring reads every whole text. Within a task, word scores are kept in a table of
bounded size, since most words recur.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a label that no sampled word backs
is not learned; ties go to the language that sorts first; characters outside the vocabulary count alike in every
language; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import chunks, crc_mod, table

#: ASCII characters that are no letters become spaces, so that bytes.split finds the words.
TO_SPACES = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
UNKNOWN = 1e-7
LIFT = 8.0  # each character's factor, so that products stay near 1; taken back in the logarithm
RESCALE = 16  # positions between scalings of the sums, which keeps words of any length in range
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"


@dataclass
class Hits:
    """Pieces found in words of one length: word, start, end and piece of each; ``at[e] : at[e + 1]`` are those that end
    at e; ``lone`` (N, L) marks characters that are no piece by themselves."""

    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    at: np.ndarray
    lone: np.ndarray


class Vocabulary:
    """Finds all pieces in many words of one length by hashes of their substrings."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.longest = max(map(len, pieces))
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.full(self.longest, self.BASE, np.uint64)) * np.uint64(1)
        self.tables = {}
        by_length = defaultdict(list)
        for i, piece in enumerate(pieces):
            by_length[len(piece)].append((piece, i))
        for n, found in by_length.items():
            codes = np.array([x for x, _ in found], f"U{n}").view(np.uint32).reshape(len(found), n)
            hashes = self._hash(codes)
            order = np.argsort(hashes)
            seen = np.zeros(1 << 18, bool)
            seen[hashes >> np.uint64(46)] = True
            self.tables[n] = hashes[order], np.array([i for _, i in found], np.int32)[order], seen

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = np.zeros(codes.shape[0], np.uint64)
            for k in range(codes.shape[1]):
                h = (h + codes[:, k] + np.uint64(1)) * self.BASE
        return h ^ (h >> np.uint64(29))

    def hits(self, codes: np.ndarray) -> Hits:
        """All pieces in words (N, L), in the order of their end and word; one pass for each length of pieces."""
        n, length = codes.shape
        found, single = [], np.zeros((n, length), bool)
        with np.errstate(over="ignore"):
            wide = codes.astype(np.uint64) + np.uint64(1)
            h = np.zeros((n, length), np.uint64)
            for size in range(1, min(self.longest, length) + 1):
                h = (h[:, : length - size + 1] + wide[:, size - 1 :]) * self.BASE
                if size not in self.tables:
                    continue
                hashes, ids, seen = self.tables[size]
                key = h ^ (h >> np.uint64(29))
                rows, starts = np.nonzero(seen[key >> np.uint64(46)])
                keys = key[rows, starts]
                at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
                good = hashes[at] == keys
                rows, starts = rows[good], starts[good]
                if size == 1:
                    single[rows, starts] = True
                found.append((rows, starts, starts + size, ids[at[good]]))
        rows, starts, ends, ids = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((rows, ends))
        rows, starts, ends, ids = rows[order], starts[order], ends[order], ids[order]
        return Hits(rows, starts, ends, ids, np.searchsorted(ends, np.arange(length + 2)), ~single)


def by_length(words: list[str], most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in ``words``, character codes (N, L)) for words of each length."""
    groups = defaultdict(list)
    for i, word in enumerate(words):
        groups[len(word)].append(i)
    for n, found in sorted(groups.items()):
        step = max(1, min(most, (1 << 20) // n))
        for k in range(0, len(found), step):
            part = found[k : k + step]
            codes = np.array([words[i] for i in part], f"U{n}").view(np.uint32).reshape(len(part), n)
            yield np.array(part), codes


@dataclass
class Model:
    """Piece probabilities by language: ``prob`` is (pieces, languages)."""

    pieces: list[str]
    langs: list[str]
    prob: np.ndarray
    vocabulary: Vocabulary | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"vocabulary": None}

    def forward(self, length: int, n: int, hits: Hits, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """alpha (L + 1, N, G), and the logarithms (same shape) by which each value has been scaled down.

        Every ``RESCALE`` positions, all values that later ones are built on are divided by the newest one.
        """
        alpha, logs = np.zeros((length + 1, n, lifted.shape[1])), np.zeros((length + 1, n, lifted.shape[1]))
        alpha[0], back = 1.0, self.vocabulary.longest
        for end in range(1, length + 1):
            part = slice(hits.at[end], hits.at[end + 1])
            here, rows = alpha[end], hits.rows[part]
            logs[end] = logs[end - 1]
            if rows.size:
                flow = alpha[hits.starts[part], rows] * lifted[hits.ids[part]]
                first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                here[rows[first]] = np.add.reduceat(flow, first, axis=0)
            lone = hits.lone[:, end - 1]
            if lone.any():  # a character that is no piece
                here[lone] += alpha[end - 1][lone] * (UNKNOWN * LIFT)
            if end % RESCALE == 0 and end < length:
                scale = here.copy()
                window = slice(max(0, end - back), end + 1)
                alpha[window] /= scale
                logs[window] += np.log(scale)
        return alpha, logs

    def backward(self, length: int, n: int, hits: Hits, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from the words' ends: beta (L + 1, N, G) and its logarithms."""
        beta, logs = np.zeros((length + 1, n, lifted.shape[1])), np.zeros((length + 1, n, lifted.shape[1]))
        beta[length], back = 1.0, self.vocabulary.longest
        now = np.zeros((n, lifted.shape[1]))
        for end in range(length, 0, -1):
            if (length - end) % RESCALE == 0 and end < length:
                scale = beta[end].copy()
                beta[max(0, end - back) : end + 1] /= scale
                now = now + np.log(scale)
            logs[end] = now
            part = slice(hits.at[end], hits.at[end + 1])
            rows = hits.rows[part]
            if rows.size:  # a word has at most one piece of a start and an end
                beta[hits.starts[part], rows] += lifted[hits.ids[part]] * beta[end][rows]
            lone = hits.lone[:, end - 1]
            if lone.any():
                beta[end - 1][lone] += beta[end][lone] * (UNKNOWN * LIFT)
        logs[0] = now
        return beta, logs

    def _lifted(self) -> np.ndarray:
        sizes = np.array([len(x) for x in self.pieces])
        return self.prob * (LIFT**sizes)[:, None]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-probability (words, languages) of each word, with a mark for the word's beginning."""
        if self.vocabulary is None:
            self.vocabulary = Vocabulary(self.pieces)
        lifted, out = self._lifted(), np.zeros((len(words), len(self.langs)))
        for at, codes in by_length(["▁" + w for w in words]):
            n, length = codes.shape
            alpha, logs = self.forward(length, n, self.vocabulary.hits(codes), lifted)
            out[at] = np.log(alpha[-1]) + logs[-1] - length * np.log(LIFT)
        return out

    def expected(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Expected uses (pieces, languages) of each piece over weighted words of any length."""
        lifted, out = self._lifted(), np.zeros_like(self.prob)
        for at, codes in by_length(["▁" + w for w in words]):
            n, length = codes.shape
            hits = self.vocabulary.hits(codes)
            alpha, logs = self.forward(length, n, hits, lifted)
            beta, back = self.backward(length, n, hits, lifted)
            whole = np.log(alpha[-1]) + logs[-1]
            uses = alpha[hits.starts, hits.rows] * lifted[hits.ids] * beta[hits.ends, hits.rows]
            uses *= np.exp(logs[hits.starts, hits.rows] + back[hits.ends, hits.rows] - whole[hits.rows]) * weights[at][hits.rows]
            for g in range(out.shape[1]):
                out[:, g] += np.bincount(hits.ids, uses[:, g], len(out))
        return out


def fit(pieces: list[str], langs: list[str], counts: dict[tuple[str, str], int], rounds: int = 4) -> Model:
    """Piece probabilities from word counts by (language, word), all languages together."""
    words = sorted({w for _, w in counts})
    place, column = {w: i for i, w in enumerate(words)}, {x: i for i, x in enumerate(langs)}
    weights = np.zeros((len(words), len(langs)))
    for (lang, word), n in counts.items():
        weights[place[word], column[lang]] += n
    model = Model(pieces, langs, np.full((len(pieces), len(langs)), 1.0 / len(pieces)), Vocabulary(pieces))
    for _ in range(rounds):
        uses = model.expected(words, weights) + 0.01
        model.prob = uses / uses.sum(axis=0)
    return model


def load_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece model, without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        sp.id_to_piece(i)
        for i in range(sp.get_piece_size())
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))
    ]


def words_of(text: str) -> list[bytes]:
    """Words as bytes, cut at ASCII non-letters; ``letters_of`` cuts them at all others."""
    return text.lower().encode("utf-8", "surrogatepass").translate(TO_SPACES).split()


def letters_of(word: bytes) -> list[str]:
    return "".join(c if c.isalpha() else " " for c in word.decode("utf-8", "surrogatepass")).split()


def sample_counts(docs: DataFrame, chars_per_language: int) -> dict[tuple[str, str], int]:
    """Word counts by language over a bounded sample of labelled rows (columns id, text, lang).

    Of each language, whole texts with letters are taken by a hash of their id: those below the share that gives about
    ``chars_per_language`` characters, and always the one that comes first, so no language is lost that has such a text.
    """
    drawn = F.pmod(F.xxhash64(F.col("id"), F.lit("lang sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = labelled.groupBy("lang").agg(F.sum(F.length("text")).alias("n"), F.min(drawn).alias("first")).collect()
    shares = {r["lang"]: max(min(1.0, chars_per_language / r["n"]), r["first"]) for r in sizes}
    if not shares:
        return {}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)

        def flush():
            rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            found.clear()
            lang, word, n = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"]
            )

        for batch in chunks(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[lang].update(x for w, n in Counter(words_of(text)).items() for x in letters_of(w) * n)
            if sum(map(len, found.values())) > 300_000:
                yield flush()
        yield flush()

    rows = (
        labelled.where(drawn <= share)
        .select("lang", "text")
        .mapInArrow(count, "lang string, word string, n bigint")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    return {(a, b): n for a, b, n in zip(*(rows.column(i).to_pylist() for i in range(3)))}


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): score is the predicted language's share of the posterior, all languages alike before."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    most = 200_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Model = shared.value
        place: dict[bytes, int] = {}
        scores, lettered = np.zeros((1024, len(known.langs))), np.zeros(1024, bool)
        for batch in chunks(batches, 1024):
            texts = [words_of(text or "") for text in batch.column(1).to_pylist()]
            new = list({w for words in texts for w in words if w not in place})
            if len(place) + len(new) > most:
                place.clear()
                new = list({w for words in texts for w in words})
            first, last = len(place), len(place) + len(new)
            if last > len(scores):
                scores = np.concatenate([scores[:first], np.zeros((2 * last - first, len(known.langs)))])
                lettered = np.concatenate([lettered[:first], np.zeros(2 * last - first, bool)])
            parts = [letters_of(w) for w in new]
            sizes = np.array([len(p) for p in parts], np.int64)
            scores[first:last], lettered[first:last] = 0.0, sizes > 0
            np.add.at(scores, first + np.repeat(np.arange(len(new)), sizes), known.word_scores([x for p in parts for x in p]))
            place.update(zip(new, range(first, last)))
            langs, shares = [], []
            for words in texts:
                at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                if not known.langs or not lettered[at].any():
                    langs.append("und")
                    shares.append(0.0)
                    continue
                total = scores[at].sum(axis=0)
                best = int(total.argmax())
                langs.append(known.langs[best])
                shares.append(float(1.0 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(shares, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    held_out = F.coalesce(crc_mod(id_col, 4) == 2, F.lit(False))
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out")
    ).mapInArrow(run, SCHEMA)


def identify(
    docs: DataFrame, vocabulary: str, chars_per_language: int = 1_000_000, id_col: str = "doc_id"
) -> DataFrame:
    """Fit on the rows of ``docs`` (id, text, lang) that are not held out, then predict all rows."""
    training = docs.where(crc_mod(id_col, 4) != 2).select(F.col(id_col).alias("id"), "text", "lang")
    counts = sample_counts(training, chars_per_language)
    langs = sorted({lang for lang, _ in counts})
    return predict(docs, fit(load_pieces(vocabulary), langs, counts), id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
