"""Language identification by segmentation-marginalised unigrams.

A language is a probability for each piece of a fixed public vocabulary.  The
probability of a word is the sum over all its segmentations into pieces,
found by a forward pass over its bytes; the words of a text are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsiq.llm.batches import buffers, freeing, held, set_aside, slices, strings, with_columns
from newsiq.llm.bpe import load_ranks
from newsiq.llm.hashing import mix

#: Longest piece in bytes that takes part; longer ones are left out of the vocabulary.
LONGEST = 10
#: Languages that a model may have, which bounds the broadcast model.
MAX_LANGUAGES = 64
#: Weight that every piece has before any is counted.
PRIOR = 0.5
#: Word bytes that a pass holds at once, and steps between two rescalings.
PASS_BYTES, RESCALE = 1 << 18, 8
#: Text bytes whose distinct words are scored together.
SLICE = 1 << 20

_TABLE_BITS = 20
_STEP = np.uint64(0x100000001B3)


class Vocabulary:
    """Pieces by their bytes, found for all positions and lengths of many words at once."""

    def __init__(self, data: bytes, longest: int = LONGEST):
        pieces = {p for p in load_ranks(data) if 0 < len(p) <= longest} | {bytes([b]) for b in range(256)}
        self.pieces, self.longest = sorted(pieces), longest
        keys = np.array([self._key(p) for p in self.pieces], np.uint64)
        self.slots = np.full(1 << _TABLE_BITS, -1, np.int32)
        self.keys = np.zeros(1 << _TABLE_BITS, np.uint64)
        for i, key in enumerate(keys.tolist()):
            at = key >> (64 - _TABLE_BITS)
            while self.slots[at] >= 0:
                at = (at + 1) % len(self.slots)
            self.slots[at], self.keys[at] = i, key
        used = self.slots >= 0
        # longest run of used slots: how far a search may have to go
        edges = np.flatnonzero(np.diff(np.concatenate([[0], used.astype(np.int8), [0]])))
        self.probes = int((edges[1::2] - edges[::2]).max())

    @staticmethod
    def _key(piece: bytes) -> int:
        h = np.zeros(1, np.uint64)
        for b in piece:
            h = h * _STEP + np.uint64(b + 1)
        return int(mix(h + np.uint64(len(piece)))[0])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the piece with each key, -1 where there is none."""
        at = (keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        out = np.where(self.keys[at] == keys, self.slots[at], -1)
        left = np.flatnonzero((out < 0) & (self.slots[at] >= 0))
        for _ in range(self.probes):
            if not len(left):
                break
            at[left] = (at[left] + 1) % len(self.slots)
            hit = self.keys[at[left]] == keys[left]
            out[left[hit]] = self.slots[at[left[hit]]]
            left = left[~hit & (self.slots[at[left]] >= 0)]
        return out

    def lattice(self, words: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Per piece length k: for every word and start the number of the piece of k bytes there, or -1.

        ``words`` holds one word a row, padded with zeros to the longest.
        """
        n, width = words.shape
        out, more = [], words.astype(np.uint64) + np.uint64(1)
        h = np.zeros((n, width + 1), np.uint64)
        for k in range(1, min(self.longest, width) + 1):
            h = h[:, : width - k + 1] * _STEP + more[:, k - 1 :]
            found = self.find(mix(h + np.uint64(k)).ravel()).reshape(h.shape)
            found[np.arange(width - k + 1)[None, :] + k > lengths[:, None]] = -1
            out.append(found)
        return out


def _gather(probs: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """(words, languages) probabilities of the pieces; ``probs`` ends with a row of zeros, which -1 finds."""
    return probs[pieces]


def forward(lattice: list[np.ndarray], lengths: np.ndarray, probs: np.ndarray, keep: bool = False):
    """Log-probability (words, languages) of each word: all segmentations summed.

    Values are rescaled on the way, so a word may have any length.  With
    ``keep`` the scaled forward values and scales of all positions come along.
    """
    n, width, langs = len(lengths), lattice[0].shape[1], probs.shape[1]
    ring = [np.zeros((n, langs))] * len(lattice)
    ring[0] = np.ones((n, langs))  # ring[i]: forward value i + 1 positions before the next one
    scale = np.zeros((n, 1))
    out = np.zeros((n, langs))
    alphas, scales = [ring[0]], [scale]
    for j in range(1, width + 1):
        alpha = np.zeros((n, langs))
        for k in range(1, min(len(lattice), j) + 1):
            alpha += ring[k - 1] * _gather(probs, lattice[k - 1][:, j - k])
        ring = [alpha, *ring[:-1]]
        if j % RESCALE == 0:
            top = alpha.max(1, keepdims=True)
            top[top == 0] = 1.0
            ring = [r / top for r in ring]
            scale = scale + np.log(top)
        done = lengths == j
        if done.any():
            out[done] = np.log(np.maximum(ring[0][done], 1e-300)) + scale[done]
        if keep:
            alphas.append(ring[0])
            scales.append(scale)
    return (out, alphas, scales) if keep else out


def expected(lattice: list[np.ndarray], lengths: np.ndarray, probs: np.ndarray, weights: np.ndarray, total: np.ndarray) -> None:
    """Add each piece's expected uses over all segmentations, by ``weights`` (words, languages), to ``total``.

    ``probs`` has one column: the pieces' probabilities under the current,
    language-independent model.
    """
    log_z, alphas, scales = forward(lattice, lengths, probs, keep=True)
    n, width = len(lengths), lattice[0].shape[1]
    ring = [np.zeros((n, 1))] * len(lattice)  # ring[i]: backward value i + 1 positions behind
    back = np.zeros((n, 1))  # log scale of the backward values
    for j in range(width, -1, -1):
        if j < width:
            beta = np.zeros((n, 1))
            shift = np.exp(np.clip(scales[j] + back - log_z, -700, 700))
            for k in range(1, min(len(lattice), width - j) + 1):
                pieces = lattice[k - 1][:, j]
                use = ring[k - 1] * _gather(probs, pieces)
                beta += use
                post = (alphas[j] * use * shift)[:, 0]
                at = np.flatnonzero((post > 0) & (pieces >= 0))
                for lang in range(weights.shape[1]):
                    total[:, lang] += np.bincount(pieces[at], post[at] * weights[at, lang], len(total))
        else:
            beta = np.zeros((n, 1))
        end = (lengths == j)[:, None]
        beta = np.where(end, np.exp(-back), beta)
        ring = [beta, *ring[:-1]]
        if j % RESCALE == 0:
            top = np.maximum.reduce(ring)
            top[top == 0] = 1.0
            ring = [r / top for r in ring]
            back = back + np.log(top)


def _passes(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers, padded bytes, lengths) of words of about the same length, about ``PASS_BYTES`` at a time."""
    raw, offsets = buffers(words)
    lengths = np.diff(offsets)
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    lo = 0
    while lo < len(order):
        hi = lo + 1
        first = int(lengths[order[lo]])
        limit = int(np.searchsorted(lengths[order], max(first + 2, first * 5 // 4), "right"))
        hi = min(limit, lo + max(1, PASS_BYTES // first))
        pick = order[lo:hi]
        width = int(lengths[pick[-1]])
        at = offsets[pick][:, None] + np.arange(width)[None, :]
        inside = np.arange(width)[None, :] < lengths[pick][:, None]
        yield pick, np.where(inside, raw[np.minimum(at, len(raw) - 1)], 0), lengths[pick]
        lo = hi


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word, word offsets of the texts): lower-case runs of letters."""
    lists = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(texts), r"\P{L}+", " "), " ")
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)


class Model:
    """Piece probabilities per language."""

    def __init__(self, languages: list[str], log_probs: np.ndarray):
        self.languages, self.log_probs = languages, log_probs


def _vocabulary(files) -> Vocabulary:
    return held("langid", hash(files.value), lambda: Vocabulary(files.value))


def _vocabulary_file(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # under a megabyte, fixed


def fit(labelled: DataFrame, vocabulary_path: str, text_col: str = "text", lang_col: str = "lang", prior: float = PRIOR) -> Model:
    """Piece probabilities of every non-null value of ``lang_col``, from all rows of ``labelled``.

    One expectation step from the uniform model: each word's segmentations are
    weighted by their probability under equally likely pieces, and the pieces'
    expected uses are added per language, plus ``prior`` for each piece.  Only
    sums per task, at most languages x pieces, are shuffled, and the finished
    model, of the same bounded size, comes to the driver; more than
    ``MAX_LANGUAGES`` languages are an error.  Null texts and labels count for
    nothing; an empty table gives a model without languages.
    """
    files = _vocabulary_file(labelled, vocabulary_path)
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(files)
        uniform = np.full((len(vocabulary.pieces) + 1, 1), 1.0 / len(vocabulary.pieces))
        uniform[-1] = 0
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, names = strings(batch, "words"), batch.column(0).dictionary_encode()
            langs = names.dictionary.to_pylist()
            for name in langs:
                totals.setdefault(name, np.zeros(len(vocabulary.pieces)))
            if len(totals) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages")
            for lo, hi in slices(buffers(texts)[1], SLICE):
                words, codes, ends = _words(texts[lo:hi])
                lang = np.repeat(names.indices.to_numpy()[lo:hi], np.diff(ends))
                uses = np.bincount(codes.astype(np.int64) * len(langs) + lang, minlength=len(words) * len(langs)).reshape(len(words), len(langs))
                sums = np.zeros((len(vocabulary.pieces), len(langs)))
                for pick, padded, lengths in _passes(words):
                    expected(vocabulary.lattice(padded, lengths), lengths, uniform, uses[pick].astype(float), sums)
                for i, name in enumerate(langs):
                    totals[name] += sums[:, i]
        for name, sums in totals.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at])], names=["lang", "piece", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([-1], pa.int32()), pa.array([0.0])], names=["lang", "piece", "n"])

    sums = rows.mapInArrow(freeing(run), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    table = sums.toArrow()
    names, pieces, n = table["lang"].to_pylist(), table["piece"].to_numpy(), table["n"].to_numpy()
    languages = sorted(set(names))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    size = len(Vocabulary(files.value).pieces)
    counts = np.full((size, len(languages)), float(prior))
    number = {name: i for i, name in enumerate(languages)}
    for name, piece, value in zip(names, pieces, n, strict=True):
        if piece >= 0:
            counts[piece, number[name]] += value
    return Model(languages, np.log(counts / counts.sum(0, keepdims=True)) if languages else counts)


def predict(df: DataFrame, model: Model, vocabulary_path: str, text_col: str = "text", keep: list[str] | None = None, evidence: bool = False) -> DataFrame:
    """``df`` with ``lang_pred`` string and ``score`` double, with ``evidence`` also ``per_byte`` double.

    The prediction is the language under which the whole text is most
    probable, the score its posterior probability when all languages are
    equally likely beforehand.  A text without any letter, a null text, and
    any text under a model without languages get ``und`` and score 0.  Ties go
    to the language first by name.  ``per_byte`` is the log-probability of the
    text under that language, by bytes of its letters: how well the language
    explains the text at all; null without a letter, 0 under a model without
    languages.  Texts are handled whole, a
    slice of them at a time, a very long one alone.  Existing columns of these
    names are replaced; only the text is looked at.
    """
    files = _vocabulary_file(df, vocabulary_path)
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.log_probs))

    def run(batch: pa.RecordBatch) -> list:
        languages, logs = shared.value
        vocabulary = _vocabulary(files)
        probs = np.vstack([np.exp(logs), np.zeros((1, len(languages)))])
        texts = strings(batch, text_col)
        best, score, per_byte = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
        known = np.zeros(len(texts), bool)
        for lo, hi in slices(buffers(texts)[1], SLICE):
            words, codes, ends = _words(texts[lo:hi])
            each = np.zeros((len(words) + 1, len(languages) + 1))
            each[:-1, -1] = np.diff(buffers(words)[1])
            if languages:
                for pick, padded, lengths in _passes(words):
                    each[pick, :-1] = forward(vocabulary.lattice(padded, lengths), lengths, probs)
            sums = np.add.reduceat(each[np.append(codes, len(words))], ends[:-1], axis=0)
            known[lo:hi] = sums[:, -1] > 0
            if languages:
                best[lo:hi] = sums[:, :-1].argmax(1)
                per_byte[lo:hi] = sums[:, :-1].max(1) / np.maximum(sums[:, -1], 1)
                score[lo:hi] = 1 / np.exp(sums[:, :-1] - sums[:, :-1].max(1, keepdims=True)).sum(1)
        names = [languages[b] if k and languages else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
        return [pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), *([pa.array(per_byte, mask=~known)] if evidence else [])]

    stay = list(df.columns if keep is None else keep)
    return with_columns(df.select(*dict.fromkeys([*stay, text_col])), "lang_pred string, score double" + ", per_byte double" * evidence, run, stay, by=text_col)


#: How far below the worst explained labelled row, in nats a byte, a text is still accepted.
ROOM = 0.5


def keep_explained(df: DataFrame, vocabulary_path: str, text_col: str = "text", lang_col: str = "lang", room: float = ROOM) -> DataFrame:
    """The rows of ``df``, with its own columns, whose text one of its languages explains.

    The model is fitted on all rows with a language.  Of those that it gives
    their own language, the lowest ``per_byte`` less ``room`` is the floor
    below which a text is rejected; so is a text without a letter, or null.
    The labelled rows are scored twice, which costs less than a copy of the table.
    Without any labelled row only those two go.  Very long texts are judged
    whole, repeated rows alike; an empty table stays empty.
    """
    plain, own = set_aside(df, ("lang_pred", "score", "per_byte"))
    model = fit(df.select(text_col, lang_col), vocabulary_path, text_col, lang_col)
    labelled = df.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("own"), F.col(text_col).alias("text"))
    explained = predict(labelled, model, vocabulary_path, keep=["own"], evidence=True).where("lang_pred = own")
    floor = explained.agg(F.min("per_byte")).first()[0]
    rows = predict(plain, model, vocabulary_path, text_col, evidence=True)
    rows = rows.where(F.col("per_byte") >= floor - room if floor is not None else F.col("per_byte").isNotNull())
    return rows.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in df.columns])
